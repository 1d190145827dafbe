"""Quality rules as weak supervision.  DataFrame functions only.

Rules vote for (1) or against (-1) a document or abstain (0).  Documents with the same votes are counted together;
expectation-maximisation over these counts estimates each rule's accuracy and the share of good documents, and the
posterior probability of being good replaces the demand that every rule be passed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: Posterior probability from which a document is kept.
KEEP_FROM = 0.5
#: Bounds of a rule's accuracy: better than a coin, never certain.
ACCURACY = (0.55, 0.98)
ROUNDS = 200


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and counts of every whole text, all long: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper``.  One narrow pass.

    A null text has no words.  ``n_repeat_words`` are the words in a three-word window found at least twice: windows
    are compared by 64-bit hashes, sorted within the document.  Repeated rows are counted each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.when(F.size("ws") >= 3, F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = docs.select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", "t", F.filter(F.split("t", _BLANKS), lambda w: w != "").alias("ws"), F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD)).alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        hashed.alias("hs"),
    )
    # Each step is a projection of its own, so that a lambda reads a finished array and doesn't make it anew.
    same = F.size(F.array_distinct("hs")) < F.size("hs")
    rows = rows.withColumn("tagged", F.when(same, F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda t, j: (t["h"] == F.get("tagged", j - 1)["h"]) | (t["h"] == F.get("tagged", j + 1)["h"])
    rows = rows.withColumn("at", F.when(F.col("tagged").isNotNull(), F.sort_array(F.transform(F.filter("tagged", lambda t, j: F.coalesce(twin(t, j), F.lit(False))), lambda t: t["i"]))))
    gaps = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return rows.drop("hs", "tagged", "at")


def _vote(good: Column, bad: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0))


def votes() -> dict[str, Column]:
    """The rules, as votes over the columns of ``base_counts``; a rule abstains where it has too little to go by."""
    words, enough = F.col("n_words"), F.col("n_words") >= 20
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "length": _vote(words >= 80, words < MIN_WORDS),
        "word_size": _vote(enough & share("word_chars", "n_words").between(3, 9), (words > 0) & ~share("word_chars", "n_words").between(2.5, 14)),
        "symbols": _vote(enough & (share("n_symbols", "n_words") < 0.02), share("n_symbols", "n_words") > 0.1),
        "repeated_lines": _vote((F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0), share("n_dup_lines", "n_lines") > 0.3),
        "repeated_words": _vote(enough & (share("n_repeat_words", "n_words") < 0.2), share("n_repeat_words", "n_words") > 0.4),
        "capitals": _vote(enough & (share("n_upper", "word_chars") < 0.1), share("n_upper", "word_chars") > 0.4),
    }


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Share of good documents and accuracy of each rule, from how often each pattern of votes occurs.

    A rule that votes is right with its accuracy, whichever the class; abstaining says nothing.  Starts from 0.8 and
    0.8; without any votes it stays there.
    """
    rules = len(next(iter(counts), ()))
    prior, accuracy = 0.8, [0.8] * rules
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        good, right, cast = 0.0, [0.0] * rules, [0.0] * rules
        for pattern, n in sorted(counts.items()):
            p = posterior(pattern, prior, accuracy)
            good += n * p
            for k, v in enumerate(pattern):
                if v:
                    right[k] += n * (p if v > 0 else 1 - p)
                    cast[k] += n
        new = [min(max((r + 8) / (c + 10), ACCURACY[0]), ACCURACY[1]) for r, c in zip(right, cast)]
        moved = max([abs(a - b) for a, b in zip(new, accuracy)] + [abs(good / total - prior)])
        prior, accuracy = min(max(good / total, 0.02), 0.98), new
        if moved < 1e-9:
            break
    return prior, accuracy


def posterior(pattern: tuple[int, ...], prior: float, accuracy: list[float]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts of ``base_counts``, ``base_failed``, ``quality`` (posterior
    probability of being good) and ``kept``.

    Fewer than 50 words, or more than half of the words in repeated windows, fail the base and are not kept whatever
    the votes.  Ties at 0.5 are kept.  Only the counts of vote patterns (at most 3 to the number of rules) reach the
    driver.  An empty table gives no rows; other columns are ignored.
    """
    rules = votes()
    rows = common.stored(base_counts(docs).select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in rules.items())))
    names = [f"vote_{k}" for k in rules]
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()
    prior, accuracy = estimate({tuple(p[n] for n in names): p["n"] for p in patterns})
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, a in zip(names, accuracy):
        odds = odds + F.col(name) * F.lit(math.log(a / (1 - a)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op7_weak_supervision": _query}
ORACLE_SQL: dict[str, str] = {}
