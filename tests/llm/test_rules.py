"""Base counts against plain Python; the estimate against known accuracies."""

import random
import re

import pytest

from tessera.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _texts():
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n", "one", "a b", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n \nx y z", "é#  * $ \x0b|<>&%", "\ta b\r\na b\n"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "Cc", "d#", "é"]) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(rng.randint(1, 150))))
    return texts + ["long " * 5000, " ".join(str(i) for i in range(4000))]


def test_base_counts(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "a b c", 7), (1, None, 7)], "doc_id long, text string, n_words int")
    found = rules.judge(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        expected = _plain("a b c" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    assert rules.judge(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.base_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_estimate_finds_accuracies():
    rng = random.Random(1)
    true = [0.95, 0.9, 0.8, 0.7, 0.92]
    counts = {}
    for _ in range(30000):
        good = 1 if rng.random() < 0.85 else -1
        pattern = tuple(0 if rng.random() < 0.2 else good if rng.random() < a else -good for a in true)
        counts[pattern] = counts.get(pattern, 0) + 1
    prior, found = rules.estimate(counts)
    assert prior == pytest.approx(0.85, abs=0.03)
    assert found == pytest.approx(true, abs=0.04)
    assert rules.estimate({}) == (0.8, [])


def test_clean_text_is_kept_and_junk_is_not(spark):
    rng = random.Random(3)
    clean = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(30)) + "." for _ in range(4))
    junk = lambda: "\n".join(["$$$ BUY### %%% NOW*** " + rng.choice("abc")] * 30)
    docs = spark.createDataFrame([(i, clean() if i % 10 else junk()) for i in range(200)], "doc_id long, text string")
    assert {r.doc_id for r in rules.judge(docs).collect() if r.kept} == {i for i in range(200) if i % 10}
