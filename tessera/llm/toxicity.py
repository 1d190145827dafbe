"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic documents against unlabelled text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, pu

FOLDS, HELD_OUT = 3, 1
#: Feature ids are hashes below this.
WIDTH = 1 << 20
#: Words a worker remembers before it starts afresh.
MEMORY = 500_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings, which inflected forms share."""
    parts = [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % WIDTH for p in parts]


def _words(text: bytes | None) -> set[str]:
    return set(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))


def features(text: bytes | None) -> np.ndarray:
    return np.asarray(sorted({f for w in _words(text) for f in word_features(w)}), dtype=np.int32)


def scorer(model: pu.Model) -> Callable[[bytes | None], float]:
    """Margin of a text.  Words without a weighted feature are remembered and skipped by one set difference."""
    weights = model.as_dict()
    plain: set[str] = set()
    telling: dict[str, list[int]] = {}

    def margin(text: bytes | None) -> float:
        words = _words(text)
        fresh = words - plain
        new = fresh.difference(telling)
        if len(plain) + len(telling) + len(new) > MEMORY:
            plain.clear()
            telling.clear()
            fresh = new = words
        for word in new:
            own = [f for f in word_features(word) if f in weights]
            if own:
                telling[word] = own
            else:
                plain.add(word)
        return model.bias + sum(weights[f] for f in sorted({f for w in fresh if w in telling for f in telling[w]}))

    return margin


def score(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; scores estimate the probability of ``toxic = 1``.

    Learns from ``labels (doc_id, toxic)`` that say 1, outside the held-out fold, and from unlabelled text, from which the
    class prior is estimated; a score depends on the text alone.  A null text is empty; without words a document scores
    the model's base rate.  Without positives every score is ``pu.DEFAULT_PRIOR``.  Repeated rows are scored each, rows
    with a null ``doc_id`` too (never learnt from, not held out).  Empty ``docs`` give no rows.  Other columns are
    ignored, also ones named like those returned.
    """
    model = pu.learn(docs, labels, "toxic", features, FOLDS, HELD_OUT, **bounds)
    return pu.judged(pu.score(docs, model, scorer), FOLDS, HELD_OUT)


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns unchanged.  Rows are treated as in ``score``; without positives all stay."""
    model = pu.learn(docs, labels, "toxic", features, FOLDS, HELD_OUT, **bounds)

    def judge() -> Callable[[list], list[bool]]:
        margin = scorer(model)
        return lambda texts: [bool(pu.sigmoid(np.float64(margin(t and t.encode("utf-8", "surrogatepass")))) < pu.PREDICT_FROM) for t in texts]

    return common.keep_rows(docs, judge)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity_nnpu": _query}
ORACLE_SQL: dict[str, str] = {}
