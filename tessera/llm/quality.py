"""Quality by non-negative positive-unlabelled learning: trusted good documents against unlabelled web text."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, pu

FOLDS, HELD_OUT = 4, 2

#: Bounds of the bins that a share falls in.
SHARES = (0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Bounds of the bins of a number of words, of a mean word size and of a mean line size.
COUNTS = (1, 2, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120, 10240)
SIZES = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 14.0)
_BINS = 32


def measures(text: bytes | None) -> list[tuple[float, tuple[float, ...]]]:
    """Measures of style and the bounds of their bins; an empty text measures 0 throughout."""
    whole = (text or b"").decode("utf-8", "replace")
    words = whole.split()
    n, lines = len(words), [x for x in whole.split("\n") if x.strip()]
    per_word, per_line = max(n, 1), max(len(lines), 1)
    kinds = Counter(words)
    shares = (
        sum(map(str.isupper, words)) / per_word,
        sum(map(str.isalpha, words)) / per_word,
        sum(map(str.istitle, words)) / per_word,
        sum(map(str.isdigit, words)) / per_word,
        sum(w[-1] in "#*$%&|<>" for w in words) / per_word,
        sum(w[-1] in "!?" for w in words) / per_word,
        sum(w[-1] in ".," for w in words) / per_word,
        sum(map(eq, words, words[1:])) / per_word,
        len(kinds) / per_word if n >= 20 else 0.0,
        max(kinds.values(), default=0) / per_word if n >= 20 else 0.0,
        len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1) if n >= 20 else 0.0,
        (len(lines) - len(set(lines))) / per_line,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / per_line,
    )
    sizes = sum(map(len, words)) / per_word
    return [(n, COUNTS), (sizes, SIZES), (n / per_line, COUNTS), *((s, SHARES) for s in shares)]


def features(text: bytes | None) -> np.ndarray:
    """One feature for each measure: the bin that it falls in."""
    return np.asarray([k * _BINS + bisect_right(bounds, value) for k, (value, bounds) in enumerate(measures(text))], dtype=np.int32)


def scorer(model: pu.Model) -> Callable[[bytes | None], float]:
    weights = model.as_dict()
    return lambda text: model.bias + sum(weights.get(int(f), 0.0) for f in features(text))


def score(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a higher score means ``quality = 1`` is likelier,
    but under the sigmoid loss it is no probability.

    Learns from ``labels (doc_id, quality)`` that say 1, outside the held-out fold, and from unlabelled text, from which
    the class prior is estimated; a score depends on the text alone.  A null text is empty.  Without positives every
    score is ``pu.DEFAULT_PRIOR``.  Repeated rows are scored each, rows with a null ``doc_id`` too (never learnt from,
    not held out).  Empty ``docs`` give no rows.  Other columns are ignored, also ones named like those returned.
    """
    model = pu.learn(docs, labels, "quality", features, FOLDS, HELD_OUT, loss="sigmoid", **bounds)
    return pu.judged(pu.score(docs, model, scorer), FOLDS, HELD_OUT)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_nnpu": _query}
ORACLE_SQL: dict[str, str] = {}
