"""Non-negative positive-unlabelled learning of linear models over sparse binary features, in numpy.

Kiryo, Niu, du Plessis and Sugiyama: Positive-Unlabeled Learning with Non-Negative Risk Estimator (2017).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Bounds of the sample that a model is fitted on: positives and unlabelled documents, those of least id hash.
MAX_POSITIVES, MAX_UNLABELLED = 4_000, 12_000
#: Features of a model, and rows that must have one of them.
MAX_FEATURES, MIN_ROWS = 4_096, 4
#: The same for the models that estimate the class prior.
PRIOR_FEATURES = 512
#: Class prior where there is nothing to estimate it from.
DEFAULT_PRIOR = 0.5
#: Score from which label 1 is predicted.
PREDICT_FROM = 0.7


@dataclass(frozen=True)
class Model:
    """``sigmoid(bias + sum of weights of the features that a document has)``; without features the prior."""

    bias: float
    features: np.ndarray  # sorted ids
    weights: np.ndarray
    prior: float = 0.5

    def as_dict(self) -> dict[int, float]:
        return {int(f): float(w) for f, w in zip(self.features, self.weights) if w}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class _Rows:
    """Sparse binary rows over columns 0..width-1, kept by row and by column."""

    def __init__(self, rows: list[np.ndarray], width: int):
        flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int32)
        self._set(len(rows), width, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), flat)

    def _set(self, n: int, width: int, row: np.ndarray, column: np.ndarray) -> None:
        self.n, self.width, self.row, self.column = n, width, row, column
        self.row_starts = np.flatnonzero(np.diff(row, prepend=-1))
        order = np.argsort(column, kind="stable")
        self.by_column = row[order]
        self.column_starts = np.flatnonzero(np.diff(column[order], prepend=-1))
        self.present = column[order][self.column_starts]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.row):
            out[self.row[self.row_starts]] = np.add.reduceat(weights[self.column], self.row_starts)
        return out

    def gradient(self, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.row):
            out[self.present] = np.add.reduceat(slopes[self.by_column], self.column_starts)
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.column, minlength=self.width)

    def _part(self, n: int, width: int, row: np.ndarray, column: np.ndarray) -> _Rows:
        out = _Rows([], 0)
        out._set(n, width, row, column)
        return out

    def narrowed(self, columns: np.ndarray) -> _Rows:
        """Only some columns, renumbered."""
        place = np.full(self.width, -1, np.int32)
        place[columns] = np.arange(len(columns))
        mine = place[self.column] >= 0
        return self._part(self.n, len(columns), self.row[mine], place[self.column[mine]])

    def half(self, which: int) -> _Rows:
        """Every other row."""
        mine = self.row % 2 == which
        return self._part((self.n + 1 - which) // 2, self.width, self.row[mine] // 2, self.column[mine])


#: Loss of a margin and its slope.  The logistic one makes scores estimates of probabilities; under the sigmoid one they
#: are none, only higher for likelier rows, but it is bounded, which keeps the estimate of a small negative risk from drowning in the positives' large margins when most are positive.
LOSSES: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {
    "logistic": (lambda f: np.logaddexp(0, -f), lambda f: -sigmoid(-f)),
    "sigmoid": (lambda f: sigmoid(-f), lambda f: -sigmoid(f) * sigmoid(-f)),
}


def risk_and_slopes(p: np.ndarray, u: np.ndarray, prior: float, loss: str = "logistic") -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk at margins ``p`` (positives) and ``u`` (unlabelled), and its slopes.

    The negative risk, ``E_u[l(-f)] - prior * E_p[l(-f)]``, cannot truly be below zero; where its estimate is, it
    counts as zero and the step goes the other way to undo the overfit.
    """
    value, slope = LOSSES[loss]
    positive = prior * value(p).mean()
    negative = value(-u).mean() - prior * value(-p).mean()
    slope_p = prior * slope(p) / len(p)
    rest_p, rest_u = prior * slope(-p) / len(p), -slope(-u) / len(u)
    if negative >= 0:
        return positive + negative, slope_p + rest_p, rest_u
    return positive, -rest_p, -rest_u


def _counts(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows that have each feature, a few hundred rows at a time to spare memory."""
    out = np.zeros(width, np.int64)
    for at in range(0, len(rows), 256):
        out += np.bincount(np.concatenate(rows[at : at + 256]), minlength=width)
    return out


def telling(features: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, most: int = MAX_FEATURES) -> np.ndarray:
    """The ``most`` of the ``features`` that set positives apart from unlabelled rows the most, sorted; ties go to the smaller id.

    ``in_p`` and ``in_u`` are the rows of either kind that have each feature, ``n_p`` and ``n_u`` all rows.
    """
    share_p, share_u = in_p / n_p, in_u / n_u
    spread = np.sqrt((share_u * (1 - share_u) + 0.5 / n_u) * (1 / n_p + 1 / n_u))
    apart = np.abs(share_p - share_u) / spread * (in_p + in_u >= MIN_ROWS)
    order = np.lexsort((features, -apart))[:most]
    return np.sort(features[order[apart[order] > 2]])


def places(ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where in the sorted ``features`` those of ``ids`` stand that are among them."""
    if not len(features):
        return np.empty(0, np.int64)
    at = np.searchsorted(features, ids)
    at[at == len(features)] = 0
    return at[features[at] == ids]


def _adam(slopes: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int) -> np.ndarray:
    """The weights of least risk among those that Adam passes."""
    weights, first, second = start, np.zeros_like(start), np.zeros_like(start)
    best, least = start.copy(), np.inf
    for step in range(1, rounds + 1):
        risk, slope = slopes(weights)
        if risk < least:
            best, least = weights.copy(), risk
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return best


def _train(p: _Rows, u: _Rows, prior: float | None, penalty: float, rounds: int, loss: str) -> np.ndarray:
    """Weights and bias by the non-negative risk, or without a prior by telling ``p`` from ``u`` alone."""
    start = np.zeros(p.width + 1)
    start[-1] = 0.0 if prior is None else np.log(prior / (1 - prior))

    def slopes(weights: np.ndarray) -> tuple[float, np.ndarray]:
        at_p, at_u = p.margins(weights[:-1]) + weights[-1], u.margins(weights[:-1]) + weights[-1]
        if prior is None:
            risk = np.logaddexp(0, -at_p).mean() + np.logaddexp(0, at_u).mean()
            slope_p, slope_u = -sigmoid(-at_p) / p.n, sigmoid(at_u) / u.n
        else:
            risk, slope_p, slope_u = risk_and_slopes(at_p, at_u, prior, loss)
        return risk, np.append(p.gradient(slope_p) + u.gradient(slope_u) + penalty * weights[:-1], slope_p.sum() + slope_u.sum())

    return _adam(slopes, start, rounds)


def share_of_positives(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of both that were not fitted on.

    Best-bin estimate (Garg, Wu, Smola, Balakrishnan and Lipton: Mixture Proportion Estimation and PU Learning, 2021):
    above any threshold there are at least the positives, so the ratio of the shares above it is an upper bound, best
    where nothing else scores as high; thresholds with few rows are held back by their uncertainty.
    """
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    unsure = 1.01 * (np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p)))
    best = np.argmin((above_u + unsure) / above_p)
    return float(min(above_u[best] / above_p[best], 1.0))


def class_prior(p: _Rows, u: _Rows, loss: str = "logistic", rounds: int = 200) -> float:
    """Estimate of the class prior from positives and unlabelled rows alone.

    Each half of the rows is scored by a model of the other half; both together measure the share.  The first models
    only tell the kinds apart; with the share that they give, two more pairs are fitted by the non-negative risk, which
    sees what among the unlabelled is positive.
    """
    if p.n < 2 or u.n < 2:
        return DEFAULT_PRIOR
    columns = telling(np.arange(p.width), p.counts(), u.counts(), p.n, u.n, PRIOR_FEATURES)
    halves = [(p.narrowed(columns).half(h), u.narrowed(columns).half(h)) for h in (0, 1)]
    prior = None
    for _ in range(3):
        found = []
        for (a, b), other in zip(halves, reversed(halves)):
            weights = _train(a, b, prior, 1e-2 if prior is None else 1e-4, rounds, loss)
            found.append([x.margins(weights[:-1]) + weights[-1] for x in other])
        prior = min(max(share_of_positives(*map(np.concatenate, zip(*found))), 0.01), 0.99)
    return prior


def fit_rows(features: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None, penalty: float = 1e-4, rounds: int = 400, loss: str = "logistic") -> Model:
    """Fit to rows of places in ``features`` by full-batch Adam; without a ``prior`` it is estimated.  Deterministic.

    Without rows of either kind the model has no features and scores the prior.
    """
    p, u = _Rows(positives, len(features)), _Rows(unlabelled, len(features))
    if prior is None:
        prior = class_prior(p, u, loss)
    prior = min(max(prior, 0.01), 0.99)
    if not positives or not unlabelled:
        return Model(float(np.log(prior / (1 - prior))), np.empty(0, np.int64), np.empty(0), prior)
    weights = _train(p, u, prior, penalty, rounds, loss)
    return Model(float(weights[-1]), features, weights[:-1], prior)


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None, most: int = MAX_FEATURES, **settings: float | str) -> Model:
    """Choose features among those of the rows, arrays of distinct small numbers, and fit.  ``learn`` does the same in Spark."""
    features = np.empty(0, np.int64)
    if positives and unlabelled:
        in_p, in_u = (_counts(rows, 1 + max((int(r.max()) for r in (*positives, *unlabelled) if len(r)), default=-1)) for rows in (positives, unlabelled))
        features = telling(np.arange(len(in_p)), in_p, in_u, len(positives), len(unlabelled), most)
    return fit_rows(features, *([places(r, features) for r in rows] for rows in (positives, unlabelled)), prior, **settings)


def fold(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``held_out``; a null id is held out of nothing and learnt from never."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == held_out


def least_hashed(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """``(h, doc_id)`` of the ``most`` distinct ids of least hash.

    Only ids below a hash that several times as many should pass are made distinct; if too few do, it is raised.
    """
    hashed = rows.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    share = 4 * most / max(hashed.count(), 1)
    while True:
        near = hashed if share >= 1 else hashed.filter(F.col("h") < int(share * 2**64) - 2**63)
        found = common.stored(near.distinct().orderBy("h", "doc_id").limit(most).select("h", "doc_id"))
        if share >= 1 or found.count() >= most:
            return found
        share *= 8


def learn(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[bytes | None], np.ndarray], folds: int, held_out: int, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, **settings: float | str) -> Model:
    """Fit on documents labelled 1 and on unlabelled text, none of it of the held-out fold.  Labels of 0 are not used.

    Of the sample the driver is sent ``max_features`` bits a row, so at most 8 MB with the constants given.  Which rows
    are taken depends on their ids alone: a document with contradicting labels counts as positive; of unlike texts
    with one id the one with the least features is taken; a null id is never learnt from.
    """
    apart = ~fold(F.col("doc_id"), folds, held_out)
    positive = least_hashed(labels.filter(apart & (F.col(label) == 1)), max_positives, 1).withColumn("kind", F.lit(1))
    unlabelled = least_hashed(docs.filter(apart), max_unlabelled, 2).withColumn("kind", F.lit(0))
    # At most the two bounds together, whatever the input: small enough to broadcast.
    wanted = common.stored(positive.unionByName(unlabelled))
    sample = docs.select("doc_id", common.text_bytes()).join(F.broadcast(wanted), "doc_id").select("kind", "h", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t)) for t in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["kind", "h", "ids"])

    rows = common.stored(common.map_arrow(sample, run, "kind int, h long, ids array<int>").groupBy("kind", "h").agg(F.min("ids").alias("ids")))
    sizes = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return fit_rows(np.empty(0, np.int64), [], [], **settings)
    counted = rows.select("kind", F.explode("ids").alias("f")).groupBy("f").agg(F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("u")).filter(F.col("p") + F.col("u") >= MIN_ROWS)
    u = F.col("u") / n_u
    # Ranked here by the square of what ``telling`` ranks by, with some to spare against rounding; chosen there.
    rank = F.pow(F.col("p") / n_p - u, F.lit(2)) / (u * (1 - u) + 0.5 / n_u)
    top = counted.orderBy(rank.desc(), "f").limit(2 * max_features).toPandas().sort_values("f")
    chosen = telling(*(top[c].to_numpy(np.int64) for c in ("f", "p", "u")), n_p, n_u, max_features)
    width = -(-max(len(chosen), 1) // 8)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for ids in batch.column(2):
                row = np.zeros(8 * width, np.uint8)
                row[places(ids.values.to_numpy(), chosen)] = 1
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["kind", "h", "bits"])

    sent = common.map_arrow(rows, bits, "kind int, h long, bits binary").toArrow().sort_by([("kind", "descending"), ("h", "ascending")])
    grid = np.frombuffer(b"".join(sent.column("bits").to_pylist()), np.uint8).reshape(-1, width)
    rows_ = [np.flatnonzero(np.unpackbits(row)) for row in grid]
    return fit_rows(chosen, rows_[:n_p], rows_[n_p:], **settings)


def score(docs: DataFrame, model: Model, scorer: Callable[[Model], Callable[[bytes | None], float]]) -> DataFrame:
    """``docs`` (doc_id, text) with the text replaced by its ``score``; one narrow pass."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = scorer(model)
        for batch in batches:
            scores = sigmoid(np.asarray([margin(t) for t in batch.column(1).to_pylist()], dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return common.map_arrow(docs.select("doc_id", common.text_bytes()), run, schema)


def judged(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    """Scores with ``held_out`` and ``predicted``."""
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds, held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
