"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their halves.  In each
half the codewords of the perfect Hamming code of length 31 (covering radius one) are the anchors.  A fingerprint is
replicated to every anchor within covering radius plus that half's threshold, 1 + 1 = 2: its own nearest anchor and
at most fifteen more.  Whichever of a linked pair is taken first, the other one is then found at its nearest anchor.
Fingerprints are compared anchor by anchor over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common, graph

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that one group compares at most twice over; an anchor with more is split into pairs of blocks.
BLOCK = 2048

_HALF = 31
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one UTF-8 text as an unsigned number; 0 without words."""
    tokens = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the ``hashes``; 0 without any."""
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), 8).astype(np.int64) + np.arange(8) * 256
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` as signed long.  Null and empty texts have fingerprint 0."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=schema.names)

    return common.map_arrow(docs.select(F.col("doc_id"), common.text_bytes()), run, schema)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchor keys of all anchors within distance two of each half of each fingerprint."""
    rows, keys = [], []
    positions = np.arange(1, _HALF + 1, dtype=np.uint64)
    for half in range(2):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = np.bitwise_xor.reduce(np.where((word[:, None] >> (positions - np.uint64(1))) & np.uint64(1), positions, np.uint64(0)), axis=1)
        tag = np.uint64(half << 32)
        whole = syndrome == 0
        rows.append(np.flatnonzero(whole))
        keys.append(word[whole] | tag)
        # Distance one: flip the bit that the syndrome names.  Distance two: flip i and j with i ^ j = syndrome.
        rest = np.flatnonzero(~whole)
        s, w = syndrome[rest][:, None], word[rest][:, None]
        other = positions[None, :] ^ s
        flips = (np.uint64(1) << (positions[None, :] - np.uint64(1))) ^ np.where(other > 0, np.uint64(1) << (np.maximum(other, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        take = (other == 0) | (positions[None, :] < other)
        r, c = np.nonzero(take)
        rows.append(rest[r])
        keys.append((w ^ flips)[r, c] | tag)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _stars(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``max_bits`` of each other, each to the first of its component: a forest, not all pairs."""
    left, heads, tails = members, [], []
    while len(left) > 1:
        head, left = left[0], left[1:]
        frontier = [head]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= max_bits
            if near.any():
                found = left[near]
                heads.append(np.full(len(found), head))
                tails.append(found)
                frontier.extend(found)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *heads]), np.concatenate([none, *tails])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``distinct (fp)`` within ``max_bits`` (3 at most).

    An anchor with over ``BLOCK`` members is split: each member goes to every pair of blocks with its own block, so
    that no group holds more than about twice ``BLOCK`` and none of its pairs is lost.
    """
    if max_bits > 3:
        raise ValueError("the anchors cover at most three differing bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["anchor", "fp"])

    placed = common.stored(common.map_arrow(distinct.select("fp"), replicate, "anchor long, fp long"))
    crowded = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    split = placed.join(crowded, "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("own"), j) * F.col("blocks") + F.greatest(F.col("own"), j)))
    dealt = split.select("anchor", F.explode(pairs).alias("pair"), "fp")
    sorted_ = dealt.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            now = now if rest is None else np.concatenate([rest, now])
            starts = _starts(now)
            rest = now[starts[-1] :]
            yield _compared(now[: starts[-1]], starts[:-1], max_bits)
        if rest is not None:
            yield _compared(rest, _starts(rest), max_bits)

    return common.stored(common.map_arrow(sorted_, compare, "a long, b long"))


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(1, np.int64)


def _compared(rows: np.ndarray, starts: np.ndarray, max_bits: int) -> pa.RecordBatch:
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    fps = rows[:, 2].copy().view(np.uint64)
    ends = np.append(starts[1:], len(rows))
    pair = starts[ends - starts == 2]
    near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= max_bits] if len(pair) else pair
    a.append(fps[near])
    b.append(fps[near + 1])
    for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        heads, tails = _stars(fps[start:end], max_bits)
        a.append(heads)
        b.append(tails)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``max_bits`` differing bits, itself
    included.  Texts without words (null, empty, blank) share fingerprint 0 and are linked like any other.  Rows that
    repeat a ``doc_id`` are returned each; a null ``doc_id`` is linked but never names a component unless nothing
    else does, when ``component_id`` is null.  An empty table gives no rows; other columns are ignored.
    """
    prints = common.stored(fingerprints(docs, words))
    nodes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = common.stored(graph.components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root"))
    linked = roots.join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("reached"))
    reached = roots.join(least, "root").select("fp", "reached")
    # Stored, so that both sides of the last join are plain exchanges, of which a hot fingerprint's can be split.
    classes = common.stored(nodes.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of fingerprints stays, all columns unchanged; see ``elected`` for which."""
    prints = common.stored(common.map_arrow(_keyed(docs), _fingerprinted(words), "k1 long, k2 long, doc_id long, fp long"))
    return elected(docs, prints, links(prints.select("fp").distinct(), max_bits), "fp")


def _keyed(docs: DataFrame) -> DataFrame:
    """What tells a row apart, its id, and its text as bytes."""
    return docs.select(*row_keys(), F.col("doc_id").cast("long"), common.text_bytes())


def _fingerprinted(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([fingerprint(t, words) for t in batch.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["k1", "k2", "doc_id", "fp"])

    return run


def row_keys() -> tuple[Column, Column]:
    """128 bits that tell rows of unlike ids or texts apart; null is a value of its own."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias("k1"), F.xxhash64(F.col("text").isNull(), "text").alias("k2")


def elected(docs: DataFrame, rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` less all but one of each component of ``key``, linked by ``edges (a, b)``.

    ``rows (k1, k2, doc_id, key)`` has the key of every row of ``docs``.  Each row is judged by its own text: of a
    component the row of the smallest ``doc_id`` stays, null ones last; of unlike texts with one ``doc_id`` that of
    the smallest text hash; of rows equal in both the one whose other columns come first.
    """
    roots = common.stored(graph.components(edges).select(F.col("node").alias(key), "root"))
    # One entry for each distinct id and text; copies of a text are met by their key, which AQE can split.
    distinct = common.stored(rows.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first(key).alias(key), F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k2", "k1")
    best = distinct.groupBy(key).agg(F.min(order).alias("best")).join(roots, key, "left").withColumn("root", F.coalesce("root", key))
    first = best.groupBy("root").agg(F.min("best").alias("first"))
    winners = common.stored(best.join(first, "root").select(key, F.col("first.k1").alias("w1"), F.col("first.k2").alias("w2")))
    odd = common.stored(distinct.join(winners, key).withColumn("kept", (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).filter("NOT kept OR n > 1").select("k1", "k2", "kept"))
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), *row_keys())
    kept = common.pick(keyed, odd.filter("NOT kept").select("k1", "k2"), ["k1", "k2"], "left_anti")
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    repeated = odd.filter("kept").select("k1", "k2")
    if repeated.isEmpty():
        return kept.select(*columns)
    once = common.pick(kept, repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min(F.struct(*(f"c{i}" for i in range(len(columns))))).alias("r")).select("r.*")
    return common.pick(kept, repeated, ["k1", "k2"], "left_anti").drop("k1", "k2").unionByName(once).select(*columns)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_anchor": _query}
ORACLE_SQL: dict[str, str] = {}
