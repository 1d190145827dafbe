"""Near-duplicates by similarity of word shingles: SimHash anchors propose, whole shingle sets decide.

Fingerprints of the sets are linked by anchor-point covering as in ``simhash``, and what hangs together is compared.  That
alone loses links: sets of Jaccard similarity 0.8 have a cosine of 0.89 and differ in 9.7 of 64 bits on average, where
anchors reach three.  So a second pass proposes more: texts whose sets share ``k`` of all ``n`` shingles agree in one
minimum with probability ``k / n``; a band is the key of ``ROWS`` minima; with 32 bands of 4, two sets of similarity 0.8
share none with probability (1 - 0.8^4)^32 = 5e-8, more similar ones more rarely.  Whatever either pass proposes is compared
by its whole sets, so that no link is an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common, graph, simhash

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
SEED = 42
#: Sets that one group compares at most twice over; a band with more is split into pairs of blocks.
BLOCK = 1024

_FACTORS = np.asarray([xxhash.xxh64_intdigest(b"minimum %d" % k, seed=SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)
_MIX = np.asarray([xxhash.xxh64_intdigest(b"band %d" % k, seed=SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64).reshape(BANDS, ROWS)


def shingles(text: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    tokens = (text or b"").lower().split()  # as the fingerprints do
    if not tokens:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """Keys of the bands of one set; none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _FACTORS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _print(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), seed=SEED)


def prints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """For every row its keys ``k1, k2``, its id, the hash ``print`` of its shingle set, the set's fingerprint ``fp`` and band keys."""
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("k1", "k2", "doc_id", "print", "fp")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(3).to_pylist()]
            keys = [bands(s) for s in sets]
            hashes, fps = (np.asarray(x, dtype=np.uint64).view(np.int64) for x in ([_print(s) for s in sets], [simhash.majority(s) for s in sets]))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes), pa.array(fps), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=schema.names)

    return common.map_arrow(docs.select(*simhash.row_keys(), F.col("doc_id").cast("long"), common.text_bytes()), run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(print, ids)``, the shingle sets as bytes, of the texts whose hash ``wanted (k2)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = {}
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                if (key := _print(found)) not in seen:
                    seen.add(key)
                    fresh[key] = found.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray([*fresh], dtype=np.uint64).view(np.int64)), pa.array([*fresh.values()], pa.binary())], names=["print", "ids"])

    texts = common.pick(docs.select("text", simhash.row_keys()[1]), wanted, ["k2"], "left_semi")
    return common.map_arrow(texts.select(common.text_bytes()), run, "print long, ids binary").groupBy("print").agg(F.first("ids").alias("ids"))


def _stars(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect what is ``similarity`` or more alike, each to the first of its component: a forest, not all pairs."""
    sizes = np.asarray([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marks = np.zeros(1 + max(int(i.max()) for i in ids), bool)
    left, heads, tails = np.arange(1, len(sets)), [], []
    head, frontier, flat = 0, [0], None
    while len(left):
        if not frontier:
            head, left, flat = int(left[0]), left[1:], None
            frontier = [head]
            continue
        if flat is None:
            flat = np.concatenate([ids[k] for k in left])
            starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
        now = frontier.pop()
        marks[ids[now]] = True
        shared = np.add.reduceat(marks[flat], starts, dtype=np.int64)
        marks[ids[now]] = False
        near = shared >= similarity * (sizes[now] + sizes[left] - shared) - 1e-9
        if near.any():
            found = left[near].tolist()
            heads.extend([head] * len(found))
            tails.extend(found)
            frontier.extend(found)
            left, flat = left[~near], None
    return heads, tails


def links(docs: DataFrame, nodes: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``(a, b)`` between ``nodes (print, k2, fp, bands)`` whose components are those of all pairs that are proposed and alike.

    A component of fingerprints is a group like a band.  Groups of the same members are compared once.  One with over
    ``BLOCK`` members is split: each member goes to every pair of blocks with its own block, so that none of its pairs is lost.
    """
    near = graph.components(simhash.links(nodes.groupBy("fp").agg(F.count("*").alias("n")))).select(F.col("node").alias("fp"), "root")
    reached = common.stored(nodes.select("print", "k2", "fp").join(common.stored(near), "fp", "left").select("print", "k2", F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("band")))
    placed = common.stored(nodes.select("print", "k2", F.explode("bands").alias("band")).unionByName(reached))
    alike = placed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("print")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "print")).alias("y")).filter("n > 1")
    crowded = alike.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = common.stored(placed.join(crowded, "band"))
    sets = common.stored(_sets(docs, common.stored(members.select("k2").distinct()), words))
    split = members.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("own"), j) * F.col("blocks") + F.greatest(F.col("own"), j)))
    dealt = split.select("band", F.explode(pairs).alias("pair"), "print").join(sets, "print").select("band", "pair", "print", "ids")
    sorted_ = dealt.repartition("band", "pair").sortWithinPartitions("band", "pair", "print")

    def compared(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        heads, tails = _stars([np.frombuffer(ids, np.uint64) for _, ids in rows], similarity)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in side], pa.int64()) for side in (heads, tails)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for band, pair, key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (band, pair) != group:
                    if len(rows) > 1:
                        yield compared(rows)
                    group, rows = (band, pair), []
                rows.append((key, ids))
        if len(rows) > 1:
            yield compared(rows)

    return common.stored(common.map_arrow(sorted_, compare, "a long, b long").distinct())


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of documents linked by a Jaccard similarity of ``similarity`` or more stays, all columns unchanged.

    Texts without words (null, empty, blank) are copies of each other.  Which row stays, and what becomes of null and
    repeated ids, is as in ``simhash.elected``.  An empty table gives no rows.
    """
    found = common.stored(prints(docs, words))
    # The hash of a text is taken along to find one text of each set again.
    nodes = common.stored(found.groupBy("print").agg(F.min("k2").alias("k2"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    return simhash.elected(docs, found.select("k1", "k2", "doc_id", "print"), links(docs, nodes, words, similarity), "print")
