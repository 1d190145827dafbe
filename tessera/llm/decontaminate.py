"""Benchmark decontamination by greedy string tiling with a running Karp-Rabin hash.

Words are hashed in runs of the least tile length; runs that a document shares with a benchmark item are the seeds.
An item goes further only if its words under seeds would do.  Seeds that follow one another on a diagonal make the
longest common matches.  The longest match that touches nothing marked is marked, again and again; what a mark leaves
of an overlapping match stays in the contest.  The share of an item under marks is its coverage, whatever the order of
the tiles in the document.  Where repetition makes more seeds than a document has words many times over, the longest
match is sought by its length in the ranks of all runs instead, with the same marks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Words of the least tile; an item of fewer words is one tile.
MIN_TILE = 5
#: Share of an item under tiles from which a document counts as contaminated by it.
MIN_COVERAGE = 0.5
#: Benchmark characters that are broadcast at once; a larger benchmark is taken in blocks, a scan of the documents each.
BLOCK_CHARS = 8_000_000

#: Pairs of places that are enumerated at once, and for one item and document; with more the ranks are used.
PAIRS_AT_ONCE, PAIRS_OF_ITEM = 500_000, 20_000

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of every run of ``length`` ids."""
    n = max(0, len(ids) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + ids[k : k + n]
    return out


def _expanded(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from ``low`` on, ``sizes`` many each, in a row."""
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


@dataclass(frozen=True)
class Runs:
    """All runs of ``length`` words of the items whose least tile that is, sorted by hash."""

    length: int
    hashes: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray


@dataclass(frozen=True)
class Index:
    """A block of the benchmark: word ids of its items and the places of each run's hash."""

    vocabulary: dict[str, int]
    item_ids: np.ndarray
    items: list[np.ndarray]
    sizes: np.ndarray
    words: np.ndarray  # of all items in a row
    runs: list[Runs]

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], min_tile: int = MIN_TILE) -> Index:
        vocabulary: dict[str, int] = {}
        items = [np.asarray([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], dtype=np.uint64) for _, t in rows]
        sizes = np.asarray([len(i) for i in items], dtype=np.int64)
        runs = []
        for length in np.unique(np.minimum(sizes[sizes > 0], min_tile)).tolist():
            of = np.flatnonzero(np.minimum(sizes, min_tile) == length)
            found = [rolling(items[i], length) for i in of]
            hashes = np.concatenate(found)
            order = np.argsort(hashes, kind="stable")
            places = np.concatenate([np.arange(len(f)) for f in found])
            runs.append(Runs(length, hashes[order], np.repeat(of, [len(f) for f in found])[order], places[order]))
        return cls(vocabulary, np.asarray([i for i, _ in rows], dtype=np.int64), items, sizes, np.concatenate([*items, np.empty(0, np.uint64)]), runs)

    def covered(self, text: str | None, min_coverage: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """Id, coverage and tiles of each item of which ``text`` covers enough."""
        tokens = words(text)
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), dtype=np.uint64, count=len(tokens))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for runs in self.runs:
            for item, marks in self._marked(ids, known, runs, min_coverage):
                coverage = sum(m[2] for m in marks) / int(self.sizes[item])
                if coverage >= min_coverage:
                    yield int(self.item_ids[item]), coverage, marks

    def _marked(self, ids: np.ndarray, known: np.ndarray, runs: Runs, min_coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items that may be covered enough and their tiles."""
        length = runs.length
        if len(ids) < length:
            return
        at = np.flatnonzero(known[length:] - known[:-length] == length)
        found = rolling(ids, length)[at] if len(at) else np.empty(0, np.uint64)
        hit = runs.hashes[np.minimum(np.searchsorted(runs.hashes, found), len(runs.hashes) - 1)] == found
        if not hit.any():
            return
        at, found = at[hit], found[hit]
        distinct, which, times = np.unique(found, return_inverse=True, return_counts=True)
        low = np.searchsorted(runs.hashes, distinct)
        sizes = np.searchsorted(runs.hashes, distinct, side="right") - low
        row, of = _expanded(low, sizes), np.repeat(np.arange(len(distinct)), sizes)
        order = np.lexsort((runs.place_of[row], runs.item_of[row]))
        item, place, of = runs.item_of[row][order], runs.place_of[row][order], of[order]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        width = np.full(len(item), length)
        width[:-1] = np.where(item[1:] == item[:-1], np.minimum(place[1:] - place[:-1], length), length)
        able = np.add.reduceat(width, first) / self.sizes[item[first]] >= min_coverage
        pairs = np.add.reduceat(times[of], first)
        last = np.append(first[1:], len(item))
        by_hash, begin = np.argsort(which, kind="stable"), np.cumsum(times) - times

        few = np.flatnonzero(able & (pairs <= PAIRS_OF_ITEM))
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) // PAIRS_AT_ONCE)) + 1) if len(few) else ():
            rows = _expanded(first[part], last[part] - first[part])
            times_ = times[of[rows]]
            q, p = np.repeat(place[rows], times_), at[by_hash[_expanded(begin[of[rows]], times_)]]
            yield from self._from_seeds(ids, np.repeat(item[rows], times_), q, p, length)
        for k in np.flatnonzero(able & (pairs > PAIRS_OF_ITEM)):
            mine = np.zeros(len(distinct), bool)
            mine[of[first[k] : last[k]]] = True
            kept = np.zeros(len(ids) + 1, np.int64)
            np.add.at(kept, at[mine[which]], 1)
            np.add.at(kept, at[mine[which]] + length, -1)
            number = int(item[first[k]])
            yield number, tiles_by_length(self.items[number], np.where(np.cumsum(kept)[:-1] > 0, ids, 0), length)

    def _from_seeds(self, ids: np.ndarray, item: np.ndarray, q: np.ndarray, p: np.ndarray, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Tiles of the items whose seeds ``(item, q, p)`` are; the words of each seed are compared."""
        starts = np.cumsum(self.sizes) - self.sizes
        same = np.ones(len(q), bool)
        for k in range(length):
            same &= self.words[starts[item] + q + k] == ids[p + k]
        item, q, p = item[same], q[same], p[same]
        if not len(item):
            return
        order = np.lexsort((q, p - q, item))
        item, q, p = item[order], q[order], p[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (q[1:] != q[:-1] + 1)])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(item))) + length - 1
        begin = np.flatnonzero(np.concatenate([[True], item[first][1:] != item[first][:-1]]))
        numbers, q, p, sizes = item[first][begin].tolist(), q[first].tolist(), p[first].tolist(), sizes.tolist()
        for number, a, b in zip(numbers, begin.tolist(), [*begin[1:].tolist(), len(first)]):
            yield number, [(q[a], p[a], sizes[a])] if b - a == 1 else tiles(int(self.sizes[number]), zip(q[a:b], p[a:b], sizes[a:b]), length)


def tiles(size: int, matches: Iterable[tuple[int, int, int]], min_tile: int) -> list[tuple[int, int, int]]:
    """Marked tiles ``(place in item, place in document, length)`` of the longest common ``matches`` with an item of
    ``size`` words, longest first; ties to the earlier place in the item, then in the document."""
    heap = [(-n, q, p) for q, p, n in matches]
    heapq.heapify(heap)
    marked_item, marked_doc, marks = np.zeros(size, bool), set(), []
    while heap:
        length, q, p = heapq.heappop(heap)
        free = [not marked_item[q + k] and p + k not in marked_doc for k in range(-length)]
        if all(free):
            marked_item[q : q - length] = True
            marked_doc.update(range(p, p - length))
            marks.append((q, p, -length))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_tile:
                    heapq.heappush(heap, (start - k, q + start, p + start))
                start = None
    return marks


def tiles_by_length(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """The same marks from the words alone (0: none of the benchmark's), without pairs of places.

    Runs of 1, 2, 4 words and so on are ranked once.  Two runs of any length are equal if their first and their last
    such part are; the greatest length of which an unmarked run of both is equal is found by bisection.
    """
    m, n = len(item), len(item) + 1 + len(doc)
    ranks = [np.unique(np.concatenate([item, [0], doc]), return_inverse=True)[1]]
    while 2 ** len(ranks) <= m:
        span = 2 ** (len(ranks) - 1)
        now = np.zeros(n, np.int64)
        now[: n - span] = ranks[-1][: n - span] * n + ranks[-1][span:]
        ranks.append(np.unique(now, return_inverse=True)[1])
    free = np.concatenate([np.ones(m, bool), [False], doc > 0])
    marks: list[tuple[int, int, int]] = []
    most = m
    while True:
        stops = np.append(np.flatnonzero(~free), n)
        room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)  # unmarked words from each place on

        def first(length: int, room: np.ndarray = room) -> tuple[int, int] | None:
            level = length.bit_length() - 1
            able = np.flatnonzero(room >= length)
            key = ranks[level][able] * n + ranks[level][able + length - 2**level]
            inner = np.searchsorted(able, m)
            found = np.flatnonzero(np.isin(key[:inner], key[inner:]))
            return (int(able[found[0]]), int(able[inner:][key[inner:] == key[found[0]]][0]) - m - 1) if len(found) else None

        low, high, best = min_tile, most, None
        while low <= high:
            middle = (low + high) // 2
            if place := first(middle):
                best, low = (*place, middle), middle + 1
            else:
                high = middle - 1
        if best is None:
            return marks
        marks.append(best)
        q, p, most = best
        free[q : q + most] = False
        free[m + 1 + p : m + 1 + p + most] = False


def blocks(benchmark: DataFrame, min_tile: int = MIN_TILE) -> Iterator[Broadcast[Index]]:
    """Indexes of the benchmark, of at most about ``BLOCK_CHARS`` characters each, broadcast one by one."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index.build([(-1 if r.item_id is None else r.item_id, r.text) for r in rows], min_tile))


def matches(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(doc_id, item_id, coverage, tiles)`` for every pair with at least ``min_coverage`` of the item under tiles.

    ``tiles`` are (place in item, place in document, length) in words: lower-case runs of letters, digits and
    underscores.  An item of fewer than ``min_tile`` words is one tile and matches as a whole; one without words
    never does.  Null texts are empty; unlike texts of one ``item_id`` are items of their own, equal rows one item; a null
    ``item_id`` is -1.  Empty tables give no rows.  Each block of the benchmark takes one scan of the documents.
    """
    names = ("item", "doc", "length")
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([(n, pa.int32()) for n in names])))])
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for index in blocks(benchmark, min_tile):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast[Index] = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                out = [{"doc_id": d, "item_id": i, "coverage": c, "tiles": [dict(zip(names, m)) for m in marks]} for d, t in pairs for i, c, marks in index.value.covered(t, min_coverage)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        parts.append(common.map_arrow(source, run, "doc_id long, item_id long, coverage double, tiles array<struct<item:int,doc:int,length:int>>"))
    return reduce(DataFrame.unionByName, parts)


def judge(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, contaminated, n_items, item_id`` (of the highest coverage, ties to the smallest
    id; null if none) and ``coverage`` (0 if none reaches ``min_coverage``).

    Rows that share a ``doc_id``, null included, are judged together.  Other columns are ignored.
    """
    found = common.stored(matches(docs, benchmark, min_tile, min_coverage).drop("tiles"))
    best = found.groupBy(F.col("doc_id").alias("hit")).agg(F.count_distinct("item_id").alias("n"), F.max(F.struct("coverage", (-F.col("item_id")).alias("less"))).alias("top"))
    rows = docs.select(F.col("doc_id").cast("long")).join(best, F.col("doc_id").eqNullSafe(F.col("hit")), "left")
    return rows.select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("top.less")).alias("item_id"), F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, all columns unchanged; each row is judged by its own text."""
    for index in blocks(benchmark, min_tile):

        def clean(index: Broadcast[Index] = index) -> Callable[[list], list[bool]]:
            return lambda texts: [next(index.value.covered(t, min_coverage), None) is None for t in texts]

        docs = common.keep_rows(docs, clean)
    return docs


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_string_tiling": _query}
ORACLE_SQL: dict[str, str] = {}
