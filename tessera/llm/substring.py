"""Exact substring deduplication with compressed FM-indexes.

Windows of ``window`` consecutive words that also start in a document with a smaller ``doc_id`` are found in steps:

1. Every document is cut into segments: runs of windows with the same minimizer (the least hash of the word grams of
   half a window).  Equal windows have equal minimizers, so they lie in segments with the same minimizer.
2. Segments whose minimizer no second document has cannot hold such a window and go no further.  Segments with the
   same words form a class; the one of the smallest document stands for it, and one other for all its copies.
3. Classes are dealt to shards by minimizer, by words, so that a shard is bounded.  The documents of a minimizer are
   ranked; for each binary digit of the ranks, a shard indexes the segments with a 0 there and streams those with a 1
   whose higher digits agree.  So any two documents meet once, the smaller in the index, the larger as a query, and
   nothing is searched for in an index that holds it.
4. An index is the Burrows-Wheeler transform in a wavelet matrix of packed bits and a byte a symbol of common prefix
   lengths; suffix order and ranks are dropped.  Backward search gives the matching statistics of a streamed segment:
   the match grows by the word before it, or falls back to the parent interval.  Where it is ``window`` long, the
   window is reported.  Nothing else decides.

A minimizer with very many words is split by documents into blocks of ascending ids.  Each block is searched within
itself as above, and streamed whole against an index of each block before it, so that no pair of segments is lost and
shards stay bounded but for the segments of one document.  Words are compared by 64-bit hashes: a false report needs ``window`` collisions in a row, two unlike texts in one class a
collision of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

WINDOW = 50
#: Words of one shard, about; also the words of one minimizer above which it is split into blocks.
SHARD_WORDS = 300_000
#: Windows of one segment; a longer run of windows with one minimizer makes several.
SEGMENT_WINDOWS = 512

_LAST = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("m", T.LongType()), T.StructField("c", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, lengthened as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b))]) for b in (_BASE, _UNBASE))
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Minimizer, hash of all words, first and last window start of each segment of a document."""
    n, gram = len(hashes), window // 2
    if n < window:
        return (np.empty(0, np.int64),) * 4
    up, down = _Powers.upto(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:n])])
    grams = _mixed((sums[gram:] - sums[:-gram]) * up[: n - gram + 1])
    least = _sliding_min(grams, window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.append(first[1:], n - window + 1) - 1
    parts = (last - first) // SEGMENT_WINDOWS + 1
    if parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, ends = np.repeat(first, parts) + nth * SEGMENT_WINDOWS, np.repeat(last, parts)
        last = np.minimum(ends, first + SEGMENT_WINDOWS - 1)
    content = _mixed((sums[last + window] - sums[first]) * up[first] + (last - first).astype(np.uint64))
    return least[first].view(np.int64), content.view(np.int64), first, last


class FMIndex:
    """Rows of numbers, each closed by a separator, for backward search of matches up to ``depth`` symbols, 255 at most.

    Kept are a wavelet matrix of the Burrows-Wheeler transform (packed bits with a count every 64) and, in a byte a
    symbol, how much each suffix shares with the one before it, with the least of every 64, of every 64 of these and
    so on.  Suffixes are sorted by their first ``depth`` symbols or more, which is all that such a search needs.
    """

    def __init__(self, rows: list[np.ndarray], depth: int):
        self.depth = depth
        lengths = np.asarray([len(r) for r in rows])
        text = np.zeros(int(lengths.sum()) + len(rows), np.int32)  # symbol 0 separates
        inside = np.ones(len(text), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        self.alphabet, symbols = np.unique(np.concatenate(rows), return_inverse=True)
        text[inside] = symbols + 1
        self.size, width = len(text), len(self.alphabet) + 1
        ranks, span = [text], 1
        while span < depth:
            now = ranks[-1].astype(np.int64)
            later = np.zeros_like(now)
            later[: max(0, self.size - span)] = now[span:] + 1
            ranks.append(np.unique(now * (int(now.max()) + 2) + later, return_inverse=True)[1].astype(np.int32))
            span *= 2
        order = np.argsort(ranks[-1], kind="stable").astype(np.int32)
        shared, a, b = np.zeros(self.size - 1, np.int32), order[:-1].astype(np.int64), order[1:].astype(np.int64)
        for rank in reversed(ranks):
            inner = (a < self.size) & (b < self.size)
            same = np.zeros(len(a), bool)
            same[inner] = rank[a[inner]] == rank[b[inner]]
            shared, a, b = shared + same * span, a + same * span, b + same * span
            span //= 2
        del ranks, a, b
        common = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)  # before the first suffix and after the last: nothing
        common[1 : self.size] = np.minimum(shared, depth)
        self.common = [common.reshape(-1, 64)]
        while len(self.common[-1]) > 1:
            least = self.common[-1].min(axis=1)
            self.common.append(np.append(least, np.zeros(-len(least) % 64, np.uint8)).reshape(-1, 64))
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=width))])
        row, self.levels = text[order - 1], []
        for level in range(max(1, (width - 1).bit_length()) - 1, -1, -1):
            bits = (row >> level) & 1
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bits.dtype)).astype(np.uint8), bitorder="little").view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32)
            self.levels.append((level, packed, ones, len(bits) - int(bits.sum())))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        self.firsts = self._down(np.zeros(width, np.int64), np.arange(width))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, packed, ones, zeros in self.levels:
            block = at >> 6
            rank = ones[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + rank, at - rank)
        return at

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with ``symbol`` put before them; empty where the index has none."""
        base = self.counts[symbol] - self.firsts[symbol]
        both = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol])).reshape(2, -1) + base
        return both[0], both[1]

    def shortened(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``size`` symbols of the matches."""
        low, high = np.where(size > 0, low, 0), np.where(size > 0, high, self.size)
        some = np.flatnonzero(size)
        low[some], high[some] = self._seek(low[some], size[some], -1), self._seek(high[some], size[some], 1)
        return low, high

    def parent(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals and lengths of the longest shorter prefixes of the matches of ``size`` that occur in more places."""
        size = np.minimum(size - 1, np.maximum(self.common[0].ravel()[low], self.common[0].ravel()[high]))
        return *self.shortened(low, high, size), size

    def _seek(self, at: np.ndarray, below: np.ndarray, way: int) -> np.ndarray:
        """The nearest place from ``at`` on, backward or forward, where less than ``below`` is shared."""
        place, height, todo = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
        offsets = np.arange(64)
        pick = (lambda good: 63 - good[:, ::-1].argmax(axis=1)) if way < 0 else (lambda good: good.argmax(axis=1))
        for level, table in enumerate(self.common):
            good = table[place[todo] >> 6] < below[todo, None]
            good &= (offsets <= (place[todo] & 63)[:, None]) if way < 0 else (offsets >= (place[todo] & 63)[:, None])
            found = good.any(axis=1)
            hit = todo[found]
            place[hit], height[hit] = (place[hit] & ~63) | pick(good[found]), level
            todo = todo[~found]
            if not len(todo):
                break
            place[todo] = (place[todo] >> 6) + way
        for level in range(int(height.max(initial=0)), 0, -1):
            lanes = np.flatnonzero(height >= level)
            place[lanes] = place[lanes] * 64 + pick(self.common[level - 1][place[lanes]] < below[lanes, None])
        return place

    def matches(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of every run of ``depth`` symbols of the ``queries`` that a row has.

        All queries advance together from their ends.  A query stops where too few symbols are left for such a run.
        """
        lengths = np.asarray([len(q) for q in queries])
        begins = np.cumsum(lengths) - lengths
        flat = np.concatenate(queries)
        symbol = np.searchsorted(self.alphabet, flat)
        symbol = np.where(self.alphabet[np.minimum(symbol, len(self.alphabet) - 1)] == flat, symbol + 1, 0)
        lane = np.flatnonzero(lengths >= self.depth)
        at = lengths[lane] - 1  # the symbol to put before the match, and the match's interval and length
        low, high, size = np.zeros(len(lane), np.int64), np.full(len(lane), self.size), np.zeros(len(lane), np.int64)
        rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(lane):
            full = np.flatnonzero(size == self.depth)
            if len(full):
                rows.append(lane[full])
                places.append(at[full] + 1)
            live = np.flatnonzero((at >= 0) & (at + 1 + size >= self.depth))
            lane, at, low, high, size = lane[live], at[live], low[live], high[live], size[live]
            if not len(lane):
                break
            full = np.flatnonzero(size == self.depth)
            if len(full):  # make room for one more symbol
                size[full] -= 1
                low[full], high[full] = self.shortened(low[full], high[full], size[full])
            next_ = symbol[begins[lane] + at]
            a, b = self.step(low, high, next_)
            good = (next_ > 0) & (b > a)
            low[good], high[good] = a[good], b[good]
            size += good
            at -= good
            unknown = (next_ == 0) | (~good & (size == 0))
            low[unknown], high[unknown], size[unknown] = 0, self.size, 0
            at -= unknown
            short = np.flatnonzero(~good & ~unknown)
            if len(short):
                low[short], high[short], size[short] = self.parent(low[short], high[short], size[short])
        return np.concatenate(rows), np.concatenate(places)


def _spans(row: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """``(row, start, end)`` of the words under the windows that begin in ``row`` at ``at``."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    if not len(row):
        return []
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(row)) - 1
    return [(int(row[s]), int(at[s]), int(at[e]) + window) for s, e in zip(starts, stops)]


def crossed(rows: list[np.ndarray], asked: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(row, start, end)`` of the words of the rows ``asked`` for under a window that one of the others has too."""
    index, queries = np.flatnonzero(~asked), np.flatnonzero(asked)
    if not len(index) or not len(queries):
        return []
    found, at = FMIndex([rows[i] for i in index], window).matches([rows[i] for i in queries])
    return _spans(queries[found], at, window)


def repeated(rows: list[np.ndarray], groups: np.ndarray, owners: np.ndarray, copies: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(row, start, end)`` of the words of ``rows`` under a window that a row of the same group and a smaller owner has too.

    Rows marked as ``copies`` are searched for and not indexed: their words stand in a row of a smaller owner.
    """
    order = np.lexsort((owners, groups))
    new = np.concatenate([[True], groups[order][1:] != groups[order][:-1]])
    step = np.concatenate([[False], (owners[order][1:] != owners[order][:-1]) & ~new[1:]]).cumsum()
    rank = np.empty(len(rows), np.int64)
    rank[order] = step - step[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    name = np.unique(groups, return_inverse=True)[1]
    hits_row, hits_at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for digit in range(int(rank.max()).bit_length()):
        prefix, upper = rank >> (digit + 1), (rank >> digit) & 1 == 1
        pair = np.unique(np.column_stack([name, prefix]), axis=0, return_inverse=True)[1].ravel()
        asked = np.bincount(pair, weights=upper, minlength=len(rows)) > 0
        index_rows, query_rows = np.flatnonzero(~upper & ~copies & asked[pair]), np.flatnonzero(upper)
        if not len(index_rows):
            continue
        # Words of rows with unlike higher digits are told apart, so that only smaller owners can match.
        salt = _mixed(prefix.astype(np.uint64) * _BASE)
        index = FMIndex([rows[i] ^ salt[i] for i in index_rows], window)
        found, at = index.matches([rows[i] ^ salt[i] for i in query_rows])
        hits_row.append(query_rows[found])
        hits_at.append(at)
    return _spans(np.concatenate(hits_row), np.concatenate(hits_at), window)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Per row: its keys, number of words, digest of all words, and segments."""
    schema = T.StructType([T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("cuts", _SEGMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, cuts = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or b"").split()
                counts.append(len(words))
                digests.append(_digest(words))
                cuts.append(segments(word_hashes(words), window))
            flat = [np.concatenate([c[i] for c in cuts]) for i in range(4)]
            struct = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.int32))], names=["m", "c", "first", "last"])
            offsets = np.concatenate([[0], np.cumsum([len(c[0]) for c in cuts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=schema.names)

    return common.map_arrow(docs, run, schema)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without rows that ``wanted (d, h, ...)`` doesn't name, where its ids are few enough to broadcast."""
    return common.pick(docs, wanted.select("d", "h"), ["d", "h"], "left_semi") if wanted.count() <= common.BROADCAST_IDS else docs


def duplicate_spans(docs: DataFrame, cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(d, h, spans)``: word intervals (start, end exclusive) to remove, for rows that have any."""
    parts = cut.select("d", "h", F.explode("cuts").alias("s")).select("d", "h", "s.*")
    # Stored, so that both sides of the join are plain exchanges, of which a hot minimizer's can be split.
    shared = common.stored(parts.groupBy("m").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("m"))
    kept = common.stored(parts.join(shared, "m"))
    # Of each class the segment of the smallest document, and the largest document, which stands for all its copies.
    contents = common.stored(kept.groupBy("m", "c").agg(F.min(F.struct("d", "h", "first", "last")).alias("r"), F.max("d").alias("most")).select("m", "c", "r.*", "most"))

    wanted = common.stored(contents.groupBy("d", "h").agg(F.collect_list(F.struct("m", "c", "first", "last", "most")).alias("cuts")))
    fetched = _texts_of(docs, wanted).join(wanted, ["d", "h"]).dropDuplicates(["d", "h"]).select("d", "_text", "cuts")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, c, d, most, words = [], [], [], [], []
            for doc, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hashes = word_hashes((text or b"").split())
                for s in cuts:
                    m.append(s["m"])
                    c.append(s["c"])
                    d.append(doc)
                    most.append(s["most"])
                    words.append(hashes[s["first"] : s["last"] + window].tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (m, c, d, most)), pa.array(words, pa.binary())], names=["m", "c", "d", "most", "words"])

    size = F.col("last") - F.col("first") + window
    shards = max(1, -(-(contents.agg(F.sum(size)).first()[0] or 0) // SHARD_WORDS))
    hot = common.stored(contents.groupBy("m").agg(F.sum(size).alias("n")).filter(F.col("n") > SHARD_WORDS).select("m", F.ceil(F.col("n") * 2 / SHARD_WORDS).cast("int").alias("blocks")))
    grid = hot.agg(F.max("blocks")).first()[0] or 2
    bounds = F.percentile_approx("d", [k / grid for k in range(1, grid)]).alias("bounds")
    # Stored, so that its true size is known: as a rule it is tiny, and the segments' words are not shuffled to meet it.
    ranges = common.stored(contents.join(hot, "m").groupBy("m").agg(F.first("blocks").alias("blocks"), bounds))
    own = F.floor(F.size(F.filter("bounds", lambda b: b < F.col("d"))) * F.col("blocks") / grid).cast("int")
    place = lambda shard, side: F.struct(shard.cast("long").alias("shard"), F.lit(side).alias("side"))
    within, indexed, asked = 2, 0, 1
    met = lambda j: (
        F.when(j == F.col("own"), place(F.xxhash64("m", j, j), within)).when(j > F.col("own"), place(F.xxhash64("m", "own", j), indexed)).otherwise(place(F.xxhash64("m", j, F.col("own")), asked))
    )
    dealt = (
        common.map_arrow(fetched, extract, "m long, c long, d long, most long, words binary")
        .join(ranges, "m", "left").withColumn("own", own)
        .withColumn("to", F.explode(F.when(F.col("blocks").isNull(), F.array(place(F.pmod(F.xxhash64("m"), F.lit(shards)), within))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), met))))
        .select("to.*", "m", "c", "d", "most", "words")
    )

    def search(group: pa.Table) -> pa.Table:
        m, c, d, most = (group.column(n).to_numpy() for n in ("m", "c", "d", "most"))
        rows = [np.frombuffer(w, "<u8") for w in group.column("words").to_pylist()]
        side = group.column("side").to_numpy()
        copied = np.flatnonzero((most > d) & (side == within))
        mine = np.concatenate([np.arange(len(rows)), copied])
        copies = np.arange(len(mine)) >= len(rows)
        if (side == within).any():
            found = repeated([rows[i] for i in mine], m[mine], np.concatenate([d, most[copied]]), copies, window)
        else:
            found = crossed(rows, side == asked, window)
        row, start, end = (np.asarray([f[i] for f in found], dtype=np.int64) for i in range(3))
        at = mine[row]
        return pa.table({"m": m[at], "c": c[at], "least": d[at], "copy": copies[row], "s": start, "e": end})

    found = common.stored(dealt.groupBy("shard").applyInArrow(search, "m long, c long, least long, copy boolean, s long, e long"))
    # What holds for the first document of a class is found by its own row, what holds for any later one by that of its copies.
    placed = kept.join(found, ["m", "c"]).filter((F.col("d") > F.col("least")) == F.col("copy"))
    return placed.select("d", "h", F.struct((F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e")).alias("span")).groupBy("d", "h").agg(F.collect_set("span").alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts in a document with a smaller ``doc_id``.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text`` (kept words joined by one
    blank; null where nothing was removed, as the text then stands) for every row.  Windows are judged on the input.
    Words are separated by ASCII white space; a null text has none.  Rows that repeat a ``doc_id`` are judged each
    and never against each other.  A null ``doc_id`` counts as the largest.  An empty table gives no rows; other
    columns are ignored.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"), common.text_bytes())
    cut = common.stored(_cut(keyed, window))
    spans = common.stored(duplicate_spans(keyed, cut, window))
    changed = _texts_of(keyed, spans).join(spans, ["d", "h"]).select("d", "_text", "spans")
    fields = [T.StructField("d", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if texts else [])]
    schema = T.StructType(fields)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                keep = np.ones(len(words), bool)
                for s in cuts:
                    keep[s["s"] : s["e"]] = False
                left = [words[i] for i in np.flatnonzero(keep)]
                out.append((len(words), len(words) - len(left), _digest(left), *([b" ".join(left).decode("utf-8", "replace")] if texts else [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), *([pa.string()] if texts else []))))], names=schema.names)

    same = cut.drop("cuts").join(spans.select("d", "h"), ["d", "h"], "left_anti").select("d", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), *([F.lit(None).cast("string").alias("kept_text")] if texts else []))
    both = common.map_arrow(changed, remove, schema).unionByName(same)
    return both.select(F.when(F.col("d") != _LAST, F.col("d")).alias("doc_id"), *both.columns[1:])


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), texts=False)


QUERIES = {"op9_fm_substring": _query}
ORACLE_SQL = {
    "op9_fm_substring": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, start, array_to_string(ws[start:start + 49], ' ') AS words
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS start FROM split WHERE len(ws) >= 50)
), firsts AS (
  SELECT words, min(doc_id) AS least FROM windows GROUP BY words
), covered AS (
  SELECT DISTINCT doc_id, start + k AS pos
  FROM (SELECT doc_id, start FROM windows JOIN firsts USING (words) WHERE least < doc_id), range(0, 50) r(k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM split
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.pos) AS joined
  FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.pos = w.pos WHERE c.pos IS NULL GROUP BY w.doc_id
)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(len(s.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.joined, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
}
