"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 65_536

# Between an ASCII letter or digit and a blank or line feed no match of the pattern goes on: only white space may
# follow white space inside one match, and a run of white space begins at the cut in either case.
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank), once per process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe boundaries into pieces of about ``size`` characters; without one, the rest stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def encode(text: str, rank_file: str, pattern: str) -> list[int]:
    """Ids of ``text``, special tokens never recognised."""
    own = encoder(rank_file, pattern)
    return [i for piece in pieces(text) for i in own.encode_ordinary(piece)]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every text: the columns ``keep``, ``token_ids`` (array of int) and ``n_tokens`` (long).

    One narrow pass, no shuffle.  A null text counts as empty and has no ids; repeated rows are encoded each; other
    columns are ignored.
    """
    ids = T.StructType([*(docs.schema[k] for k in keep), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = [np.asarray(encode(t or "", rank_file, pattern), dtype=np.int32) for t in batch.column(len(keep)).to_pylist()]
            sizes = np.asarray([len(x) for x in encoded], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([*encoded, np.empty(0, np.int32)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=ids.names)

    return common.map_arrow(docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string")), run, ids)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Raw bytes that ``token_ids`` stand for, as column ``decoded`` (binary, not necessarily UTF-8); null ids give no bytes."""
    schema = T.StructType([*(encoded.schema[k] for k in keep), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for batch in batches:
            decoded = [own.decode_bytes(ids or []) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(decoded, pa.binary())], names=schema.names)

    return common.map_arrow(encoded.select(*(F.col(f"`{k}`") for k in keep), "token_ids"), run, schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again: ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256`` (the decoded bytes) and, if asked for, ``token_ids``.

    Without ids a text is handled piece by piece, so that a very long one needs no list of all its ids.  Rows are
    treated as in ``encode_documents``; an empty text has the digest of no bytes.
    """
    own_fields = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else []))]
    schema = T.StructType([*(docs.schema[k] for k in keep), *own_fields])
    types = (pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else []))

    def digests(text: str, own: tiktoken.Encoding, decimal: list[bytes]) -> tuple:
        n, ids_hash, bytes_hash, parts = 0, hashlib.sha256(), hashlib.sha256(), []
        for piece in pieces(text):
            ids = own.encode_ordinary(piece)
            if ids:
                ids_hash.update((b"," if n else b"") + b",".join([decimal[i] for i in ids]))
                bytes_hash.update(own.decode_bytes(ids))
                n += len(ids)
                if with_ids:
                    parts.append(np.asarray(ids, dtype=np.int32))
        ids = (np.concatenate([np.empty(0, np.int32), *parts]),) if with_ids else ()
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest(), *ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        decimal = [b"%d" % i for i in range(own.max_token_value + 1)]
        for batch in batches:
            rows = [digests(t or "", own, decimal) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return common.map_arrow(docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string")), run, schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": _query}
ORACLE_SQL: dict[str, str] = {}
