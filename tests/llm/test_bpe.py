"""Byte-level BPE against the library on whole texts, and exact round trips."""

import hashlib

import public_tokenizers
import pytest

from tessera.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "a", "Two words, it's  spaced\n\n  out \t\r\n", "éß中文 \U0001f600 <|endoftext|>", "ab  cd \n x1 " * 3000, "z" * 5000, " " * 5000, "end. \n\n\n   "]


def test_pieces_change_nothing():
    own = bpe.encoder(RANKS, PATTERN)
    for text in TEXTS:
        for size in (1, 7, 100, 65_536):
            parts = list(bpe.pieces(text or "", size))
            assert "".join(parts) == (text or "")
            assert [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text or "")


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x y", "clash"), (1, "", "clash")], "doc_id long, text string, n_tokens string")
    own = bpe.encoder(RANKS, PATTERN)
    expected = []
    for doc, text, _ in docs.collect():
        ids = own.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, bpe.round_trip(docs, RANKS, PATTERN).collect()), key=key) == sorted(expected, key=key)
    encoded = bpe.encode_documents(docs, RANKS, PATTERN)
    decoded = bpe.decode_documents(encoded, RANKS, PATTERN)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in decoded.collect()), key=key) == sorted(((d, (t or "").encode()) for d, t, _ in docs.collect()), key=key)
    assert [r.n_tokens for r in encoded.collect()] == [len(own.encode_ordinary(t or "")) for _, t, _ in docs.collect()]
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_missing_rank_file():
    with pytest.raises(FileNotFoundError):
        bpe.encoder("/nowhere", PATTERN)
