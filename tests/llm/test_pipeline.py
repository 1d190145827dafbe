"""The corpus pipeline against the plain composition of its decisions."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import bpe, decontaminate, pii, simhash, toxicity


def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(i, _sentence(rng, 25)) for i in range(10)]
    docs, labels = [], []
    for i in range(400):
        text = _sentence(rng, rng.randint(30, 90))
        kind = i % 8
        if kind == 1:
            text = text.replace(" ", " zotig ", 3)
        if kind == 2 and docs:
            text = docs[i - 2][1]
        if kind == 3:
            text += "\n" + rng.choice(items)[1]
        if kind == 4:
            text += f" mail a{i}@b.example.com or token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\""
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(kind == 1)))
    docs += [(400, None, None, None, None), (401, "", "en", "x", 0), (None, "no id here", "en", "x", 10), docs[0], docs[7], (402, _sentence(rng, 60_000), "en", "x", 1)]
    clash = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score int, k1 string")
    clash.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages_and_run(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    scores = {r.doc_id: r.predicted for r in toxicity.score(frame, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [d for d in docs if not scores[d[0]]]
    assert 0 < len(docs) - len(left) < 80 and all(d[0] % 8 == 1 for d in docs if scores[d[0]] and d[0] is not None)
    seen, kept = [], []
    for d in sorted(left, key=lambda d: (d[0] is None, d[0] or 0)):
        print_ = simhash.fingerprint((d[1] or "").encode())
        if d[0] is None or not any(bin(print_ ^ p).count("1") <= 3 for p in seen):
            kept.append(d)
        seen.append(print_)
    assert len(left) - len(kept) >= 40
    clean = []
    for d in kept:
        words = decontaminate.words(d[1])
        text = f" {' '.join(words)} "
        if not any(f" {item} " in text for _, item in items):
            clean.append(d)
    field = pii.default_field()
    expected = {}
    for doc_id, text, *_ in clean:
        text = pii.redacted(text or "", pii.all_spans([text or ""], field)[0][1])
        ids = bpe.encode(text, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
        expected[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids)
    found = corpus_pipeline.run(spark, folder).collect()
    assert len(found) == len(clean)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.token_ids) for r in found} == expected
    assert not any("@" in str(v) for v in expected)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == columns


def test_empty_documents(spark, tables):
    folder, _, _ = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
