"""Near-duplicates by Jaccard similarity against all pairs of plain Python sets."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import similar, simhash


def _set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    return a == b or bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def _kept(rows):
    """Smallest id of each component, over all pairs."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def _corpus(seed, bases, copies):
    """Texts and copies of them with a few words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([3, 7, 30, 60, 120, 300]))]
        for _ in range(rng.choice(copies)):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    rng.shuffle(texts)
    return list(enumerate([*texts, "", None, " \n"]))


def test_the_stage_equals_all_pairs_of_sets(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)  # so that bands are split, too
    rows = _corpus(3, 60, [1, 2, 3, 40])
    expected = _kept(rows)
    assert len(expected) < len(rows) - 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == expected
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    far = [i for i in prints if i not in expected and not any(bin(prints[i] ^ prints[j]).count("1") <= 3 for j in prints if j != i)]
    assert far  # copies that three bits don't tell


def test_each_row_is_judged_by_its_own_text(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [
        (3, text("a"), "x"), (5, text("a"), "y"), (5, text("b"), "x"),  # 5 has a copy of 3 and a text of its own
        (7, text("c"), "z"), (7, text("c"), "b"), (7, text("d"), "x"), (8, text("d"), "x"),
        (None, text("a"), "x"), (None, text("e"), "x"), (None, text("e"), "x"), (None, text("f"), "y"), (9, "", "x"), (10, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `k1` string")
    kept = similar.keep_one(docs)
    assert kept.schema == docs.schema
    expected = [(3, text("a"), "x"), (5, text("b"), "x"), (7, text("c"), "b"), (7, text("d"), "x"), (None, text("e"), "x"), (None, text("f"), "y"), (9, "", "x")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(expected, key=str)
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == sorted(expected, key=str)
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_fingerprints_propose_as_well(spark, monkeypatch):
    rows = _corpus(5, 30, [1, 2, 5])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "bands", lambda found: np.empty(0, np.int64))
    alone = {r.doc_id for r in similar.keep_one(docs).collect()}
    assert set(_kept(rows)) < alone < {i for i, _ in rows}  # links of the anchors only, all of them true ones


def test_similarity_of_exactly_four_fifths_counts(spark):
    words = [f"w{i}" for i in range(12)]  # eight shingles; with two words more there are ten
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x", "y"])), (3, " ".join([*words[1:], "p", "q"]))], "doc_id long, text string")
    assert _kept([(r.doc_id, r.text) for r in docs.collect()]) == [1, 3]
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [1, 3]


def test_sets_of_the_threshold_share_a_band():
    rng = np.random.default_rng(1)
    for size in (5, 10, 100):  # one fifth of the shingles of the larger set are its own
        shared = 0
        for _ in range(1000):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            here, there = similar.bands(a), similar.bands(a[rng.permutation(size)[: size * 4 // 5]])
            assert (here == there).any()
            shared += (here == there).sum()
        assert 0.39 < shared / 1000 / similar.BANDS < 0.43  # 0.8^4
