"""FM-index substring dedup against all windows by brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import common, substring


def _plain(rows, window):
    """Kept words of each (doc_id, words)."""
    first = {}
    for doc, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if doc is None else doc)
    out = []
    for doc, words in rows:
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (2**63 - 1 if doc is None else doc):
                keep[i : i + window] = [False] * window
        out.append([w for w, k in zip(words, keep) if k])
    return out


def _corpus(seed, docs, vocabulary, passages):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randint(30, 140))] for _ in range(passages)]
    rows = []
    for i in range(docs):
        words = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared)
        rows.append((i, words))
        if rng.random() < 0.2:
            rows[-1] = (i, list(rng.choice(rows)[1]))
    return rows


def _shards(seed, window):
    rng = random.Random(seed)
    for _ in range(20):
        letters = rng.choice([2, 3, 50])
        base = [rng.randrange(letters) for _ in range(4 * window + 40)]
        rows = []
        for _ in range(rng.randint(1, 14)):
            at, size = rng.randrange(len(base) - window), rng.randint(window, window + 30)
            row = base[at : at + size] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(size)]
            if rng.random() < 0.3:
                row[rng.randrange(len(row))] = 99
            if len(row) >= window:
                rows.append(np.asarray(row, dtype=np.uint64))
        if rows:
            yield rows, np.asarray([rng.randrange(6) for _ in rows], dtype=np.int64)


@pytest.mark.parametrize("window", [1, 2, 3, 8, 50])
def test_index_reports_what_all_windows_report(window):
    for rows, owners in _shards(window, window):
        found = [np.zeros(len(r), bool) for r in rows]
        for row, start, end in substring.repeated(rows, np.zeros(len(rows), np.int64), owners, np.zeros(len(rows), bool), window):
            found[row][start:end] = True
        for i, r in enumerate(rows):
            expected = np.zeros(len(r), bool)
            for at in range(len(r) - window + 1):
                mine = r[at : at + window].tobytes()
                if any(owners[j] < owners[i] and any(o[k : k + window].tobytes() == mine for k in range(len(o) - window + 1)) for j, o in enumerate(rows)):
                    expected[at : at + window] = True
            assert (found[i] == expected).all()


@pytest.mark.parametrize("depth", [1, 2, 5, 50])
def test_matching_statistics_of_foreign_texts(depth):
    rng = random.Random(depth)
    for rows, _ in _shards(depth, depth):
        index = substring.FMIndex(rows, depth)
        queries = [np.asarray([rng.choice([0, 1, 1, 2, 7, 99]) for _ in range(rng.randint(1, 40))], np.uint64) for _ in range(5)] + [np.concatenate([rows[0][-3:], rows[0], rows[-1][:depth]])]
        expected = sorted((q, at) for q, x in enumerate(queries) for at in range(len(x) - depth + 1) if any(x[at : at + depth].tobytes() == o[k : k + depth].tobytes() for o in rows for k in range(len(o) - depth + 1)))
        row, at = index.matches(queries)
        assert sorted(zip(row.tolist(), at.tolist())) == expected


def test_the_index_is_compressed_and_holds_no_query():
    rng = np.random.default_rng(5)
    vocabulary = rng.integers(0, 2**63, 2000).astype(np.uint64)
    rows = [vocabulary[rng.integers(0, 2000, 62)] for _ in range(3000)]
    index = substring.FMIndex(rows, 50)
    arrays = [a for x in vars(index).values() for a in (x if isinstance(x, list) else [x]) for a in (a if isinstance(a, tuple) else [a]) if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in arrays) < 5 * index.size
    assert max(a.size for a in arrays if a.dtype.itemsize == 8) < index.size / 16
    assert not len(index.matches([vocabulary[rng.integers(0, 2000, 62)] for _ in range(50)])[0])


def test_the_search_decides(spark, monkeypatch):
    rows = _corpus(3, 60, 4000, 4)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert any(r.n_removed for r in substring.deduplicate(docs).collect())
    found = [np.ones(60, np.uint64), np.ones(60, np.uint64)]
    shard = (found, np.zeros(2, np.int64), np.arange(2), np.asarray([False, True]), 50)
    assert substring.repeated(*shard) == [(1, 0, 60)]
    none = np.empty(0, np.int64)
    monkeypatch.setattr(substring.FMIndex, "matches", lambda self, queries: (none, none))
    assert substring.repeated(*shard) == []  # a search that finds nothing removes nothing, copies included


def test_equal_windows_have_equal_minimizers():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    m, _, first, last = substring.segments(words, 50)
    assert first[0] == 0 and last[-1] == 350 and (first[1:] == last[:-1] + 1).all()
    whole = {at: m[k] for k in range(len(m)) for at in range(first[k], last[k] + 1)}
    for cut in (7, 123):
        m2, _, f2, l2 = substring.segments(words[cut : cut + 90], 50)
        for k in range(len(m2)):
            assert all(whole[cut + at] == m2[k] for at in range(f2[k], l2[k] + 1))


@pytest.mark.parametrize(("limit", "ids"), [(300_000, 500_000), (400, 0)])
def test_documents_equal_brute_force(spark, monkeypatch, limit, ids):
    monkeypatch.setattr(substring, "SHARD_WORDS", limit)
    monkeypatch.setattr(common, "BROADCAST_IDS", ids)
    rows = _corpus(3, 150, 4000, 4) + [(200, ["x"] * 1300), (201, ["x"] * 90), (202, [])]
    rows += [(204, [f"long{k}" for k in range(30_000)]), (205, [f"long{k}" for k in range(29_000, 31_000)])]
    rows += [(None, rows[0][1] + rows[10][1]), (7, rows[3][1]), (7, rows[3][1]), (203, rows[40][1] * 3)]
    rng = random.Random(4)
    docs = spark.createDataFrame([(d, rng.choice([" ", "\n", " \t "]).join(w) if w else None, 1) for d, w in rows], "doc_id long, text string, h int")
    expected = sorted((str(d), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest(), " ".join(k)) for (d, w), k in zip(rows, _plain(rows, 50)))
    found = substring.deduplicate(docs).collect()
    assert any(r.n_removed for r in found)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == [e[:4] for e in expected]
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found if r.n_removed)
    assert substring.deduplicate(docs.limit(0)).count() == 0
