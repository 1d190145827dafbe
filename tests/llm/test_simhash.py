"""SimHash against a plain Python version and all pairs."""

import random

import numpy as np
import xxhash

from tessera.llm import graph, simhash


def _plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, bits=3):
    """Smallest row of each component, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_the_plain_ones():
    for text in (None, "", " \n", "One", "one two", "A bÉ c", "x " * 50, "\u0085a b c d", " ".join(str(i) for i in range(3000))):
        assert simhash.fingerprint(None if text is None else text.encode()) == _plain(text), text


def test_every_close_pair_meets_at_an_anchor():
    rng = random.Random(5)
    for bits in (0, 1, 2, 3):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), bits):
                b ^= 1 << k
            keys = [set(simhash.anchors(np.asarray([x], dtype=np.uint64))[1].tolist()) for x in (a, b)]
            assert keys[0] & keys[1]
            assert all(len(k) <= 32 for k in keys)


def test_classes_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    prints = []
    for _ in range(60):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            x = center
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            prints.append(x)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    distinct = spark.createDataFrame([(p,) for p in sorted(set(signed))], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(distinct)).collect()}
    expected = _classes(prints)
    groups = {}
    for p, e in zip(signed, expected):
        groups.setdefault(e, set()).add(p)
    for members in groups.values():
        assert {roots.get(p, p) for p in members} == ({min(members)})


def test_documents_with_odd_rows(spark):
    words = [f"w{i}" for i in range(80)]
    near = words[:79] + ["other"]
    rows = [(5, " ".join(words), "x"), (3, " ".join(words), "x"), (9, " ".join(near), None), (2, "", "x"), (4, None, "x"), (4, None, "x"), (None, " \n", "x"), (11, "alone here", "x"), (None, "quite another thing", "x"), (12, " ".join(f"long{i}" for i in range(200_000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(found) == len(rows)
    prints = [simhash.fingerprint(None if t is None else t.encode()) for _, t, _ in rows]
    classes = _classes(prints)
    for (doc, _, _), p, c in zip(rows, prints, classes):
        least = min((d for (d, _, _), k in zip(rows, classes) if k == c and d is not None), default=None)
        assert (doc, int(np.uint64(p).view(np.int64)), least) in found
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    firsts = [min((k for k in range(len(rows)) if classes[k] == c), key=order) for c in set(classes)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((rows[k] for k in firsts), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
