"""Greedy string tiling against a naive version; planted, edited and reordered passages."""

import random
import time
import tracemalloc

import pytest

from tessera.llm import decontaminate as dc


def _naive(item, doc, least):
    used_item, used_doc, marks = set(), set(), []
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while q + k < len(item) and p + k < len(doc) and item[q + k] == doc[p + k] and q + k not in used_item and p + k not in used_doc:
                    k += 1
                best = max(best, (k, -q, -p))
        k, q, p = best[0], -best[1], -best[2]
        if k < least:
            return marks
        marks.append((q, p, k))
        used_item.update(range(q, q + k))
        used_doc.update(range(p, p + k))


@pytest.mark.parametrize("pairs", [20_000, 3, 0])  # with 0 all tiles come from the ranks
def test_tiles_equal_the_naive_ones(monkeypatch, pairs):
    monkeypatch.setattr(dc, "PAIRS_OF_ITEM", pairs)
    rng, marks = random.Random(4), 0
    for least in (1, 2, 3, 5):
        for _ in range(100):
            items = [[f"t{rng.randrange(rng.choice([2, 3, 9]))}" for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 4))]
            doc = [f"t{rng.randrange(4)}" for _ in range(rng.randint(0, 25))]
            index = dc.Index.build([(k, " ".join(i)) for k, i in enumerate(items)], least)
            found = {i: m for i, _, m in index.covered(" ".join(doc), 0.01)}
            for k, item in enumerate(items):
                expected = _naive(item, doc, min(least, len(item))) if item else []
                assert found.get(k, []) == expected
                marks += len(expected)
    assert marks > 500


def test_items_that_cannot_be_covered_enough_are_not_tiled(monkeypatch):
    rng = random.Random(6)
    for _ in range(60):
        items = [[f"t{rng.randrange(5)}" for _ in range(rng.randint(1, 20))] for _ in range(6)]
        doc = " ".join(f"t{rng.randrange(6)}" for _ in range(rng.randint(0, 60)))
        index = dc.Index.build([(k, " ".join(i)) for k, i in enumerate(items)], 3)
        every = {i: (c, m) for i, c, m in index.covered(doc, 0.0)}
        for least in (0.3, 0.5, 1.0):
            assert {i: (c, m) for i, c, m in index.covered(doc, least)} == {i: x for i, x in every.items() if x[0] >= least}


def test_a_phrase_of_very_many_items_and_endless_repetition():
    rng = random.Random(7)
    phrase = _words(rng, 15)
    index = dc.Index.build([(i, " ".join([*_words(rng, 20), *phrase])) for i in range(20_000)])
    began = time.perf_counter()
    assert list(index.covered(" ".join(phrase), 0.5)) == []
    assert time.perf_counter() - began < 0.5
    repeated = dc.Index.build([(0, "x " * 300), (1, "x y " * 150)])
    tracemalloc.start()
    assert [(i, c) for i, c, _ in repeated.covered("x " * 200_000, 0.5)] == [(0, 1.0)]
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_short_items_match_as_a_whole():
    index = dc.Index.build([(1, "Paris"), (2, "the grey cat"), (3, ""), (4, None), (5, "one two three four five six")])
    assert [i for i, _, _ in index.covered("A grey cat; the grey dog", 0.5)] == []
    assert sorted(i for i, _, _ in index.covered("paris: The grey cat", 0.5)) == [1, 2]
    assert list(index.covered("one two three four", 0.5)) == []


def test_ties_go_to_the_smallest_id(spark):
    text = "a b c d e f g h"
    benchmark = spark.createDataFrame([(7, text), (3, "z " + text + " y"), (5, text), (5, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + text + " it is")], "doc_id long, text string")
    row = dc.judge(docs, benchmark).first()
    assert (row.item_id, row.n_items, row.coverage) == (5, 3, 1.0)


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.mark.parametrize("block", [8_000_000, 600])
def test_planted_passages(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_CHARS", block)
    rng = random.Random(9)
    items = [(i, _words(rng, rng.randint(15, 50))) for i in range(30)]
    rows, expected = [], {}
    for d in range(200):
        body = _words(rng, rng.randint(0, 200))
        kind = d % 5
        passage = list(rng.choice(items)[1]) if kind in (1, 2, 3) else []
        i = next((i for i, w in items if w == passage), None)
        if kind == 2:  # reordered
            half = len(passage) // 2
            passage = passage[half:] + body[:3] + passage[:half]
        if kind == 3:  # fewer than half of its words
            passage = passage[: len(passage) // 2 - 1]
        at = rng.randint(0, len(body))
        text = " ".join(body[:at] + passage + body[at:])
        rows.append((d, text.upper() + "!" if d % 2 else text.replace(" ", ", "), 1.5))
        expected[d] = i if kind in (1, 2) else None
    rows += [(302, " ".join(_words(rng, 150_000)), 0.0), (300, None, 0.0), (301, "", 0.0), (None, "x y", 0.0), (0, "repeated row", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    benchmark = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items] + [(99, None, 0), (98, "too short here", 0)], "item_id int, text string, doc_id int")
    found = dc.judge(docs, benchmark).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.item_id == expected.get(r.doc_id) and r.contaminated == (r.item_id is not None), r
        assert r.coverage == (pytest.approx(1.0, abs=0.01) if r.contaminated else 0.0)
    kept = dc.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _ in rows if expected.get(d) is None)
    assert dc.judge(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in dc.judge(docs, benchmark.limit(0)).collect())
