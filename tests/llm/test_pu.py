"""Positive-unlabelled learning: slopes against differences, held-out accuracy on made-up corpora, odd rows."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import pu, quality, toxicity


@pytest.mark.parametrize("name", ["logistic", "sigmoid"])
def test_slopes_equal_differences(name):
    rng = np.random.default_rng(0)
    value = pu.LOSSES[name][0]
    for shift in (0.0, 4.0):  # with shift 4 the negative risk is below zero
        p, u, prior = rng.normal(size=5) + shift, rng.normal(size=7) - shift, 0.4
        risk, slope_p, slope_u = pu.risk_and_slopes(p, u, prior, name)
        if shift:
            loss = lambda a, b: prior * value(-a).mean() - value(-b).mean()
        else:
            loss = lambda a, b: pu.risk_and_slopes(a, b, prior, name)[0]
        for k in range(5):
            step = np.zeros(5)
            step[k] = 1e-5
            assert slope_p[k] == pytest.approx((loss(p + step, u) - loss(p - step, u)) / 2e-5, abs=1e-6)
        for k in range(7):
            step = np.zeros(7)
            step[k] = 1e-5
            assert slope_u[k] == pytest.approx((loss(p, u + step) - loss(p, u - step)) / 2e-5, abs=1e-6)
        assert risk >= 0


def test_fit_without_rows_scores_the_prior():
    for model in (pu.fit([], [np.asarray([1])], 0.3), pu.fit([np.asarray([1])], [], 0.3), pu.fit([np.empty(0, np.int64)], [np.empty(0, np.int64)], 0.3), pu.fit([], [])):
        assert pu.sigmoid(np.asarray([model.bias]))[0] == pytest.approx(model.prior) and not len(model.features)


def _word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def _corpus(bad, seed, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [_word(rng) for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.25)
        rows.append((i, bad(rng, words) if y else " ".join(words), "x"))
        if rng.random() < 0.7:
            labels.append((i, 1 - y, y))
    return rows, labels


def _insult(rng, words):
    for _ in range(3):
        words[rng.randrange(len(words))] = rng.choice(["Zotig,", "zotigste", "wixlum"])
    return " ".join(words)


def _shout(rng, words):
    return " ".join(w.upper() + "!!" for w in words)


@pytest.mark.parametrize(("module", "bad", "label"), [(toxicity, _insult, 2), (quality, _shout, 1)])
def test_held_out_accuracy(spark, module, bad, label):
    rows, labels = _corpus(bad, 11)
    odd = [(2000, None, "x"), (2001, "", "x"), (None, "a b", "x"), (2002, "long " * 20000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = module.score(docs, table).collect()
    assert len(found) == len(rows) + len(odd)
    folds, held = module.FOLDS, module.HELD_OUT
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    scores = {r.doc_id: r for r in found}
    truth = {x[0]: x[label] for x in labels}
    held_out = [d for d in truth if scores[d].held_out]
    assert np.mean([scores[d].predicted == truth[d] for d in held_out]) > 0.95
    flipped = spark.createDataFrame([(d, q if not scores[d].held_out else 1 - q, t if not scores[d].held_out else 1 - t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in module.score(docs, flipped).collect()}
    assert all(again[d] == scores[d].score for d in again)  # held-out labels change nothing


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score(docs, labels.limit(0)).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, labels.limit(0)).collect()) == [1, 2]


def _plain_features(module, rows, labels, column, folds, held, most_p, most_u):
    """The sample of ``pu.learn`` without Spark: ids by hash, features of the text with the least of them."""
    apart = lambda d: d is not None and zlib.crc32(str(d).encode()) % folds != held
    own = {}
    for d, text, *_ in rows:
        found = np.unique(module.features(None if text is None else text.encode()))
        if d not in own or found.tolist() < own[d].tolist():
            own[d] = found
    def least(ids, most, seed):
        as_long = lambda d: int(np.uint64(_spark_hash(d, _spark_hash_int(seed))).view(np.int64))
        return sorted({d for d in ids if apart(d)}, key=lambda d: (as_long(d), d))[:most]
    positive = least([d for d, *y in labels if y[column - 1] == 1], most_p, 1)
    unlabelled = least(own, most_u, 2)
    return [own[d] for d in positive if d in own], [own[d] for d in unlabelled]


def _spark_hash(value, seed):
    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed=seed)


def _spark_hash_int(value):
    return xxhash.xxh64_intdigest(int(value).to_bytes(4, "little", signed=True), seed=42)


@pytest.mark.parametrize(("module", "bad", "column", "loss"), [(toxicity, _insult, 2, "logistic"), (quality, _shout, 1, "sigmoid")])
def test_learning_in_spark_equals_plain_learning(spark, module, bad, column, loss):
    rows, labels = _corpus(bad, 17, 500)
    rows += [(4, "another text of four", "x"), (None, "no id", "x"), (900, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    name = "toxic" if column == 2 else "quality"
    found = pu.learn(docs, table, name, module.features, module.FOLDS, module.HELD_OUT, 40, 150, 300, loss=loss)
    p, u = _plain_features(module, rows, labels, column, module.FOLDS, module.HELD_OUT, 40, 150)
    plain = pu.fit(p, u, most=300, loss=loss)
    assert (len(p), len(u)) == (40, 150) and found.features.tolist() == plain.features.tolist()
    assert np.allclose(found.weights, plain.weights) and found.bias == pytest.approx(plain.bias) and found.prior == plain.prior


@pytest.mark.parametrize("memory", [500_000, 20])
def test_remembered_words_change_no_score(monkeypatch, memory):
    monkeypatch.setattr(toxicity, "MEMORY", memory)
    rng = random.Random(8)
    texts = [" ".join(_word(rng) for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    known = sorted({int(f) for t in texts[:20] for f in toxicity.features(t)})[::3]
    model = pu.Model(0.25, np.asarray(known), np.asarray([rng.gauss(0, 1) for _ in known]))
    margin = toxicity.scorer(model)
    for text in [*texts, None, b"", *texts]:
        plain = model.bias + sum(w for f, w in zip(model.features, model.weights) if f in set(toxicity.features(text).tolist()))
        assert margin(text) == pytest.approx(plain)


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_the_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(int(prior * 100))

    def rows(n, good):
        out = []
        for _ in range(n):
            y = rng.random() < good
            row = np.flatnonzero(rng.random(60) < (np.r_[np.full(30, 0.3), np.full(30, 0.1)] if y else np.r_[np.full(30, 0.1), np.full(30, 0.3)]))
            out.append(row)
        return out

    assert pu.fit(rows(2000, 1.0), rows(4000, prior)).prior == pytest.approx(prior, abs=0.06)


def test_ids_of_least_hash(spark):
    ids = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id")
    expected = sorted({(r.h, r.doc_id) for r in ids.selectExpr("xxhash64(7, doc_id) AS h", "doc_id").collect()})
    for most in (1, 40, 1900, 5000):
        assert [tuple(r) for r in pu.least_hashed(ids, most, 7).orderBy("h").collect()] == expected[:most]


def test_ids_may_be_texts(spark):
    rows, labels = _corpus(_insult, 12, 200)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, _ in rows], "doc_id string, text string")
    found = toxicity.score(docs, spark.createDataFrame([(f"d{i}", t) for i, _, t in labels], "doc_id string, toxic int"))
    assert found.schema["doc_id"].dataType.simpleString() == "string" and {r.doc_id for r in found.collect()} == {f"d{i}" for i in range(200)}


def test_the_sample_holds_what_the_bounds_allow(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(pu, "fit_rows", lambda features, p, u, **settings: taken.append((len(p), len(u))))
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a' AS text")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS toxic")
    pu.learn(docs, labels, "toxic", lambda text: np.asarray([1], np.int32), 3, 1)
    assert taken == [(4_000, 12_000)]
