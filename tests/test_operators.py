"""Operators on small hand-made frames, with exact expectations."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera import functions as X
from tessera.operators import anomaly, audit, contract, corporate_actions, dq, inject, reconcile, remediation

DAY = datetime.date(2024, 1, 2)
SILVER = "source_id string, instrument_id string, business_date date, field string, value double"


def _silver(spark, rows):
    return spark.createDataFrame([(s, i, d, f, None if v is None else float(v)) for s, i, d, f, v in rows], SILVER)


@pytest.mark.parametrize(
    ("kind", "limit", "a", "b", "agree"),
    [(C.BPS, 25, 182.0, 182.04, True), (C.BPS, 25, 182, 200, False), (C.PCT, 5, 1.0e6, 1.04e6, True), (C.PCT, 5, 1.0e6, 1.1e6, False),
     (C.BPS, 25, 0, 0, True), (C.ABSOLUTE, 0.5, 100, 100.4, True), (C.ABSOLUTE, 0.5, 100, 100.6, False)],
)
def test_tolerance(spark, kind, limit, a, b, agree):
    row = spark.range(1).select(X.within_fixed(X.double(a), X.double(b), C.Tolerance(kind, limit))).first()
    assert row[0] is agree


def _vote(spark, values, settings, field="CLOSE"):
    rows = _silver(spark, [(s, "A", DAY, field, v) for s, v in values.items()])
    slow = reconcile.elect(reconcile.votes(rows), settings).first()
    fast = reconcile.elect_known(rows, settings, tuple(values)).first()
    for name in ("quorum_sources", "dissenting_sources", "confidence", "tolerance_band", "votes", "currency"):
        assert slow[name] == fast[name], name
    assert (slow.golden_value is None) == (fast.golden_value is None)
    assert slow.golden_value is None or slow.golden_value == pytest.approx(fast.golden_value, rel=1e-14)
    return slow


def test_election(spark):
    settings = C.Reconciliation()
    both = _vote(spark, {"a": 182.00, "b": 182.02}, settings)
    assert both.golden_value == pytest.approx(182.01) and both.confidence == "HIGH" and both.dissenting_sources == [] and both.tolerance_band == "CLOSE:25bps"
    broken = _vote(spark, {"a": 182, "b": 200}, settings)
    assert broken.golden_value is None and broken.confidence == "LOW" and broken.dissenting_sources == ["a", "b"]
    assert _vote(spark, {"a": 182}, settings).golden_value is None
    three = _vote(spark, {"a": 182.00, "b": 182.02, "c": 200}, settings)
    assert (three.quorum_sources, three.dissenting_sources, three.confidence) == (["a", "b"], ["c"], "MEDIUM")
    exact = _vote(spark, {"a": 182, "b": 182}, C.Reconciliation(tolerances={}))
    assert exact.golden_value == 182 and exact.confidence == "HIGH" and exact.tolerance_band == "CLOSE:exact"
    assert _vote(spark, {"a": 5}, C.Reconciliation(tolerances={})).golden_value == 5
    assert _vote(spark, {"a": 1, "b": 2}, C.Reconciliation(tolerances={})).golden_value is None


def test_both_elections_agree_on_random_votes(spark):
    rng = random.Random(5)
    rows, names = [], ("s1", "s2", "s3", "s4")
    for n in range(400):
        for s in names:
            if rng.random() < 0.8:
                rows.append((s, f"I{n}", DAY, rng.choice(["CLOSE", "OTHER"]), rng.choice([100, 100.2, 100.4, 100.6, 101.0, None])))
    silver = _silver(spark, rows)
    for least in (1, 2, 3):
        settings = C.Reconciliation(min_agreeing_sources=least)
        key = lambda r: (r.instrument_id, r.field)
        slow = sorted(reconcile.elect(reconcile.votes(silver), settings).collect(), key=key)
        fast = sorted(reconcile.elect_known(silver, settings, names).collect(), key=key)
        assert [(*key(r), r.quorum_sources, r.dissenting_sources, r.confidence, r.votes, r.golden_value and round(r.golden_value, 9)) for r in slow] == [
            (*key(r), r.quorum_sources, r.dissenting_sources, r.confidence, r.votes, r.golden_value and round(r.golden_value, 9)) for r in fast
        ]


def test_gold_and_breaks_are_all_votes(spark):
    silver = _silver(spark, [(s, f"I{i}", DAY, "CLOSE", 100 + i * (s == "b")) for i in range(5) for s in ("a", "b")])
    elected = reconcile.reconcile(silver, C.Config(sources=(C.Source("a"), C.Source("b"))))
    gold, breaks = reconcile.gold(elected, "r"), reconcile.breaks(elected)
    assert gold.count() + breaks.count() == 5
    lineage = audit.lineage(gold, reconcile.decisions(elected, "r"))
    assert lineage.filter("verified").count() == gold.count() and gold.select("decision_id").distinct().count() == gold.count()
    assert breaks.first().source_values == {"a": 100.0, "b": 101.0} or breaks.count() > 0


def test_last_fetched_row_of_a_source_votes(spark):
    ts = lambda h: datetime.datetime(2024, 1, 2, h)
    rows = spark.createDataFrame([("a", "A", DAY, "CLOSE", 9.0, ts(1)), ("a", "A", DAY, "CLOSE", 5.0, ts(3)), ("b", "A", DAY, "CLOSE", 5.0, ts(1))], SILVER + ", fetch_ts timestamp")
    assert reconcile.elect(reconcile.votes(rows), C.Reconciliation()).first().golden_value == 5
    assert reconcile.elect_known(rows, C.Reconciliation(), ("a", "b")).first().golden_value == 5


def test_quality_rules(spark):
    quality = C.Quality()
    rows = _silver(spark, [("a", "A", DAY, "CLOSE", None), ("a", "B", DAY, "CLOSE", -1), ("a", "C", DAY, "CLOSE", 0), ("a", "D", DAY, "VOLUME", -5), ("a", "E", DAY, "CLOSE", 1), ("a", "E", DAY, "CLOSE", 2)])
    only = lambda df: [(r.instrument_id, r.severity) for r in df.collect()]
    assert only(dq.null_check(rows, quality)) == [("A", "high")]
    assert only(dq.range_check(rows, quality)) == [("B", "high")]
    assert only(dq.duplicate_check(rows, quality)) == [("E", "medium")]
    nan = rows.withColumn("value", F.lit(float("nan")))
    assert dq.null_check(nan, quality).count() == 6 and dq.range_check(nan, quality).count() == 0
    bars = _silver(spark, [("a", "A", DAY, f, v) for f, v in (("OPEN", 92), ("HIGH", 90), ("LOW", 95), ("CLOSE", 91))])
    assert sorted(r.reason for r in dq.monotonicity_check(bars, quality).collect()) == ["CLOSE < LOW", "CLOSE > HIGH", "HIGH < LOW", "OPEN < LOW", "OPEN > HIGH"]
    assert dq.monotonicity_check(bars.filter("field <> 'LOW'"), quality).count() == 2
    found = dq.failures(rows, C.Config())
    assert {(r.source_id, r.high, r.medium, r.failed) for r in dq.verdicts(rows, found).collect()} == {("a", 2, 1, True)}
    assert sorted(r.instrument_id for r in dq.quarantine(rows, found).collect()) == ["A", "B"]


def test_staleness(spark):
    settings = C.Config(sources=(C.Source("a", staleness_max_days=1),))
    for days, expected in ((4, 1), (1, 0), (0, 0), (-3, 0)):
        rows = _silver(spark, [("a", "A", DAY, "CLOSE", 1)]).withColumn("fetch_ts", F.lit(datetime.datetime(2024, 1, 2, 21) - datetime.timedelta(days=days)))
        assert dq.staleness_check(rows, settings).count() == expected


def _bronze(spark, n=5):
    rows = [(datetime.datetime(2024, 1, 2), 100.0, 110.0, 95.0, 102.0, 101.5, 1_000_000, f"I{k}", f"i{k}.us", datetime.datetime(2024, 1, 2, 21)) for k in range(n)]
    return spark.createDataFrame(rows, "Date timestamp, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint, instrument_id string, source_symbol string, fetch_ts timestamp")


def test_conforming(spark):
    bronze = _bronze(spark)
    silver = contract.to_silver(bronze, "s1")
    assert silver.count() == 30 and contract.violations(silver).count() == 0
    assert {r.field: r.value for r in silver.filter("instrument_id = 'I0'").collect()} == {"OPEN": 100, "HIGH": 110, "LOW": 95, "CLOSE": 102, "ADJ_CLOSE": 101.5, "VOLUME": 1e6}
    assert silver.select("content_hash").distinct().count() == 30
    fallback = contract.to_silver(bronze.drop("Adj Close"), "s1")
    assert fallback.filter("field = 'ADJ_CLOSE'").first().value == 102
    with pytest.raises(KeyError):
        contract.to_silver(bronze.drop("Open"), "s1")
    broken = silver.withColumn("value", F.when(F.col("field") != "CLOSE", F.col("value"))).withColumn("field", F.when(F.col("field") == "OPEN", "OPENING").otherwise(F.col("field")))
    assert {r.rule: r["count"] for r in contract.violations(broken).groupBy("rule").count().collect()} == {"value_missing": 5, "field_unknown": 5}
    accepted, rejected = contract.split(broken.unionByName(contract.to_silver(bronze, "s2")))
    assert (accepted.count(), rejected.count()) == (30, 30)
    accepted, rejected = contract.split(broken, by_batch=False)
    assert (accepted.count(), rejected.count()) == (20, 10)
    assert contract.report(contract.violations(broken), 3).count() == 3


def _days(n):
    return [DAY + datetime.timedelta(days=k) for k in range(n)]


def test_anomalies(spark):
    rng = random.Random(1)
    calm = [100 + rng.uniform(-1, 1) for _ in range(25)]
    spike = _silver(spark, [("a", "A", d, "CLOSE", v) for d, v in zip(_days(26), [*calm, 10_000])])
    last = anomaly.classify(spike, C.Anomaly()).filter(F.col("business_date") == _days(26)[-1]).first()
    assert last.is_likely_error and last.reason == "zscore_exceeded" and last.iqr_outlier
    wild = calm[:20] + [100 * (1 + s) for s in (0.2, -0.2, 0.25, -0.2, 0.2)]
    moved = _silver(spark, [("a", "A", d, "CLOSE", v) for d, v in zip(_days(26), [*wild, 400])])
    last = anomaly.classify(moved, C.Anomaly(zscore_threshold=3.0)).filter(F.col("business_date") == _days(26)[-1]).first()
    assert not last.is_likely_error and last.reason == "volatility_regime"
    assert anomaly.classify(_silver(spark, [("a", "A", d, "CLOSE", 5) for d in _days(25)]), C.Anomaly()).count() == 0


@pytest.mark.parametrize(("before", "now", "ratio"), [(200, 100, 2.0), (300, 100, 3.0), (102, 100, None), (100, 200, None), (0, 100, None)])
def test_single_source_split(spark, before, now, ratio):
    rows = _silver(spark, [("a", "A", d, "CLOSE", v) for d, v in zip(_days(2), (before, now))])
    found = corporate_actions.single_source(rows, C.CorporateActions()).collect()
    assert [r.ratio for r in found] == ([] if ratio is None else [ratio])


@pytest.mark.parametrize(
    ("a", "b", "who"), [((100, 100), (200, 200), "b"), ((200, 200), (100, 100), "a"), ((100, 100), (100, 100), None), ((100, 100), (105, 105), None), ((200, 100), (100, 200), "a")]
)
def test_cross_source_split(spark, a, b, who):
    rows = _silver(spark, [(s, "A", d, "CLOSE", v) for s, own in (("a", a), ("b", b)) for d, v in zip(_days(2), own)])
    found = corporate_actions.cross_source(rows, C.CorporateActions()).filter(F.col("business_date") == _days(2)[1]).collect()
    assert [(r.source_id, r.ratio) for r in found] == ([] if who is None else [(who, 2.0)])


def test_back_adjustment(spark):
    fields = ("OPEN", "HIGH", "LOW", "CLOSE", "ADJ_CLOSE", "VOLUME")
    rows = _silver(spark, [("a", "A", d, f, 1000 if f == "VOLUME" else v) for d, v in zip(_days(3), (200, 200, 100)) for f in fields])
    splits = corporate_actions.single_source(rows, C.CorporateActions())
    view = corporate_actions.back_adjusted(rows, splits)
    assert view.filter("ca_adjusted").count() == 12
    assert {(r.field, r.value) for r in view.filter("ca_adjusted").collect()} == {(f, 2000.0 if f == "VOLUME" else 100.0) for f in fields}
    assert view.filter(F.col("business_date") == _days(3)[2]).filter("NOT ca_adjusted").count() == 6
    again = corporate_actions.single_source(view, C.CorporateActions())
    assert again.count() == 0  # what is adjusted shows no split any more
    chained = spark.createDataFrame([("A", "a", _days(3)[1], 2.0), ("A", "a", _days(3)[2], 3.0)], "instrument_id string, source_id string, business_date date, ratio double")
    assert sorted(r.adjustment for r in corporate_actions.back_adjusted(rows.filter("field = 'CLOSE'"), chained).collect()) == [1.0, 3.0, 6.0]


def test_split_recall(spark):
    rows = []
    for k, ratio in itertools.product(range(5), (2.0, 3.0)):
        rng = random.Random(k)
        rows += [("a", f"I{k}x{ratio}", d, "CLOSE", (100 + rng.uniform(-1, 1)) / (ratio if n == 5 else 1)) for n, d in enumerate(_days(6))]
    found = corporate_actions.single_source(_silver(spark, rows), C.CorporateActions())
    assert found.count() >= 0.95 * 10 and all(r.instrument_id.endswith(f"x{r.ratio}") for r in found.collect())


def test_asof_is_strict_and_ignores_the_future(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 1, 10.0), ("k", 5, 50.0), ("k", 5, 51.0), ("k", 8, None)], "key string, t int, v double")
    assert sorted((r.key, r.t, r.asof_value) for r in corporate_actions.asof(left, right, ["key"], "t", "v").collect()) == [("k", 1, None), ("k", 5, 10.0), ("k", 9, 51.0), ("z", 9, None)]


def _breaks(spark, rows):
    return spark.createDataFrame([(1, v, d) for v, d in rows], "business_date int, source_values map<string,double>, dissenting_sources array<string>")


def test_bad_source(spark):
    names = ("north", "south")
    both = _breaks(spark, [({"north": 1.0, "south": 2.0}, ["north", "south"])])
    pick = lambda df, n: remediation.candidates(df, names).select(remediation.bad_source(F.col("candidates"), F.lit(n))).first()[0]
    assert [pick(both, n) for n in (1, 2, 3)] == ["north", "south", "north"]
    assert pick(_breaks(spark, [({"south": 2.0}, ["south"])]), 1) == "north"
    assert pick(_breaks(spark, [({"north": 1.0, "south": 2.0}, [])]), 2) == "south"
    steps = spark.range(1, 6).select(remediation.lookback(F.col("id").cast("int"), (5, 20, 60)).alias("d"))
    assert [r.d for r in steps.collect()] == [5, 20, 60, 60, 60]


def test_remediation_loop(spark):
    settings = C.Config(sources=(C.Source("a"), C.Source("b")))
    rows = _silver(spark, [("a", "A", DAY, "CLOSE", 100), ("b", "A", DAY, "CLOSE", 150)])
    good = _silver(spark, [("b", "A", DAY, "CLOSE", 100)])
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    elected, _, log, opened = remediation.remediate(spark, rows, settings, lambda s, d: good if s == "b" else None, "r", keep)
    assert [(r.attempt, r.bad_source, r.lookback_days, r.outcome) for r in log.collect()] == [(1, "a", 5, "refetch_failed"), (2, "b", 20, "refetched"), (2, None, None, "remediated")]
    assert elected.first().golden_value == 100 and opened.count() == 1
    _, _, log, _ = remediation.remediate(spark, rows, settings, lambda s, d: None, "r", keep)
    assert [r.outcome for r in log.collect()] == ["refetch_failed"] * 3 + ["escalated"]
    _, _, log, _ = remediation.remediate(spark, rows.filter("source_id = 'a'").unionByName(good), settings, lambda s, d: None, "r", keep)
    assert [r.outcome for r in log.collect()] == ["clean"]


def test_a_refetch_replaces_the_dates_that_it_covers(spark):
    import datetime

    settings = C.Config(sources=(C.Source("a"), C.Source("b")))
    before = DAY - datetime.timedelta(days=1)
    rows = _silver(spark, [("a", "A", d, "CLOSE", 100) for d in (before, DAY)] + [("b", "A", before, "CLOSE", 100), ("b", "A", DAY, "CLOSE", 150)])
    good = _silver(spark, [("b", "A", DAY, "CLOSE", 100), ("other", "A", DAY, "CLOSE", 1)])
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    elected, silver, _, _ = remediation.remediate(spark, rows, settings, lambda s, d: good if s == "b" else None, "r", keep)
    assert silver.count() == 4 and [r.golden_value for r in elected.collect()] == [100, 100]


def test_numbers_in_order(spark):
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'b' WHEN id % 97 = 3 THEN NULL ELSE 'a' END AS topic", "timestamp_seconds(1700000000 + id * 37 % 20000) AS ts")
    rows = rows.withColumn("ts", F.when(F.col("id") % 50 != 7, F.col("ts")))
    from pyspark.sql import Window as W

    plain = rows.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("ts", "id")).cast("long"))
    assert audit.numbered(rows, "topic", "ts", ["id"]).exceptAll(plain.select(*rows.columns, "place")).count() == 0


def test_pairs_of_sources(spark):
    rows = _silver(spark, [("a", "A", DAY, "CLOSE", 100), ("b", "A", DAY, "CLOSE", 101), ("c", "A", DAY, "CLOSE", None), ("a", "B", DAY, "CLOSE", 1), ("a", "B", DAY, "CLOSE", 2)])
    found = reconcile.agreement(rows, {"near": F.abs(F.col("value_a") - F.col("value_b")) < 2}, ("c", "b", "a")).collect()
    assert [(r.instrument_id, r.source_a, r.source_b, r.value_a, r.value_b, r.near) for r in found] == [("A", "a", "b", 100.0, 101.0, True)]


def test_rows_without_date_or_source_are_quarantined(spark):
    rows = _silver(spark, [("a", "A", DAY, "CLOSE", 100), ("a", "B", None, "CLOSE", 100), (None, "C", DAY, "CLOSE", 100)])
    accepted, rejected = contract.split(rows)
    assert [r.instrument_id for r in accepted.collect()] == ["A"] and sorted(r.instrument_id for r in rejected.collect()) == ["B", "C"]
    assert {r.rule for r in contract.violations(rejected).collect()} == {"business_date_missing", "source_id_missing"}


def test_scorecards(spark):
    log = lambda *kinds: spark.createDataFrame([(1, k) for k in kinds], "business_date int, decision_type string")
    card = lambda *kinds: audit.scorecard_from_decisions(log(*kinds), ["business_date"]).first()
    assert card("ESCALATE", "REMEDIATE", "REMEDIATE").overall_status == "RED"
    assert card("REMEDIATE").overall_status == "AMBER" and card("RECONCILE").overall_status == "GREEN"
    rate = spark.createDataFrame([(2, 3), (0, 0)], "s int, a int").select(remediation.success_rate(F.col("s"), F.col("a")).alias("r"))
    assert [r.r for r in rate.collect()] == [2 / 3, 1.0]


def test_replay_difference(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert audit.replay_difference(rows, rows, ["k", "v"]).count() == 0
    found = audit.replay_difference(rows, rows.filter("k = 2").unionByName(rows.limit(1)), ["k", "v"])
    assert [(r.k, r.surplus, r.side) for r in found.collect()] == [(1, 1, "stored")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "e"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, audit.insert_ignore(old, new, "id", ["v"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, audit.latest(old.unionByName(new), ["id"], [F.col("v")]).collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_exports(spark):
    elected = reconcile.reconcile(_silver(spark, [(s, "<A>", DAY, "CLOSE", 1) for s in ("a", "b")]), C.Config(sources=(C.Source("a"), C.Source("b"))))
    lineage = audit.lineage(reconcile.gold(elected, "r"), reconcile.decisions(elected, "r"))
    card = spark.createDataFrame([("r", DAY, "a", "RED")], "run_id string, business_date date, source_id string, overall_status string")
    assert {line.value.startswith('{"kind":') for line in audit.to_json(lineage, card).collect()} == {True}
    page = audit.to_html(card, lineage)
    assert "http" not in page and "&lt;A&gt;" in page and "RED" in page
    assert audit.narrative(spark.createDataFrame([("dq.passed", 2)], "topic string, n int")) == "The run saw 2 x dq.passed."


def test_injectors(spark):
    rows = _silver(spark, [("a", f"I{k}", DAY, "CLOSE", 10) for k in range(10)])
    assert inject.inject(rows, "null_burst", rate=0.3).filter("value IS NULL").count() == 3
    assert inject.null_burst(rows, rate=0.3).exceptAll(inject.null_burst(rows, rate=0.3)).count() == 0
    assert sorted(r.value for r in inject.inject(rows, "out_of_range").collect()) == [10.0] * 9 + [1000.0]
    assert inject.inject(rows, "cross_source_break", source_id="b").filter("value <> 10").count() == 0
    assert inject.inject(rows, "schema_drift", drop=["value"]).columns == ["source_id", "instrument_id", "business_date", "field"]
    with pytest.raises(ValueError):
        inject.inject(rows, "nothing")
    bronze = _bronze(spark)
    for name in ("clean", "null_burst", "stale_feed", "out_of_range", "split_2to1", "cross_source_break", "volatility_regime", "mixed_defects"):
        assert inject.scenario(bronze, name).count() == 5
    assert "Adj Close" not in inject.scenario(bronze, "schema_drift").columns
    walk = inject.walk(spark, ["A", "B"], 10, "2024-01-31", "s1")
    assert walk.count() == 2 * 10 * 6 and contract.violations(walk).count() == 0


def test_settings():
    own = C.load({"sources": {"x": {"staleness_max_days": 2}}, "reconciliation": {"min_agreeing_sources": 3, "tolerances": {"CLOSE": {"kind": "absolute", "value": 1}}}, "anomaly": {"window_days": 5}})
    assert own.voters == ("x",) and own.reconciliation.tolerances["CLOSE"] == C.Tolerance("absolute", 1.0) and own.anomaly.window_days == 5
    with pytest.raises(ValueError):
        C.load({"anomaly": {"windows": 5}})


def test_the_page_holds_the_whole_scorecard_and_names_what_it_leaves_out(spark):
    card = spark.range(5).selectExpr("'2024-01-02' AS business_date", "concat('s', id) AS source_id", "'GREEN' AS overall_status")
    lineage = spark.range(5).selectExpr("'2024-01-02' AS business_date", "concat('i', id) AS instrument_id", "'close' AS field")
    page = audit.to_html(card, lineage, limit=2)
    assert all(f"<td>s{k}</td>" in page for k in range(5))
    assert page.count("<td>close</td>") == 2 and "3 more golden records are left out" in page
    assert "left out" not in audit.to_html(card, lineage, limit=5)
