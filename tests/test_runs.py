"""Layers, a whole run with replay, and the event stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera import streaming
from tessera.operators import audit, contract, inject
from tessera.plans import engine
from tessera.sources import feeds, schemas
from tessera.sources.layers import Fixtures, Layers

SETTINGS = C.Config(sources=(C.Source("s1"), C.Source("s2"), C.Source("rates", reference=True)))


def _bronze(spark, days=3, n=4):
    rows = [
        (datetime.datetime(2024, 1, 2) + datetime.timedelta(days=d), 100.0 + k, 110.0 + k, 95.0 + k, 102.0 + k + d, 102.0 + k + d, 1000, f"I{k}", f"i{k}", datetime.datetime(2024, 1, 2, 21) + datetime.timedelta(days=d))
        for d in range(days) for k in range(n)
    ]
    return spark.createDataFrame(rows, "Date timestamp, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint, instrument_id string, source_symbol string, fetch_ts timestamp")


def test_run_and_replay(spark, tmp_path):
    layers = Layers(spark, str(tmp_path))
    bronze = _bronze(spark)
    bad = inject.inject(bronze.filter("instrument_id = 'I0'"), "cross_source_break", column="Close").unionByName(bronze.filter("instrument_id <> 'I0'"))
    result = engine.run(spark, layers, {"s1": bronze, "s2": bad, "drifted": bronze.drop("Close")}, SETTINGS, "run1")
    assert result.gold.count() + result.breaks.count() == 3 * 4 * 6
    assert {r.instrument_id for r in result.breaks.collect()} == {"I0"} and result.breaks.count() == 3
    assert result.lineage.filter("verified IS NULL").count() == 0
    assert {r.overall_status for r in result.scorecard.collect()} == {"RED"}
    assert [r.outcome for r in result.attempts.orderBy("attempt").collect()][-1] == "escalated"
    assert engine.replay(layers, "run1", SETTINGS).count() == 0
    assert layers.read_gold("run1", "2024-01-03").count() == 23 and layers.read_gold("none", "2024-01-03").count() == 0
    kinds = {r.decision_type: r.n for r in layers.sql("SELECT decision_type, count(*) AS n FROM decisions GROUP BY 1").collect()}
    assert kinds == {"INGEST": 9, "CONTRACT": 9, "DQ": 12, "RECONCILE": result.gold.count(), "ESCALATE": 3}
    failed = layers.read("decisions").filter("NOT verified").groupBy("agent").count().collect()
    assert {r.agent for r in failed} >= {"contract", "remediation"}
    drifted = layers.read("quarantine").filter("quarantine_reason = 'schema_drift'")
    assert drifted.count() == 12 and "Open" in drifted.first().payload and "missing columns: Close" in drifted.first().error
    layers.append_new("decisions", result.decisions.withColumn("ts", F.current_timestamp()), "decision_id")
    assert layers.read("decisions").count() == sum(kinds.values())
    assert layers.read_scorecard("run1").count() == result.scorecard.count() == 6
    topics = {r.topic: r.n for r in audit.topic_counts(layers.events("run1")).collect()}
    assert topics["ingestion.complete"] == 9 and topics["contract.violation"] == 3 and topics["contract.passed"] == 6 and topics["reconciliation.break"] == 3
    assert topics["remediation.started"] == 1 and topics["remediation.refetch_requested"] == topics["remediation.failed"] == 3 and topics["escalation"] == 3
    assert topics["run.started"] == topics["run.complete"] == 1 and set(topics) <= set(streaming.TOPICS)
    mended = engine.run(spark, layers, {"s1": bronze, "s2": bad}, SETTINGS, "run2", refetch=lambda s, d: contract.to_silver(bronze, s))
    assert mended.breaks.count() == 0 and {r.overall_status for r in mended.scorecard.collect()} == {"AMBER"}
    done = layers.read("decisions").filter("decision_type = 'REMEDIATE'")
    assert done.count() == 3 and all(r.verified and r.inputs["n_left"] == 0 and r.inputs["n_opened"] == 1 for r in done.collect())
    assert layers.read_scorecard("run1").count() == 6 and layers.read_scorecard("run2").count() == 6


def test_a_run_without_rows(spark, tmp_path):
    layers = Layers(spark, str(tmp_path))
    result = engine.run(spark, layers, {"s1": _bronze(spark).limit(0)}, SETTINGS, "empty")
    assert result.gold.count() == result.breaks.count() == result.decisions.count() == 0 and layers.read("gold") is None
    assert sorted(r.topic for r in layers.events("empty").collect()) == ["run.complete", "run.started"]
    assert [r.outcome for r in result.attempts.collect()] == ["clean"]


def test_reference_feeds_pass_by_the_election(spark, tmp_path):
    rates = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "EURUSD", "usd", 1.1, "USD", datetime.datetime(2024, 1, 2))], "Date timestamp, instrument_id string, source_symbol string, rate double, currency string, fetch_ts timestamp")
    layers = Layers(spark, str(tmp_path))
    bronze = _bronze(spark, days=1)
    result = engine.run(spark, layers, {"s1": bronze, "s2": bronze, "rates": rates}, SETTINGS, "r", kinds={"rates": "rates"})
    assert result.gold.filter("instrument_id = 'EURUSD'").count() == 0 and result.silver.filter("source_id = 'rates'").count() == 1
    topics = {r.topic: r.n for r in audit.topic_counts(result.events).collect()}
    assert topics["reference_data.complete"] == 1 and topics["ingestion.complete"] == 2
    with pytest.raises(ValueError):
        engine.run(spark, layers, {"s1": bronze}, SETTINGS, "x", kinds={"s1": "nothing"})


def test_kafka_records(spark):
    events = _events(spark, [("e1", "dq.passed", 0, "s1", "r1")])
    sent = streaming.to_kafka(events, "q.")
    assert bytes(sent.first().key) == b"r1" and sent.first().topic == "q.dq.passed"
    back = streaming.from_kafka(sent.select("value").unionByName(spark.createDataFrame([(bytearray(b"no event"),)], "value binary")))
    assert back.collect() == events.collect()
    with pytest.raises(ValueError):
        streaming.subscribe(events, ["dq.passed", "nowhere"])


def test_layers(spark, tmp_path):
    layers = Layers(spark, str(tmp_path))
    assert layers.read("silver") is None and layers.silver_window("2024-01-04", 5) is None
    bronze = _bronze(spark).withColumns({"source_id": F.lit("s1"), "run_id": F.lit("r"), "business_date": F.to_date("Date")})
    layers.write_bronze(bronze)
    layers.write_bronze(bronze.withColumn("Open", F.lit(0.0)))
    assert layers.read("bronze").count() == 12 and layers.read("bronze").filter("Open = 0").count() == 0
    for run in ("r1", "r2"):
        layers.write_silver(contract.to_silver(_bronze(spark), "s1").withColumn("run_id", F.lit(run)))
    assert layers.silver_window("2024-01-03", 0, "s1").count() == 24 and layers.silver_window("2024-01-03", 30).count() == 48
    assert {str(r.business_date) for r in layers.silver_for_replay("r1").collect()} == {"2024-01-04"}
    with pytest.raises(ValueError):
        layers.write_gold(spark.createDataFrame([], schemas.GOLD).withColumn("run_id", F.lit("r")))
    silver = layers.read("silver").filter("run_id = 'r1'")
    for source in ("s1", "s2"):
        layers.write_quarantine(silver.withColumn("source_id", F.lit(source)), "why")
    assert layers.read("quarantine").count() == 2 * silver.count()
    card = lambda status: spark.createDataFrame([("r", datetime.date(2024, 1, 2), "s1", 1, {}, 0, 0, 0, 0, 0, status)], schemas.SCORECARD)
    layers.upsert_scorecard(card("GREEN"))
    layers.upsert_scorecard(card("RED"))
    assert [r.overall_status for r in layers.read_scorecard("r").collect()] == ["RED"]
    fixtures = Fixtures(spark, str(tmp_path / "frozen"))
    fixtures.snapshot("s1", _bronze(spark), "clean")
    assert fixtures.names() == [("s1", "clean")] and fixtures.load("s1", "clean").count() == 12
    with pytest.raises(FileNotFoundError):
        fixtures.load("s1", "dirty")


def test_feed_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,x,1.5,10\n")
    row = feeds.read_prices(spark, str(tmp_path / "p.csv")).first()
    assert row["Adj Close"] == 1.5 and row.Low is None and row.Volume == 10
    (tmp_path / "q.csv").write_text("Open,Close\n1,2\n")
    with pytest.raises(ValueError):
        feeds.read_prices(spark, str(tmp_path / "q.csv"))
    (tmp_path / "r.csv").write_text("CURRENCY,TIME_PERIOD,OBS_VALUE\nUSD,2024-01-02,1.09\nUSD,2024-01-03,1.10\nGBP,2024-01-02,0.86\n")
    assert {(r.currency, r.rate) for r in feeds.read_rates(spark, str(tmp_path / "r.csv")).collect()} == {("USD", 1.10), ("GBP", 0.86)}
    (tmp_path / "s.json").write_text(
        '{"cik":"1","entries":[{"form":"8-K","end":"2024-03-01","val":9},{"form":"10-K","end":"2023-12-31","val":5},{"form":"10-Q","end":"2024-01-31","val":6}]}\n{"cik":"2","entries":[{"form":"8-K","end":"2024-03-01","val":7}]}\n{"cik":"3","entries":[]}\n'
    )
    assert {(r.cik, r.val) for r in feeds.read_shares(spark, str(tmp_path / "s.json")).collect()} == {("1", 6.0), ("2", 7.0)}
    universe = feeds.symbols(spark, {"A": {"s1": "a.us"}, "B": {"s2": "b"}})
    rows = spark.createDataFrame([("s1", "a.us"), ("s1", "b")], "source_id string, source_symbol string")
    assert [r.instrument_id for r in feeds.map_symbols(rows, universe).collect()] == ["A"]


def _events(spark, rows):
    start = datetime.datetime(2024, 1, 2)
    return spark.createDataFrame([(i, t, start + datetime.timedelta(minutes=m), a, r, "{}") for i, t, m, a, r in rows], schemas.EVENTS)


def test_event_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    first = [("e1", "dq.passed", 0, "s1", "r1"), ("e2", "dq.passed", 5, "s1", "r2"), ("e1", "dq.passed", 0, "s1", "r1")]
    _events(spark, first).coalesce(1).write.mode("append").parquet(source)
    out = lambda name: (str(tmp_path / name), str(tmp_path / f"{name}-state"))
    streaming.drain(streaming.dedup(streaming.log_stream(spark, source)), *out("dedup"))
    wait = streaming.barrier(streaming.subscribe(streaming.log_stream(spark, source), ["dq.passed", "dq.failure"]), ("s1", "s2"))
    streaming.drain(wait, *out("barrier"))
    assert spark.read.parquet(out("dedup")[0]).count() == 2
    _events(spark, [("e3", "dq.failure", 9, "s2", "r1"), ("e2", "dq.passed", 5, "s1", "r2"), ("e4", "other", 9, "s2", "r2")]).coalesce(1).write.mode("append").parquet(source)
    streaming.drain(streaming.dedup(streaming.log_stream(spark, source)), *out("dedup"))
    streaming.drain(streaming.barrier(streaming.subscribe(streaming.log_stream(spark, source), ["dq.passed", "dq.failure"]), ("s1", "s2")), *out("barrier"))
    assert sorted(r.event_id for r in spark.read.parquet(out("dedup")[0]).collect()) == ["e1", "e2", "e3", "e4"]
    assert [(r.run_id, r.n_sources) for r in spark.read.parquet(out("barrier")[0]).collect()] == [("r1", 2)]
    log, state = out("log")
    streaming.append_log(streaming.log_stream(spark, source), log, state)
    streaming.append_log(streaming.log_stream(spark, source), log, state + "-lost")  # the checkpoint is gone, the log isn't
    rows = spark.read.parquet(log)
    assert rows.count() == 4 and {r.topic: r.n for r in audit.topic_counts(rows).filter("run_id = 'r1'").collect()} == {"dq.passed": 1, "dq.failure": 1}
    streaming.drain(streaming.tumbling_counts(streaming.log_stream(spark, source)), *out("windows"))
    _events(spark, [("late", "dq.passed", 600, "s1", "r9")]).write.mode("append").parquet(source)
    streaming.drain(streaming.tumbling_counts(streaming.log_stream(spark, source)), *out("windows"))
    assert {(r.topic, r.n) for r in spark.read.parquet(out("windows")[0]).collect()} == {("dq.passed", 4), ("dq.failure", 1), ("other", 1)}
