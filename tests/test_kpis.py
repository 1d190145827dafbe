"""Targets of the whole run: remediation, accuracy, false alarms, replay, time; and the command line."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import config as C
from tessera.operators import contract, inject, reconcile
from tessera.plans import engine
from tessera.sources import feeds, live
from tessera.sources.layers import Fixtures, Layers

SF = "/root/testdata/sf0.001"


def _bronze(spark, instruments, days=1):
    rows = [(datetime.datetime(2024, 1, 2) + datetime.timedelta(days=d), *(100.0 + k + x for x in (0, 5, -5, 1, 1)), 1000 + k, f"I{k}", f"i{k}", datetime.datetime(2024, 1, 2, 21) + datetime.timedelta(days=d)) for k in range(instruments) for d in range(days)]
    return spark.createDataFrame(rows, "Date timestamp, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint, instrument_id string, source_symbol string, fetch_ts timestamp")


def test_fifty_instruments_of_three_sources_within_a_minute(spark, tmp_path):
    bronze = _bronze(spark, 50)
    began = time.monotonic()
    layers = Layers(spark, str(tmp_path))
    result = engine.run(spark, layers, {s: bronze for s in ("s1", "s2", "s3")}, C.Config(), "r")
    assert result.gold.count() == 300 and result.breaks.count() == 0
    took = time.monotonic() - began
    print(f"50 instruments of 3 sources: {took:.1f} s")
    assert took < 60
    assert {r.overall_status for r in result.scorecard.collect()} == {"GREEN"}  # healthy data: no false alarm
    assert engine.replay(layers, "r", C.Config()).count() == 0


def test_most_defects_heal(spark, tmp_path):
    bronze = _bronze(spark, 5)
    settings = C.Config(sources=(C.Source("s1"), C.Source("s2")))
    healed = 0
    for name in ("null_burst", "out_of_range", "cross_source_break"):
        bad = inject.scenario(bronze, name)
        if name == "null_burst":
            bad = bad.withColumn("Close", F.lit(None).cast("double"))
        silver = contract.to_silver(bronze, "s1").unionByName(contract.to_silver(bad, "s2"))
        layers = Layers(spark, str(tmp_path / name))
        from tessera.operators import remediation

        steps = iter(range(100))

        def store(frame):
            path = f"{layers.root}/{next(steps)}"
            frame.write.parquet(path)
            return spark.read.parquet(path)

        elected, _, log, _ = remediation.remediate(spark, silver, settings, lambda s, d: contract.to_silver(bronze, s), name, store)
        healed += log.filter("outcome = 'remediated'").count()
        assert reconcile.breaks(elected).count() == 0
    assert healed / 3 >= 0.8


def test_golden_values_are_the_true_ones(spark):
    rows = feeds.feed(spark, SF)
    truth = rows.filter("source_id = 's1'").select("instrument_id", "business_date", F.col("value").alias("true"))
    gold = reconcile.gold(reconcile.reconcile(rows, C.Config()), "r").join(truth, ["instrument_id", "business_date"])
    close = gold.filter(F.abs(F.col("golden_value").cast("double") - F.col("true")) / F.col("true") <= 0.0025).count()
    assert close / truth.count() >= 0.99


def test_fetching(spark, tmp_path):
    (tmp_path / "a.us-20240102").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,7\n")
    (tmp_path / "b.us-20240102").write_text("No data\n")
    live.register(spark)
    read = lambda symbols: spark.read.format("daily_bars").option("url", f"file://{tmp_path}/{{symbol}}-{{compact_date}}").option("symbols", symbols).option("date", "2024-01-02").option("retries", "2").option("backoff", "0").load()
    assert [(r.symbol, r.Close, r["Adj Close"]) for r in read("a.us").collect()] == [("a.us", 1.5, 1.5)]
    with pytest.raises(Exception, match="no daily bars"):
        read("a.us,b.us").collect()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    path = str(tmp_path / "bars")
    _bronze(spark, 3).write.parquet(path)
    root = str(tmp_path / "root")
    assert cli.main(["run", "--root", root, "--run-id", "r", "--source", f"a={path}", "--source", f"b={path}", "--date", "2024-01-02"]) == 0
    assert cli.main(["replay", "--root", root, "--run-id", "r"]) == 0
    assert cli.main(["inject", "split_2to1", "--root", root, "--source", f"a={path}"]) == 0
    assert cli.main(["sql", "--root", root, "SELECT count(*) AS n FROM gold"]) == 0
    assert "identical" in capsys.readouterr().out
    report = (tmp_path / "root" / "report" / "r.html").read_text()
    assert "Scorecard" in report and "run.complete" in (tmp_path / "root" / "report" / "r.txt").read_text()
    bad = str(tmp_path / "bad")
    inject.inject(spark.read.parquet(path), "cross_source_break", column="Close").write.parquet(bad)
    assert cli.main(["run", "--root", root, "--run-id", "heal", "--source", f"a={path}", "--source", f"b={bad}", "--refetch", f"b={path}", "--date", "all"]) == 0
    done = Layers(spark, root).read("decisions").filter("decision_type IN ('REMEDIATE', 'ESCALATE')").collect()
    assert [r.decision_type for r in done] == ["REMEDIATE"]
    assert cli.main(["run", "--root", root, "--run-id", "none", "--source", f"a={path}"]) == 0  # yesterday has no bars
    assert cli.main(["synthesize", "--root", root, "--source", "a", "--source", "b", "--instrument", "X", "--instrument", "Y", "--date", "2024-01-02"]) == 0
    assert cli.main(["freeze", "--root", root, "--source", f"a={path}", "--tag", "kept"]) == 0
    frozen = Fixtures(spark, f"{root}/fixtures")
    assert frozen.load("a", "synthetic").exceptAll(frozen.load("b", "synthetic")).count() == 0 and frozen.load("a", "kept").count() == 3
    C.refuse_secrets({"PATH": "x", "OTHER_API_KEY": "y"})
    with pytest.raises(RuntimeError):
        C.refuse_secrets({"TESSERA_API_KEY": "y"})
