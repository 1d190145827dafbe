"""The decision log and the event log of a run: one entry per batch, election, split and end of a remediation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators import reconcile
from tessera.sources import schemas

BATCH = ["source_id", "business_date"]
#: Columns of the log that a decision determines; its time is added where it is written.
COLUMNS = [c for c in schemas.DECISIONS_LOG.names if c != "ts"]


def _entries(rows: DataFrame, run_id: str, kind: str, agent: str, rule: str, instrument: Column, part: Column, inputs: dict[str, Column], outcome: dict[str, Column], verified: Column) -> DataFrame:
    """One decision a row.  ``part`` tells decisions of one kind, instrument and date apart."""
    if kind not in schemas.DECISIONS:
        raise ValueError(f"unknown decision {kind}")
    named = rows.withColumn("instrument_id", instrument).withColumn("_part", part)
    numbers = F.create_map(*(x for name, c in inputs.items() for x in (F.lit(name), c.cast("double"))))
    return named.select(
        reconcile.decision_id(run_id, kind, "_part").alias("decision_id"), F.lit(agent).alias("agent"), "instrument_id", "business_date", F.lit(kind).alias("decision_type"),
        numbers.alias("inputs"), F.to_json(F.struct(*(c.alias(name) for name, c in outcome.items()))).alias("outcome"), F.lit(rule).alias("rule_applied"), verified.alias("verified"),
    )


def _batch() -> Column:
    return F.concat(F.coalesce("source_id", F.lit("")), F.lit(":batch"))


def _status(good: Column) -> Column:
    return F.when(good, "passed").otherwise("failed")


def contract_decisions(verdicts: DataFrame, run_id: str) -> DataFrame:
    """One per batch and source, of ``contract.verdicts``."""
    return _entries(verdicts, run_id, "CONTRACT", "contract", "silver_contract", _batch(), F.lit(""), {"rows": F.col("n_rows"), "broken": F.col("n_broken")}, {"status": _status(F.col("passed")), "errors": F.col("n_broken")}, F.col("passed"))


def drift_decisions(drifted: DataFrame, run_id: str) -> DataFrame:
    """One per batch of a feed that lacks columns: ``source_id, business_date, n_rows, error``."""
    return _entries(drifted, run_id, "CONTRACT", "contract", "silver_contract", _batch(), F.lit("drift"), {"rows": F.col("n_rows")}, {"status": F.lit("failed"), "error": F.col("error")}, F.lit(False))


def quality_decisions(verdicts: DataFrame, run_id: str) -> DataFrame:
    """One per batch and source, of ``dq.verdicts``."""
    return _entries(verdicts, run_id, "DQ", "quality", "quality_rules", _batch(), F.lit("rules"), {"high": F.col("high"), "medium": F.col("medium")}, {"status": _status(~F.col("failed")), "high": F.col("high"), "medium": F.col("medium")}, ~F.col("failed"))


def anomaly_decisions(silver: DataFrame, anomalies: DataFrame, run_id: str) -> DataFrame:
    """One per batch and source: its rows, outliers, and how many of them are likely errors."""
    found = anomalies.groupBy(*BATCH).agg(F.count("*").alias("outliers"), F.count_if("is_likely_error").alias("errors"))
    rows = silver.groupBy(*BATCH).agg(F.count("*").alias("n_rows")).join(found, BATCH, "left").na.fill(0, ["outliers", "errors"])
    return _entries(rows, run_id, "DQ", "anomaly", "zscore_and_fences", _batch(), F.lit("anomaly"), {"rows": F.col("n_rows")}, {"status": _status(F.col("errors") == 0), "outliers": F.col("outliers"), "errors": F.col("errors")}, F.col("errors") == 0)


def split_decisions(actions: DataFrame, run_id: str) -> DataFrame:
    """One per detected split."""
    return _entries(actions, run_id, "CORP_ACTION", "corporate_actions", "split_ratio", F.col("instrument_id"), F.col("source_id"), {"ratio": F.col("ratio"), "detected_ratio": F.col("detected_ratio")}, {"action": F.col("action_type"), "source": F.col("source_id"), "method": F.col("method")}, F.lit(True))


def remediation_decisions(opened: DataFrame, left: DataFrame, attempts: DataFrame, run_id: str) -> DataFrame:
    """Per date that had breaks: REMEDIATE if none is left, else ESCALATE; ``opened`` and ``left`` are breaks before and after."""
    made = attempts.agg(F.count("bad_source").alias("attempts"))  # one row
    before = opened.groupBy("business_date").agg(F.count("*").alias("n_opened"))
    after = left.groupBy("business_date").agg(F.count("*").alias("n_left"))
    rows = before.join(after, "business_date", "full").na.fill(0, ["n_opened", "n_left"]).crossJoin(F.broadcast(made))
    inputs = {n: F.col(n) for n in ("n_opened", "n_left", "attempts")}
    done = lambda kind, status, test, good: _entries(rows.filter(test), run_id, kind, "remediation", "refetch_and_elect", F.lit("batch"), F.lit(""), inputs, {"status": F.lit(status), "attempts": F.col("attempts")}, F.lit(good))
    return done("REMEDIATE", "remediated", "n_left = 0", True).unionByName(done("ESCALATE", "escalated", "n_left > 0", False))


def ingestion_decisions(counts: DataFrame, run_id: str) -> DataFrame:
    """One per batch that a feed reported: ``source_id, business_date, n_rows``."""
    return _entries(counts, run_id, "INGEST", "ingestion", "landed_files", _batch(), F.lit(""), {"rows": F.col("n_rows")}, {"status": F.lit("landed"), "rows": F.col("n_rows")}, F.lit(True))


def together(*decisions: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (d.select(*COLUMNS) for d in decisions))


def events(decisions: DataFrame, attempts: DataFrame, breaks: DataFrame, run_id: str, reference: tuple[str, ...] = ()) -> DataFrame:
    """What a run's log entries announce, by topic, with the run's own begin and end; ids follow from run and content.

    Elections are announced by date, the rest one by one.  Feeds of reference data pass by the election under a topic
    of their own.
    """
    good = F.col("verified")
    source = F.substring_index("instrument_id", ":", 1)
    topic = (
        F.when((F.col("decision_type") == "INGEST") & source.isin(*reference), "reference_data.complete")
        .when(F.col("decision_type") == "INGEST", "ingestion.complete")
        .when(F.col("decision_type") == "CONTRACT", F.when(good, "contract.passed").otherwise("contract.violation"))
        .when(F.col("agent") == "anomaly", F.when(~good, "anomaly.detected"))
        .when(F.col("decision_type") == "DQ", F.when(good, "dq.passed").otherwise("dq.failure"))
        .when(F.col("decision_type") == "CORP_ACTION", "corporate_action.detected")
        .when(F.col("decision_type") == "REMEDIATE", "remediation.complete")
        .when(F.col("decision_type") == "ESCALATE", "escalation")
    )
    say = lambda **facts: F.to_json(F.struct(*(c.alias(n) for n, c in facts.items())))
    day = F.col("business_date").cast("string")
    single = decisions.filter("decision_type <> 'RECONCILE'").select(topic.alias("topic"), "agent", say(business_date=day, instrument=F.col("instrument_id"), decision=F.col("decision_id"), outcome=F.col("outcome")).alias("payload")).filter("topic IS NOT NULL")
    dated = lambda rows, name: rows.groupBy("business_date").agg(F.count("*").alias("n")).select(F.lit(name).alias("topic"), F.lit("reconciliation").alias("agent"), say(business_date=day, n=F.col("n")).alias("payload"))
    tries = attempts.filter("bad_source IS NOT NULL")
    asked = lambda rows, name: rows.select(F.lit(name).alias("topic"), F.lit("remediation").alias("agent"), say(attempt=F.col("attempt"), source=F.col("bad_source"), days=F.col("lookback_days"), breaks=F.col("n_breaks")).alias("payload"))
    logged = decisions.groupBy("decision_type").agg(F.count("*").alias("n")).select(F.lit("lineage.decision").alias("topic"), F.lit("lineage").alias("agent"), say(decision_type=F.col("decision_type"), n=F.col("n")).alias("payload"))
    ends = attempts.sparkSession.createDataFrame([("run.started", "run", "{}"), ("run.complete", "run", "{}")], "topic string, agent string, payload string")
    rows = reduce(DataFrame.unionByName, (
        single, dated(decisions.filter("decision_type = 'RECONCILE'"), "reconciliation.complete"), dated(breaks, "reconciliation.break"),
        asked(tries.filter("attempt = 1"), "remediation.started"), asked(tries, "remediation.refetch_requested"), asked(tries.filter("outcome = 'refetch_failed'"), "remediation.failed"), logged, ends,
    ))
    ids = X.content_hash(F.lit(run_id), "topic", "payload")
    return rows.select(ids.alias("event_id"), "topic", F.current_timestamp().alias("ts"), "agent", F.lit(run_id).alias("run_id"), "payload")
