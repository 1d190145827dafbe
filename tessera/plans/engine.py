"""The whole run as one dependency graph of pure stages, with files at its edges."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import anomaly, audit, contract, corporate_actions, dq, log, reconcile, remediation
from tessera.sources import schemas
from tessera.sources.layers import Layers

#: Anything but price: what feeds of other kinds become; a new source is an entry here and in the settings.
NORMALISERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"price": contract.to_silver, "rates": contract.rates_to_silver, "shares": contract.shares_to_silver}


@dataclass(frozen=True)
class Result:
    silver: DataFrame
    violations: DataFrame
    failures: DataFrame
    anomalies: DataFrame
    actions: DataFrame
    gold: DataFrame
    breaks: DataFrame
    decisions: DataFrame
    attempts: DataFrame
    scorecard: DataFrame
    lineage: DataFrame
    events: DataFrame


def conform(spark: SparkSession, bronze: Mapping[str, DataFrame], kinds: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All feeds as canonical rows, and what of feeds that lack a column cannot be: their rows as JSON.

    The others go on; the second result is ``source_id, business_date, error, payload``.
    """
    rows = spark.createDataFrame([], schemas.SILVER)
    drifted = spark.createDataFrame([], "source_id string, business_date date, error string, payload string")
    for source_id, frame in bronze.items():
        kind = (kinds or {}).get(source_id, "price")
        if kind not in NORMALISERS:
            raise ValueError(f"unknown kind of feed {kind}")
        try:
            rows = rows.unionByName(NORMALISERS[kind](frame, source_id))
        except (KeyError, AnalysisException) as error:
            day = F.to_date("Date") if "Date" in frame.columns else F.lit(None).cast("date")
            payload = F.to_json(F.struct(*(F.col(f"`{c}`") for c in frame.columns))) if frame.columns else F.lit("{}")
            told = str(error.args[0] if isinstance(error, KeyError) else error.getCondition())
            drifted = drifted.unionByName(frame.select(F.lit(source_id).alias("source_id"), day.alias("business_date"), F.lit(told).alias("error"), payload.alias("payload")))
    return rows, drifted


def run(spark: SparkSession, layers: Layers, bronze: Mapping[str, DataFrame], config: Config, run_id: str, kinds: Mapping[str, str] | None = None, refetch: Callable[[str, int], DataFrame | None] | None = None) -> Result:
    """Conform, check, detect, adjust, elect, remediate and account for a run; all dates and instruments at once.

    Silver, quarantine, gold, decisions, events and scorecard are written; the silver that five stages read is read
    back from its files instead of being made five times.  Elections see split-adjusted prices.  A feed that lacks a
    column is quarantined with a failed decision.  An empty run writes an empty scorecard and its two events.
    """
    steps = iter(range(1_000_000))

    def store(frame: DataFrame) -> DataFrame:
        path = f"{layers.root}/work/{run_id}/{next(steps)}"
        frame.write.mode("overwrite").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    rows, drifted = conform(spark, bronze, kinds)
    drifted = store(drifted)
    layers.write_quarantine(drifted.withColumn("run_id", F.lit(run_id)), "schema_drift")
    judged = store(contract.verdicts(rows))
    accepted, rejected = contract.split(rows)
    layers.write_silver(accepted.withColumn("run_id", F.lit(run_id)))
    layers.write_quarantine(rejected.withColumn("run_id", F.lit(run_id)), "schema_violation")
    written = layers.read("silver")
    silver = spark.createDataFrame([], schemas.SILVER) if written is None else written.filter(F.col("run_id") == run_id).select(*schemas.SILVER.names)
    failures = store(dq.failures(silver, config))
    layers.write_quarantine(dq.quarantine(silver, failures).withColumn("run_id", F.lit(run_id)), "high_severity")
    prices = silver.filter(F.col("source_id").isin(*config.voters))
    splits = store(corporate_actions.actions(prices, config.corporate_actions))
    anomalies = store(anomaly.classify(silver, config.anomaly))

    def adjusted(rows: DataFrame) -> DataFrame:
        return corporate_actions.back_adjusted(rows, corporate_actions.actions(rows, config.corporate_actions)).select(*schemas.SILVER.names)

    def again(source_id: str, days: int) -> DataFrame | None:
        return None if refetch is None else refetch(source_id, days)

    elected, _, attempts, opened = remediation.remediate(spark, adjusted(prices), config, again, run_id, store)
    gold, breaks = reconcile.gold(elected, run_id), reconcile.breaks(elected)
    landed = judged.select(*log.BATCH, "n_rows").unionByName(drifted.groupBy(*log.BATCH).agg(F.count("*").alias("n_rows")))
    lacking = drifted.groupBy(*log.BATCH).agg(F.count("*").alias("n_rows"), F.min("error").alias("error"))
    decisions = store(log.together(
        log.ingestion_decisions(landed, run_id), log.contract_decisions(judged, run_id), log.drift_decisions(lacking, run_id), log.quality_decisions(dq.verdicts(silver, failures), run_id),
        log.anomaly_decisions(silver, anomalies, run_id), log.split_decisions(splits, run_id), log.remediation_decisions(opened, breaks, attempts, run_id), reconcile.decisions(elected, run_id),
    ))
    if not gold.isEmpty():
        layers.write_gold(gold.withColumn("run_id", F.lit(run_id)))
    layers.append_new("decisions", decisions.withColumn("ts", F.current_timestamp()), "decision_id")
    reference = tuple(s for s in bronze if (kinds or {}).get(s, "price") != "price")
    events = store(log.events(decisions, attempts, breaks, run_id, reference))
    layers.append_new("events", events, "event_id")
    card = audit.scorecard(run_id, silver, failures, breaks, splits, attempts)
    layers.upsert_scorecard(card)
    return Result(silver, contract.violations(rejected), failures, anomalies, splits, gold, breaks, decisions, attempts, card, audit.lineage(gold, decisions), events)


def replay(layers: Layers, run_id: str, config: Config) -> DataFrame:
    """Differences between a run's stored gold and its recomputation from silver, ids included; none proves the run."""
    silver = layers.read("silver").filter(F.col("run_id") == run_id).select(*schemas.SILVER.names)
    prices = silver.filter(F.col("source_id").isin(*config.voters))
    rows = corporate_actions.back_adjusted(prices, corporate_actions.actions(prices, config.corporate_actions)).select(*schemas.SILVER.names)
    fresh = reconcile.gold(reconcile.reconcile(rows, config), run_id)
    stored = layers.read("gold").filter(F.col("run_id") == run_id)
    return audit.replay_difference(stored.select(*fresh.columns), fresh, fresh.columns)
