"""Decision log, lineage, scorecards, exports and the replay proof."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import functions as X


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``: upsert semantics.  Rows are compared as structs, so partial results
    meet in the shuffle and no key's rows are sorted in one task."""
    top = F.max_by(F.struct(*rows.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return rows.groupBy(*keys).agg(top.alias("_top")).select("_top.*")


def insert_ignore(there: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``there`` and those rows of ``new`` whose key it lacks; of rows with one key the first in ``order`` counts."""
    both = there.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    rows = both.groupBy(key).agg(F.min_by(F.struct(*both.columns), F.struct("_late", *order)).alias("_r"))
    return rows.select("_r.*").drop("_late")


def lineage(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """Golden records with their decisions' inputs and rules; a record without a decision keeps nulls."""
    return gold.join(decisions.select("decision_id", "inputs", "rule_applied", "verified"), "decision_id", "left")


def decision_counts(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys, "decision_type").agg(F.count("*").alias("n"))


def status(escalations: Column, remediations: Column) -> Column:
    return F.when(escalations > 0, "RED").when(remediations > 0, "AMBER").otherwise("GREEN")


def scorecard_from_decisions(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by decision type: every escalation and remediation decision counts as an attempt."""
    n = lambda kind: F.count_if(F.col("decision_type") == kind)
    rows = decisions.groupBy(*keys).agg(n("ESCALATE").alias("escalations"), n("REMEDIATE").alias("remediations_succeeded"), n("CORP_ACTION").alias("corporate_actions_detected"))
    both = F.col("escalations") + F.col("remediations_succeeded")
    return rows.withColumns({"breaks_detected": both, "remediations_attempted": both, "overall_status": status(F.col("escalations"), F.col("remediations_succeeded"))})


def scorecard(run_id: str, silver: DataFrame, failures: DataFrame, breaks: DataFrame, actions: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per date and source that counts things, not log lines: rows, failures by rule, breaks in which the
    source dissents, splits of its series, attempts to fetch it again, and escalations of the run.
    """
    keys = ["business_date", "source_id"]
    rows = silver.groupBy(*keys).agg(F.count("*").alias("records_ingested"))
    by_rule = failures.groupBy(*keys, "rule").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("dq_failures_by_rule"))
    broken = breaks.select("business_date", F.explode("dissenting_sources").alias("source_id")).groupBy(*keys).agg(F.count("*").alias("breaks_detected"))
    splits = actions.groupBy(*keys).agg(F.count("*").alias("corporate_actions_detected"))
    tries = attempts.filter("bad_source IS NOT NULL").groupBy(F.col("bad_source").alias("source_id")).agg(F.count("*").alias("remediations_attempted"), F.lit(0).alias("_"))
    ends = attempts.agg(F.count_if(F.col("outcome") == "escalated").alias("escalations"), F.count_if(F.col("outcome") == "remediated").alias("_ok"))
    for other, on in ((by_rule, keys), (broken, keys), (splits, keys), (tries.drop("_"), ["source_id"])):
        rows = rows.join(other, on, "left")
    rows = rows.crossJoin(F.broadcast(ends)).na.fill(0, ["breaks_detected", "corporate_actions_detected", "remediations_attempted"])  # ends is one row
    rows = rows.withColumns({"run_id": F.lit(run_id), "remediations_succeeded": F.least("_ok", "remediations_attempted"), "dq_failures_by_rule": F.coalesce("dq_failures_by_rule", F.create_map().cast("map<string,bigint>"))})
    rows = rows.withColumn("overall_status", status(F.col("escalations"), F.col("remediations_attempted")))
    from tessera.sources import schemas

    return rows.select(*schemas.SCORECARD.names)


def replay_difference(stored: DataFrame, replayed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one table that the other lacks, counted with multiplicity, with ``side``; none if they are equal.

    One shuffle: both sides' rows are counted per value, not joined.
    """
    both = stored.select(*columns, F.lit(1).alias("_n")).unionByName(replayed.select(*columns, F.lit(-1).alias("_n")))
    rows = both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")
    return rows.withColumn("side", F.when(F.col("surplus") > 0, "stored").otherwise("replayed"))


def topic_counts(events: DataFrame, key: str = "run_id") -> DataFrame:
    return events.groupBy(key, "topic").agg(F.count("*").alias("n"))


def narrative(counts: DataFrame) -> str:
    """A run's events told in fixed words, from counts by topic (``topic, n``); made without any model."""
    rows = counts.groupBy("topic").agg(F.sum("n").alias("n")).orderBy("topic").collect()  # one row per topic
    return "Nothing happened." if not rows else "The run saw " + ", ".join(f"{r.n} x {r.topic}" for r in rows) + "."


def to_json(lineage_rows: DataFrame, scorecard_rows: DataFrame) -> DataFrame:
    """One JSON document a line: golden records with their lineage, then scorecard rows; written by ``.write.text``."""
    part = lambda rows, kind: rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("value"))
    return part(lineage_rows, "lineage").unionByName(part(scorecard_rows, "scorecard"))


def to_html(scorecard_rows: DataFrame, lineage_rows: DataFrame, limit: int = 1000) -> str:
    """A report page that refers to nothing outside itself: the whole scorecard, and the first golden records by key as
    a page holds them (``limit``; the JSON export has all).  The page says how many it leaves out.
    """
    colours = {"RED": "#c0392b", "AMBER": "#d68910", "GREEN": "#1e8449"}

    def body(rows: DataFrame) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
        lines = []
        for row in rows.collect():
            cells = "".join(f'<td style="color:{colours[v]}">{v}</td>' if c == "overall_status" and v in colours else f"<td>{escape(str(v)) if v is not None else ''}</td>" for c, v in row.asDict().items())
            lines.append(f"<tr>{cells}</tr>")
        return f"<table><tr>{head}</tr>{''.join(lines)}</table>"

    first = lineage_rows.orderBy("business_date", "instrument_id", "field").limit(limit)
    left_out = max(lineage_rows.count() - limit, 0)
    note = f"<p>{left_out} more golden records are left out here.</p>" if left_out else ""
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Run report</title></head><body><h1>Scorecard</h1>{body(scorecard_rows.orderBy('business_date', 'source_id'))}<h1>Golden records</h1>{body(first)}{note}</body></html>"


def number_of_sources(reported: DataFrame, run: str, source: str, enabled: int) -> DataFrame:
    """Runs that all enabled sources have reported to: the barrier, in batch."""
    rows = reported.groupBy(run).agg(F.count_distinct(source).alias("n_sources"))
    return rows.withColumn("complete", F.col("n_sources") >= enabled)


def numbered(rows: DataFrame, key: str, ts: str, order: list[str], grain: str = "hour") -> DataFrame:
    """``rows`` with ``place``, their number within ``key`` in order of ``ts`` and ``order``.

    Rows are ranked within an hour of their key, and begin where the hours before end; so a key that holds most rows is
    ranked by many tasks.  The sums run over counts, a row per key and hour.
    """
    cut = rows.withColumn("_hour", F.date_trunc(grain, F.col(ts)))
    counts = cut.groupBy(key, "_hour").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_hour").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("_key"), F.col("_hour").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(W.partitionBy(key, "_hour").orderBy(ts, *order)))
    met = ranked.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_hour").eqNullSafe(F.col("_of")))
    return met.withColumn("place", F.col("_before") + F.col("_rank")).select(*rows.columns, "place")
