"""The five data-quality rules, batch verdicts and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import Config, Quality
from tessera.operators import contract

COLUMNS = ("rule", "severity", "source_id", "instrument_id", "business_date", "field", "value", "reason")


def _failures(rows: DataFrame, rule: str, quality: Quality, reason: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(quality.severities[rule]).alias("severity"), "source_id", "instrument_id", "business_date", "field", "value", reason.alias("reason"), *keep)


def null_check(silver: DataFrame, quality: Quality) -> DataFrame:
    return _failures(silver.filter(X.tidy(F.col("value")).isNull()), "null_check", quality, F.lit("value is null"))


def range_check(silver: DataFrame, quality: Quality) -> DataFrame:
    """Values below the minimum; volume is exempt, the minimum itself passes."""
    low = (F.col("field") != "VOLUME") & (X.tidy(F.col("value")) < X.double(quality.range_min))
    return _failures(silver.filter(low), "range_check", quality, F.lit(f"below {quality.range_min:g}"))


def staleness_check(silver: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows fetched more days before their business date than their source allows; columns to ``keep`` go along."""
    lag = F.date_diff(F.col("business_date"), F.to_date("fetch_ts"))
    limit = F.coalesce(*(F.when(F.col("source_id") == s.source_id, s.staleness_max_days) for s in config.sources), F.lit(1))
    rows = silver.filter(lag > limit)
    return _failures(rows, "staleness_check", config.quality, F.concat(F.lit("fetched "), lag.cast("string"), F.lit(" days before")), keep)


def monotonicity_check(silver: DataFrame, quality: Quality) -> DataFrame:
    """High under low, and open or close outside of low to high; one row can break several."""
    wide = contract.pivot_ohlc(silver.filter(F.col("field").isin("OPEN", "HIGH", "LOW", "CLOSE")))
    case = lambda test, field, value, reason: F.when(test, F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(reason).alias("reason")))
    high, low = F.col("HIGH"), F.col("LOW")
    cases = [case(high < low, "HIGH/LOW", high - low, "HIGH < LOW")]
    for name in ("OPEN", "CLOSE"):
        cases += [case(F.col(name) > high, name, F.col(name), f"{name} > HIGH"), case(F.col(name) < low, name, F.col(name), f"{name} < LOW")]
    rows = wide.select("source_id", "instrument_id", "business_date", F.explode(F.array_compact(F.array(*cases))).alias("c")).select("*", "c.*")
    return _failures(rows, "monotonicity_check", quality, F.col("reason"))


def duplicate_check(silver: DataFrame, quality: Quality, keys: tuple[str, ...] = ("instrument_id", "business_date", "field", "source_id"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Second and later rows of a key, in order of value; columns to ``keep`` go along."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("value"))
    return _failures(silver.withColumn("_nth", nth).filter("_nth > 1"), "duplicate_check", quality, F.lit("duplicate key"), keep)


def failures(silver: DataFrame, config: Config) -> DataFrame:
    """All failures of the enabled rules."""
    quality = config.quality
    checks = {
        "null_check": lambda: null_check(silver, quality), "range_check": lambda: range_check(silver, quality), "staleness_check": lambda: staleness_check(silver, config),
        "monotonicity_check": lambda: monotonicity_check(silver, quality), "duplicate_check": lambda: duplicate_check(silver, quality),
    }
    found = None
    for rule in quality.enabled:
        if rule == "staleness_check" and "fetch_ts" not in silver.columns:
            continue
        rows = checks[rule]()
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else null_check(silver.limit(0), quality)


def summary(found: DataFrame) -> DataFrame:
    """Per rule: failures, instruments and severity."""
    return found.groupBy("rule").agg(F.count("*").alias("n_failures"), F.count_distinct("instrument_id").alias("n_instruments"), F.min("severity").alias("severity"))


def verdicts(silver: DataFrame, found: DataFrame) -> DataFrame:
    """Per source and date: failures by severity and whether the batch failed, which any failure makes it do."""
    counts = found.groupBy("source_id", "business_date").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    batches = silver.select("source_id", "business_date").distinct()
    rows = batches.join(counts, ["source_id", "business_date"], "left").na.fill(0, ["high", "medium"])
    return rows.withColumn("failed", F.col("high") + F.col("medium") > 0)


def quarantine(silver: DataFrame, found: DataFrame) -> DataFrame:
    """All rows of an instrument and field, by source and date, with a high-severity failure.  A copy: silver keeps them."""
    keys = ["instrument_id", "field", "source_id", "business_date"]
    return silver.join(found.filter("severity = 'high'").select(*keys), keys, "left_semi")
