"""Stock splits: detection within a source and across sources, precedence, and the back-adjusted view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import CorporateActions
from tessera.sources import schemas

SERIES = ("instrument_id", "source_id")


def previous_close(silver: DataFrame, days: int | None = None) -> DataFrame:
    """Closes with the latest earlier one of their series, at most ``days`` before: a strict backward as-of lookup."""
    rows = silver.filter("field = 'CLOSE'")
    order = W.partitionBy(*SERIES).orderBy(F.unix_date("business_date"))
    w = order.rangeBetween(W.unboundedPreceding if days is None else -days, -1)
    return rows.withColumn("prev_close", F.max_by("value", "business_date").over(w))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` strictly before its own ``time``, as ``asof_value``.

    Both sides are laid in one order and carried forward, so one shuffle does it and no pairs are formed.  Of equal
    times on the right the largest value counts.
    """
    marked = left.withColumn("_row", F.struct(*left.columns)).select(*keys, F.col(time).alias("_t"), "_row", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(0).alias("_side"))
    facts = right.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(1).alias("_side"))
    w = W.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, -1)
    both = marked.unionByName(facts).withColumn("asof_value", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 0").select("_row.*", "asof_value")


def _candidate(ratio: Column, settings: CorporateActions) -> Column:
    return X.nearest_candidate(ratio, settings.candidates, settings.ratio_tolerance)


def single_source(silver: DataFrame, settings: CorporateActions) -> DataFrame:
    """Falls of a series' close that look like a split: earlier close over close near a candidate ratio."""
    return _falls(previous_close(silver, settings.window_days), settings)


def _falls(closes: DataFrame, settings: CorporateActions) -> DataFrame:
    rows = closes.filter("value > 0 AND prev_close > 0").withColumn("detected_ratio", F.col("prev_close") / F.col("value"))
    return rows.withColumn("ratio", _candidate(F.col("detected_ratio"), settings)).filter("ratio IS NOT NULL").select(*SERIES, "business_date", F.lit("SPLIT").alias("action_type"), "ratio", "detected_ratio")


def _days(silver: DataFrame, settings: CorporateActions) -> DataFrame:
    """Per instrument and day the sources' closes and the ones before them, by source."""
    side = F.struct("source_id", F.col("value").alias("now"), F.col("prev_close").alias("before"))
    return previous_close(silver, settings.window_days).filter("value > 0").groupBy("instrument_id", "business_date").agg(F.array_sort(F.collect_list(side)).alias("s"))


def cross_source(silver: DataFrame, settings: CorporateActions) -> DataFrame:
    """Sources whose closes of a day differ by a candidate ratio: one of the two hasn't adjusted.

    It is the one whose own history jumps by that ratio, the first before the second; failing both, the higher one.
    One action per instrument, day and source: that of the first pair in source order.  Pairs are formed inside a
    day's array of sources, which is as short as there are sources.
    """
    return _gaps(_days(silver, settings), settings)


def _gaps(days: DataFrame, settings: CorporateActions) -> DataFrame:
    later = lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = days.select("instrument_id", "business_date", F.posexplode(F.flatten(F.transform("s", later))).alias("nth", "p")).select("*", "p.a", "p.b")
    pairs = pairs.withColumn("detected_ratio", F.greatest("a.now", "b.now") / F.least("a.now", "b.now")).withColumn("ratio", _candidate(F.col("detected_ratio"), settings)).filter("ratio IS NOT NULL")
    own = lambda s: F.coalesce((F.col(f"{s}.before") > 0) & (F.abs(F.col(f"{s}.before") / F.col(f"{s}.now") - F.col("ratio")) / F.col("ratio") <= settings.ratio_tolerance), F.lit(False))
    behind = F.when(own("a"), F.col("a.source_id")).when(own("b"), F.col("b.source_id")).when(F.col("a.now") > F.col("b.now"), F.col("a.source_id")).otherwise(F.col("b.source_id"))
    return pairs.withColumn("source_id", behind).groupBy(*SERIES, "business_date").agg(F.lit("SPLIT").alias("action_type"), F.min_by(F.struct("ratio", "detected_ratio"), "nth").alias("m")).select(*SERIES, "business_date", "action_type", "m.*")


def actions(silver: DataFrame, settings: CorporateActions) -> DataFrame:
    """Both kinds of detection, with ``method``; of one instrument, source and day the cross-source one stands.

    Both read the same closes by day, whose shuffle is made once.
    """
    days = _days(silver, settings)
    closes = days.select("instrument_id", "business_date", F.explode("s").alias("c")).select("instrument_id", "business_date", F.col("c.source_id").alias("source_id"), F.col("c.now").alias("value"), F.col("c.before").alias("prev_close"))
    both = _falls(closes, settings).withColumn("method", F.lit("single")).unionByName(_gaps(days, settings).withColumn("method", F.lit("cross")))
    first = F.row_number().over(W.partitionBy(*SERIES, "business_date").orderBy("method"))  # "cross" before "single"
    return both.withColumn("_first", first).filter("_first = 1").drop("_first")


def back_adjusted(silver: DataFrame, splits: DataFrame) -> DataFrame:
    """A view of ``silver`` with every row divided (volume: multiplied) by the ratios of all later splits of its series.

    Nothing is rewritten, so adjusting twice from the same rows is adjusting once.  A series' splits are an array, of
    a handful of entries; factors multiply in order of date.  ``adjustment`` is the product.
    """
    listed = splits.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("business_date", "ratio"))).alias("_splits"))
    rows = silver.join(listed, list(SERIES), "left")
    later = F.filter("_splits", lambda s: s["business_date"] > F.col("business_date"))
    rows = rows.withColumn("adjustment", F.coalesce(F.aggregate(later, X.double(1), lambda p, s: p * s["ratio"]), X.double(1))).drop("_splits")
    value = F.when(F.col("field").isin(*schemas.PRICE_FIELDS), F.col("value") / F.col("adjustment")).when(F.col("field") == "VOLUME", F.col("value") * F.col("adjustment")).otherwise(F.col("value"))
    return rows.withColumns({"value": value, "ca_adjusted": F.col("adjustment") != 1})
