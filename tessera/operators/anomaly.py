"""Statistical anomalies against a rolling window of calendar days, aware of volatility regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import Anomaly

SERIES = ("source_id", "instrument_id", "field")


def history(days: int) -> WindowSpec:
    """The days before a row's date, itself excluded; calendar days, not rows."""
    return W.partitionBy(*SERIES).orderBy(F.unix_date("business_date")).rangeBetween(-days, -1)


def rolling_stats(silver: DataFrame, days: int) -> DataFrame:
    """Count, mean and sample deviation of the days before each row."""
    w = history(days)
    return silver.withColumns({"hist_n": F.count("value").over(w), "hist_mean": F.avg("value").over(w), "hist_std": F.stddev_samp("value").over(w)})


def zscore() -> Column:
    """Of rows with at least three earlier values that differ; else null.  Needs ``rolling_stats``."""
    return F.when((F.col("hist_n") >= 3) & (F.col("hist_std") > 0), (F.col("value") - F.col("hist_mean")) / F.col("hist_std"))


def fences(silver: DataFrame, settings: Anomaly) -> DataFrame:
    """Exact quartiles of the days before, and the fences beyond which a value is an outlier."""
    w = history(settings.window_days)
    rows = silver.withColumns({"q1": F.percentile("value", F.lit(0.25)).over(w), "q3": F.percentile("value", F.lit(0.75)).over(w)})
    reach = X.double(settings.iqr_multiplier) * (F.col("q3") - F.col("q1"))
    return rows.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})


def daily_returns(silver: DataFrame) -> DataFrame:
    """Change against the previous value of the series."""
    before = F.lag("value").over(W.partitionBy(*SERIES).orderBy("business_date"))
    return silver.withColumn("prev_value", before).withColumn("return", F.col("value") / F.when(F.col("prev_value") != 0, F.col("prev_value")) - 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, X.double(0), lambda s, x: s + x)


def _deviation(values: Column) -> Column:
    """Sample deviation of an array; null for fewer than two values."""
    n = F.size(values)
    squares = lambda mean: _total(F.transform(values, lambda x: (x - mean) * (x - mean)))
    return F.when(n >= 2, X.let(_total(values) / n, lambda mean: F.sqrt(squares(mean) / (n - 1))))


def regime_ratio(silver: DataFrame, settings: Anomaly) -> DataFrame:
    """Deviation of the most recent returns over that of all returns inside the window, as ``regime_ratio``.

    Returns are formed inside the window, so its first value has none; an array of a window's values is bounded by
    the window's days.
    """
    rows = silver.withColumn("_values", F.collect_list("value").over(history(settings.window_days)))
    n = F.size("_values")
    returns = F.zip_with(F.slice("_values", F.lit(2), n - 1), F.slice("_values", F.lit(1), n - 1), lambda b, a: b / F.when(a != 0, a) - 1)
    recent = lambda r: F.slice(r, -F.least(F.lit(settings.regime_window), F.size(r)), F.lit(settings.regime_window))
    ratio = X.let(returns, lambda r: X.let(_deviation(r), lambda long: F.when(long > 0, X.let(recent(r), _deviation) / long)))
    return X.once(rows, "regime_ratio", F.when(n >= 4, ratio)).drop("_values")


def classify(silver: DataFrame, settings: Anomaly) -> DataFrame:
    """Outliers by z-score or fences, with ``zscore, iqr_outlier, is_likely_error, reason``.

    A z-score outlier in a regime of raised volatility is no error.  All statistics share one shuffle by series.
    """
    rows = regime_ratio(fences(rolling_stats(silver, settings.window_days), settings), settings).withColumn("zscore", zscore())
    by_z = F.abs("zscore") > settings.zscore_threshold
    by_fence = (F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high"))
    regime = by_z & F.coalesce(F.col("regime_ratio") > settings.regime_ratio, F.lit(False)) if settings.volatility_aware else F.lit(False)
    rows = rows.filter(F.col("zscore").isNotNull() & (by_z | by_fence))
    return rows.select(*SERIES, "business_date", "value", "zscore", by_fence.alias("iqr_outlier"), (~regime).alias("is_likely_error"), F.when(regime, "volatility_regime").when(by_z, "zscore_exceeded").otherwise("iqr_fence").alias("reason"))
