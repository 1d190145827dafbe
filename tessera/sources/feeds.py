"""Feed readers: landed files of each provider, and views that make feeds of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import double
from tessera.sources import schemas


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars as CSV with a header.  A file without ``Date`` is an error; without ``Adj Close`` that is ``Close``."""
    raw = spark.read.option("header", True).csv(path)
    if missing := schemas.missing_columns(raw.columns, ["Date", "Open", "High", "Low", "Close", "Volume"]):
        raise ValueError(f"price file lacks {', '.join(missing)}")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    adjusted = number("Adj Close") if "Adj Close" in raw.columns else number("Close")
    return raw.select(
        F.col("Date").try_cast("timestamp").alias("Date"), *(number(c).alias(c) for c in ("Open", "High", "Low", "Close")),
        adjusted.alias("Adj Close"), F.col("Volume").try_cast("bigint").alias("Volume"),
        *(F.col(c) for c in raw.columns if c in ("instrument_id", "source_symbol", "fetch_ts")),
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Reference rates as CSV (``CURRENCY, TIME_PERIOD, OBS_VALUE``): the last value of each currency."""
    raw = spark.read.option("header", True).csv(path)
    rate = F.max_by(F.col("OBS_VALUE").try_cast("double"), F.col("TIME_PERIOD"))
    return raw.groupBy(F.col("CURRENCY").alias("currency")).agg(rate.alias("rate"), F.max("TIME_PERIOD").cast("timestamp").alias("Date"))


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """Company facts as JSON, one document a line with ``cik`` and ``entries``: the latest entry by ``end``.

    Annual and quarterly filings come first; only a company without either falls back on the rest.  Companies without
    entries vanish.
    """
    facts = spark.read.schema("cik string, entries array<struct<form:string,end:string,filed:string,val:double>>").json(path)
    return latest_filing(facts.select("cik", F.explode("entries").alias("e")).select("cik", "e.*"))


def latest_filing(entries: DataFrame) -> DataFrame:
    preferred = F.col("form").isin("10-K", "10-Q")
    top = F.max_by(F.struct("end", "form", "filed", "val"), F.struct(preferred.alias("p"), F.coalesce("end", F.lit("")).alias("e"), "val"))
    return entries.groupBy("cik").agg(top.alias("t")).select("cik", "t.*")


def symbols(spark: SparkSession, universe: dict[str, dict[str, str]]) -> DataFrame:
    """A universe (instrument to source to symbol) as rows ``instrument_id, source_id, source_symbol``."""
    rows = [(i, s, symbol) for i, own in sorted(universe.items()) for s, symbol in sorted(own.items())]
    return spark.createDataFrame(rows, "instrument_id string, source_id string, source_symbol string")


def map_symbols(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Canonical instruments by source and symbol; rows of symbols that the universe doesn't know vanish."""
    return rows.join(universe, ["source_id", "source_symbol"])


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close prices of every part by three sources on every day that has events.

    ``s2`` strays by up to 15 basis points, ``s3`` is a tenth too high every tenth day, every thirteenth part splits 2:1
    from the sixteenth day on.  The days are a distinct aggregate of one small column and the only broadcast side.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    ts = F.col("ts")
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(ts.cast("date").alias("business_date"), (F.dayofmonth(ts) - 1).alias("d")).distinct()
    sources = F.explode(F.array(*map(F.lit, ("s1", "s2", "s3"))))
    rows = part.join(F.broadcast(days), F.lit(True)).select("*", sources.alias("source_id"))
    key, d, one = F.col("p_partkey"), F.col("d"), double(1)
    daily = one + ((key * 31 + d * 17) % 11 - 5).cast("double") * double(0.001)
    stray = (
        F.when(F.col("source_id") == "s2", one + ((key + d) % 7 - 3).cast("double") * double(0.0005))
        .when((F.col("source_id") == "s3") & ((key + d) % 10 == 0), double(1.1))
        .otherwise(one)
    )
    split = F.when((key % 13 == 0) & (d >= 15), double(2)).otherwise(one)
    return rows.select(
        F.concat(F.lit("P"), key.cast("string")).alias("instrument_id"), "business_date", F.lit("CLOSE").alias("field"), "source_id",
        (F.col("p_retailprice") * daily * stray / split).alias("value"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of every event type, day and source (users dealt to three sources)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = (F.col("event_type").alias("instrument_id"), F.col("ts").cast("date").alias("business_date"), F.concat(F.lit("s"), (F.col("user_id") % 3 + 1).cast("string")).alias("source_id"))
    return events.groupBy(*keys).agg(
        F.min_by("value", "ts").alias("open_px"), F.max("value").alias("high_px"), F.min("value").alias("low_px"), F.max_by("value", "ts").alias("close_px"), F.count("*").alias("volume")
    )
