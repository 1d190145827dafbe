"""Seeded defects, for tests and drills.  Rows are picked by the rank of a hash of their key, so a seed always picks the same."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("instrument_id", "business_date", "field", "source_id")


def _rank(rows: DataFrame, seed: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(f"`{k}`") for k in keys if k in rows.columns))


def _pick(rows: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``_hit`` on the ``n`` of least rank; equal ranks are hit together."""
    rank = _rank(rows, seed, keys)
    # The n-th smallest rank, found by a distributed top-n; at most one number is broadcast.
    limit = rows.select(rank.alias("r")).orderBy("r").limit(max(1, n)).agg(F.max("r").alias("_limit"))
    return rows.crossJoin(F.broadcast(limit)).withColumn("_hit", F.coalesce(rank <= F.col("_limit"), F.lit(False))).drop("_limit")


def null_burst(rows: DataFrame, column: str = "value", rate: float = 0.3, seed: int = 42, keys: Sequence[str] = KEY) -> DataFrame:
    """A share of the rows, one at least, loses its value."""
    hit = _pick(rows, int(rows.count() * rate), seed, keys)
    return hit.withColumn(column, F.when(~F.col("_hit"), F.col(f"`{column}`"))).drop("_hit")


def stale_feed(rows: DataFrame, days: int = 3) -> DataFrame:
    """Fetch and event times move back."""
    return rows.withColumns({c: F.col(c) - F.make_dt_interval(F.lit(days)) for c in ("fetch_ts", "event_ts") if c in rows.columns})


def _times_one(rows: DataFrame, column: str, factor: float, seed: int, keys: Sequence[str]) -> DataFrame:
    hit = _pick(rows, 1, seed, keys)
    return hit.withColumn(column, F.when(F.col("_hit"), F.col(f"`{column}`") * F.lit(float(factor))).otherwise(F.col(f"`{column}`"))).drop("_hit")


def out_of_range(rows: DataFrame, column: str = "value", multiplier: float = 100.0, seed: int = 42, keys: Sequence[str] = KEY) -> DataFrame:
    """One row's value is multiplied."""
    return _times_one(rows, column, multiplier, seed, keys)


def unadjusted_split(rows: DataFrame, ratio: float = 2.0, column: str = "value", seed: int = 42, keys: Sequence[str] = KEY) -> DataFrame:
    """One row's value stands before a split that its feed has missed."""
    return _times_one(rows, column, ratio, seed, keys)


def schema_drift(rows: DataFrame, rename: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Columns change their names or vanish."""
    for old, new in (rename or {}).items():
        rows = rows.withColumnRenamed(old, new)
    return rows.drop(*drop)


def cross_source_break(rows: DataFrame, column: str = "value", shift: float = 0.10, source_id: str | None = None) -> DataFrame:
    """All values, or those of one source, are off by a share."""
    moved = F.col(f"`{column}`") * F.lit(1.0 + shift)
    return rows.withColumn(column, moved if source_id is None else F.when(F.col("source_id") == source_id, moved).otherwise(F.col(f"`{column}`")))


def volatility_regime(rows: DataFrame, column: str = "value", multiplier: float = 3.0) -> DataFrame:
    """All values jump."""
    return rows.withColumn(column, F.col(f"`{column}`") * F.lit(float(multiplier)))


DEFECTS: dict[str, Callable[..., DataFrame]] = {
    "null_burst": null_burst,
    "stale_feed": stale_feed,
    "out_of_range": out_of_range,
    "schema_drift": schema_drift,
    "unadjusted_split": unadjusted_split,
    "cross_source_break": cross_source_break,
    "volatility_regime": volatility_regime,
}


def inject(rows: DataFrame, defect: str, **settings: object) -> DataFrame:
    """One named defect."""
    if defect not in DEFECTS:
        raise ValueError(f"unknown defect {defect}")
    return DEFECTS[defect](rows, **settings)


def scenario(bars: DataFrame, name: str) -> DataFrame:
    """Named scenarios over wide bars (``Close`` and so on)."""
    keys = ("instrument_id", "Date")
    made: dict[str, Callable[[DataFrame], DataFrame]] = {
        "clean": lambda r: r,
        "null_burst": lambda r: null_burst(r, "Close", keys=keys),
        "stale_feed": stale_feed,
        "out_of_range": lambda r: out_of_range(r, "Close", keys=keys),
        "schema_drift": lambda r: schema_drift(r, drop=["Adj Close"]),
        "split_2to1": lambda r: unadjusted_split(r, 2.0, "Close", keys=keys),
        "cross_source_break": lambda r: cross_source_break(r, "Close"),
        "volatility_regime": lambda r: volatility_regime(r, "Close"),
        "mixed_defects": lambda r: out_of_range(null_burst(r, "Close", 0.2, 42, keys), "Close", seed=7, keys=keys),
    }
    if name not in made:
        raise ValueError(f"unknown scenario {name}")
    return made[name](bars)


def synthetic_bars(spark: SparkSession, instruments: Sequence[str], date: str, seed: int = 42, base: float = 100.0) -> DataFrame:
    """A wide bar of one date per instrument, from hashes: the same for every source, so that they agree."""
    share = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), "instrument_id", *map(F.lit, salt)), F.lit(10_000)) / F.lit(10_000.0)
    rows = spark.createDataFrame([(i,) for i in instruments], "instrument_id string")
    rows = rows.withColumns({"Date": F.lit(date).cast("timestamp"), "Open": F.lit(base) * (1 + share("open")), "Close": F.lit(base) * (1 + share("close"))})
    rows = rows.withColumns({"High": F.greatest("Open", "Close") * 1.01, "Low": F.least("Open", "Close") * 0.99, "Adj Close": F.col("Close"), "Volume": (F.lit(1e6) * (1 + share("volume"))).cast("bigint"), "source_symbol": F.lower("instrument_id"), "fetch_ts": F.col("Date")})
    from tessera.sources import schemas

    return rows.select(*(F.col(f"`{c}`") for c in schemas.BRONZE.names))


def walk(spark: SparkSession, instruments: Sequence[str], days: int, end: str, source_id: str, seed: int = 42, base: float = 100.0, volatility: dict[int, float] | None = None) -> DataFrame:
    """Canonical rows of a random walk: six fields a day, noise from hashes, ``volatility`` by days before the end."""
    noise = lambda *salt: F.xxhash64(F.lit(seed), "instrument_id", "n", *map(F.lit, salt)) / F.lit(2.0**63)
    names = spark.createDataFrame([(i,) for i in instruments], "instrument_id string")
    rows = names.select("instrument_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("n"))
    wild = F.lit(1.0)
    for offset, factor in (volatility or {}).items():
        wild = F.when(F.col("n") == days - 1 - offset, F.lit(float(factor))).otherwise(wild)
    rows = rows.withColumn("step", noise(0) * F.lit(0.0173) * wild)
    from pyspark.sql import Window as W

    close = F.lit(base) * F.exp(F.sum(F.log1p("step")).over(W.partitionBy("instrument_id").orderBy("n")))
    rows = rows.withColumn("CLOSE", close).withColumns({"spread": F.abs(noise(1)) * F.lit(0.005) * wild, "business_date": F.date_add(F.lit(end).cast("date"), F.col("n") - (days - 1))})
    wide = rows.select(
        "instrument_id", "business_date", F.col("CLOSE").alias("OPEN"), (F.col("CLOSE") * (1 + F.col("spread"))).alias("HIGH"), (F.col("CLOSE") * (1 - F.col("spread"))).alias("LOW"),
        "CLOSE", F.col("CLOSE").alias("ADJ_CLOSE"), (F.lit(1e6) * (1 + F.abs(noise(2)))).alias("VOLUME"),
    )
    from tessera.operators import contract

    long = contract.unpivot(wide, ["instrument_id", "business_date"], {f: f for f in ("OPEN", "HIGH", "LOW", "CLOSE", "ADJ_CLOSE", "VOLUME")})
    stamp = F.col("business_date").cast("timestamp")
    rows = long.withColumns({"currency": F.lit("USD"), "source_id": F.lit(source_id), "source_symbol": F.col("instrument_id"), "fetch_ts": stamp, "event_ts": stamp, "ca_adjusted": F.lit(False)})
    from tessera.sources import schemas

    return rows.withColumn("content_hash", contract.row_hash()).select(*schemas.SILVER.names)
