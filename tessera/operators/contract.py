"""Conforming wide feed records to the long canonical table, and the schema contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.sources import schemas

MAX_REPORTED = 20


def unpivot(wide: DataFrame, ids: list[str], fields: Mapping[str, str]) -> DataFrame:
    """Long rows ``ids, field, value``; ``fields`` maps wide columns to field names.  Columns that are absent raise."""
    if missing := schemas.missing_columns(wide.columns, [*ids, *fields]):
        raise KeyError(f"missing columns: {', '.join(missing)}")
    named = wide.select(*ids, *(X.tidy(F.col(f"`{c}`").try_cast("double")).alias(name) for c, name in fields.items()))
    return named.unpivot(ids, list(fields.values()), "field", "value")


def row_hash(value: Column | None = None) -> Column:
    """SHA-256 of instrument, date, field, source and value in canonical text; a missing value leaves its part out."""
    return X.content_hash("instrument_id", F.col("business_date").cast("string"), "field", "source_id", X.number_text(F.col("value") if value is None else value))


def to_silver(bronze: DataFrame, source_id: str, currency: str = "USD") -> DataFrame:
    """Price bars as canonical rows, one per field."""
    if "Adj Close" not in bronze.columns and "Close" in bronze.columns:
        bronze = bronze.withColumn("Adj Close", F.col("Close"))
    long = unpivot(bronze.withColumn("business_date", F.to_date("Date")), ["business_date", "Date", "instrument_id", "source_symbol", "fetch_ts"], schemas.WIDE_FIELDS)
    return _canonical(long, source_id, F.lit(currency))


def rates_to_silver(bronze: DataFrame, source_id: str) -> DataFrame:
    """Reference rates as ``CLOSE`` rows in their currency."""
    rows = bronze.select(F.to_date("Date").alias("business_date"), "Date", "instrument_id", "source_symbol", "fetch_ts", F.lit("CLOSE").alias("field"), F.col("rate").alias("value"), "currency")
    return _canonical(rows, source_id, F.col("currency"))


def shares_to_silver(bronze: DataFrame, source_id: str) -> DataFrame:
    """Shares outstanding as ``SHARES`` rows; the company number is the symbol."""
    rows = bronze.select(F.to_date("Date").alias("business_date"), "Date", "instrument_id", F.col("cik").alias("source_symbol"), "fetch_ts", F.lit("SHARES").alias("field"), "value")
    return _canonical(rows, source_id, F.lit("shares"))


def _canonical(long: DataFrame, source_id: str, currency: Column) -> DataFrame:
    rows = long.withColumns({"currency": currency, "source_id": F.lit(source_id), "event_ts": F.col("Date").cast("timestamp"), "ca_adjusted": F.lit(False)})
    return rows.withColumn("content_hash", row_hash()).select(*schemas.SILVER.names)


def rules() -> dict[str, Column]:
    """The contract on canonical rows: each column is true where the rule is broken."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return {
        "instrument_id_missing": empty("instrument_id"),
        "business_date_missing": F.col("business_date").isNull(),
        "field_unknown": F.col("field").isNull() | ~F.col("field").isin(*schemas.FIELDS),
        "value_missing": F.col("value").isNull() | F.isnan("value"),
        "source_id_missing": empty("source_id"),
    }


def violations(silver: DataFrame, broken: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per broken rule and row: the row and ``rule``.  All rules are tested in one pass."""
    tests = F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in (broken or rules()).items())))
    return silver.withColumn("rule", F.explode(tests))


def report(found: DataFrame, limit: int = MAX_REPORTED) -> DataFrame:
    """The first violations in a fixed order, as many as a message carries."""
    return found.orderBy("rule", "source_id", "instrument_id", "business_date", "field").limit(limit)


def verdicts(silver: DataFrame) -> DataFrame:
    """Per source and date: rows, rows that break the contract, and whether the batch passed."""
    broken = F.lit(False)
    for test in rules().values():
        broken = broken | test
    return silver.groupBy("source_id", "business_date").agg(F.count("*").alias("n_rows"), F.count_if(broken).alias("n_broken")).withColumn("passed", F.col("n_broken") == 0)


def split(silver: DataFrame, by_batch: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows: whole batches by verdict, or single rows."""
    if by_batch:
        judged = verdicts(silver).select(F.col("source_id").alias("_source"), F.col("business_date").alias("_date"), "passed")
        # A row without source or date belongs to a batch without one, whose verdict it needs like any other.
        rows = silver.join(judged, F.col("source_id").eqNullSafe(F.col("_source")) & F.col("business_date").eqNullSafe(F.col("_date"))).drop("_source", "_date")
        return rows.filter("passed").drop("passed"), rows.filter("NOT passed").drop("passed")
    broken = F.lit(False)
    for test in rules().values():
        broken = broken | test
    return silver.filter(~broken), silver.filter(broken)


def pivot_ohlc(silver: DataFrame, keys: tuple[str, ...] = ("instrument_id", "business_date", "source_id")) -> DataFrame:
    """Long rows back to one wide row per key; of several values of a field the smallest non-null one."""
    return silver.groupBy(*keys).pivot("field", ["OPEN", "HIGH", "LOW", "CLOSE"]).agg(F.min("value"))
