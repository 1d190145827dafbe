"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ABSOLUTE, BPS, PCT, Tolerance


def double(value: float) -> Column:
    return F.lit(float(value)).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` uses it, even where the optimizer moves the
    expression into a filter and would copy a column's definition to every use."""
    return F.get(F.transform(F.array(value), body), 0)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that later filters read instead of repeating: the optimizer copies a projection's
    definitions into filters above it, but doesn't reach through a generator.  The generator here makes one row of one."""
    return rows.withColumn(name, F.explode(F.array(value)))


def tidy(value: Column) -> Column:
    """NaN as null, so that comparisons with missing numbers are never true."""
    return F.when(~F.isnan(value), value)


def within(a: Column, b: Column, kind: Column, limit: Column) -> Column:
    """Whether two values agree: relative to the larger magnitude in basis points or per cent, or absolutely.  Zeros agree."""
    scale = F.greatest(F.abs(a), F.abs(b))
    gap = F.abs(a - b)
    factor = F.when(kind == BPS, double(10_000)).when(kind == PCT, double(100))
    return F.when(scale == 0, F.lit(True)).when(factor.isNull(), gap <= limit).otherwise(gap / F.when(scale != 0, scale) * factor <= limit)


def within_fixed(a: Column, b: Column, tolerance: Tolerance) -> Column:
    return within(a, b, F.lit(tolerance.kind), double(tolerance.value))


def tolerance_label(field: Column, kind: Column, limit: Column) -> Column:
    """``CLOSE:25bps``, ``VOLUME:5pct``, ``X:0.5abs``; ``X:exact`` without a tolerance."""
    unit = F.when(kind == BPS, "bps").when(kind == PCT, "pct").when(kind == ABSOLUTE, "abs")
    number = F.when(limit == F.floor(limit), F.floor(limit).cast("string")).otherwise(limit.cast("string"))
    return F.when(kind.isNull(), F.concat(field, F.lit(":exact"))).otherwise(F.concat(field, F.lit(":"), number, unit))


def nearest_candidate(ratio: Column, candidates: Sequence[float], tolerance: float) -> Column:
    """The first candidate, in the order given, within a relative ``tolerance`` of ``ratio``; else null."""
    return F.coalesce(*(F.when(F.abs(ratio - double(c)) / double(c) <= tolerance, double(c)) for c in candidates))


def six_digits(value: Column) -> Column:
    """Rounded to six decimals, halves up, in binary floating point."""
    return F.floor(value * double(1e6) + double(0.5)) / double(1e6)


def number_text(value: Column) -> Column:
    """Canonical text of a number, the same for every engine: six decimals."""
    return value.cast("decimal(28,6)").cast("string")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def sorted_list(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")
