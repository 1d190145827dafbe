"""Bounded remediation of disagreements: whom to ask again, how far back, when to give up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import Config
from tessera.operators import reconcile

ATTEMPTS = "run_id string, attempt int, bad_source string, lookback_days int, n_breaks bigint, outcome string"


def absent_sources(votes: DataFrame, enabled: tuple[str, ...]) -> DataFrame:
    """Keys that an enabled source has no value for, with those sources."""
    missing = F.array_except(X.strings(enabled), F.transform("votes", lambda v: v["source"]))
    return votes.withColumn("absent_sources", F.array_sort(missing)).filter(F.size("absent_sources") > 0)


def candidates(breaks: DataFrame, enabled: tuple[str, ...], keys: tuple[str, ...] = ("business_date",)) -> DataFrame:
    """Per batch of breaks the sources to suspect, sorted: those absent from any, else those dissenting in any, else all."""
    absent = F.array_except(X.strings(enabled), F.map_keys("source_values"))
    # Sets of source names: as short as there are sources, however many breaks.
    merged = breaks.groupBy(*keys).agg(
        F.count("*").alias("n_breaks"),
        *(F.array_sort(F.array_compact(F.array(*(F.max(F.when(F.array_contains(names, s), s)) for s in enabled)))).alias(label) for label, names in (("absent", absent), ("dissenting", F.col("dissenting_sources")))),
    )
    all_ = F.array_sort(X.strings(enabled))
    return merged.withColumn("candidates", F.when(F.size("absent") > 0, F.col("absent")).when(F.size("dissenting") > 0, F.col("dissenting")).otherwise(all_))


def bad_source(candidates_: Column, attempt: Column) -> Column:
    """The candidate of an attempt (from 1), going round."""
    return F.get(candidates_, F.pmod(attempt - 1, F.size(candidates_)))


def lookback(attempt: Column, steps: tuple[int, ...]) -> Column:
    """Days to look back at an attempt (from 1); the last step stays."""
    return F.get(F.array(*map(F.lit, steps)), F.least(attempt - 1, F.lit(len(steps) - 1)))


def attempts(breaks: DataFrame, config: Config, keys: tuple[str, ...] = ("business_date",)) -> DataFrame:
    """The attempts that a batch of breaks would make: ``attempt, bad_source, lookback_days``."""
    rows = candidates(breaks, config.voters, keys).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(config.remediation.max_retries))))
    return rows.select(*keys, "n_breaks", "attempt", bad_source(F.col("candidates"), F.col("attempt")).alias("bad_source"), lookback(F.col("attempt"), config.remediation.lookback_steps).alias("lookback_days"))


def success_rate(succeeded: Column, attempted: Column) -> Column:
    """Share of remediations that succeeded; 1 when none was needed."""
    return F.coalesce(F.try_divide(succeeded.cast("double"), attempted.cast("double")), F.lit(1.0))


def remediate(spark: SparkSession, silver: DataFrame, config: Config, refetch: Callable[[str, int], DataFrame | None], run_id: str, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Elect, and while there are breaks fetch the suspected source again, up to the retries allowed.

    ``refetch(source_id, lookback_days)`` gives a source's rows anew, or ``None`` if it failed, which counts as an
    attempt, so that escalation always comes.  What it gives takes the place of the source's rows of the dates that
    it covers.  ``store`` materialises a result between rounds.  Returns the last elections, the last silver, the log
    of attempts, whose last outcome is ``clean``, ``remediated`` or ``escalated``, and the breaks of the first
    election.  Only numbers and source names reach the driver.
    """
    seen: list[DataFrame] = []
    log: list[tuple] = []
    settings = config.remediation
    elected = store(reconcile.reconcile(silver, config))
    opened = reconcile.breaks(elected)
    for attempt in range(1, settings.max_retries + 2):
        open_ = reconcile.breaks(elected)
        n = open_.count()
        if n == 0:
            log.append((run_id, attempt - 1, None, None, 0, "remediated" if attempt > 1 else "clean"))
            break
        if attempt > settings.max_retries:
            log.append((run_id, attempt - 1, None, None, n, "escalated"))
            break
        seen.append(open_)
        every = seen[0]
        for more in seen[1:]:
            every = every.unionByName(more)
        who = candidates(every.withColumn("_all", F.lit(1)), config.voters, ("_all",)).select(bad_source(F.col("candidates"), F.lit(attempt))).first()[0]
        days = settings.lookback_steps[min(attempt, len(settings.lookback_steps)) - 1]
        fresh = refetch(who, days)
        log.append((run_id, attempt, who, days, n, "refetched" if fresh is not None else "refetch_failed"))
        if fresh is not None:
            fresh = store(fresh.filter(F.col("source_id") == who).select(*silver.columns))
            covered = fresh.select("business_date", F.lit(who).alias("source_id")).distinct()
            silver = store(silver.join(covered, ["source_id", "business_date"], "left_anti").select(*silver.columns).unionByName(fresh))
            elected = store(reconcile.reconcile(silver, config))
    return elected, silver, spark.createDataFrame(log, ATTEMPTS), opened
