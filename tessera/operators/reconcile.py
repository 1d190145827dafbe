"""Golden values by tolerance quorum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import Config, Reconciliation
from tessera.operators import dq

KEYS = ("instrument_id", "business_date", "field")


def votes(silver: DataFrame) -> DataFrame:
    """Per instrument, date and field the sources' values as ``votes``, an array sorted by source, and ``currency``.

    One shuffle aligns any number of sources.  Missing values don't vote; of several rows of a source the last one
    fetched counts, or the largest value where that isn't known.  The currency is the first source's that has one.
    """
    ts = F.col("fetch_ts") if "fetch_ts" in silver.columns else F.lit(None).cast("timestamp")
    currency = F.col("currency") if "currency" in silver.columns else F.lit(None).cast("string")
    rows = silver.withColumn("value", X.tidy(F.col("value"))).filter("value IS NOT NULL")
    all_ = F.array_sort(F.collect_list(F.struct("source_id", ts.alias("ts"), "value")))
    money = F.min_by(currency, F.when(currency.isNotNull(), F.col("source_id")))
    rows = rows.groupBy(*KEYS).agg(all_.alias("all"), F.coalesce(money, F.lit("USD")).alias("currency"))
    last = F.filter("all", lambda v, i: F.coalesce(F.get("all", i + 1)["source_id"] != v["source_id"], F.lit(True)))
    return rows.select(*KEYS, F.transform(last, lambda v: F.struct(v["source_id"].alias("source"), v["value"].alias("value"))).alias("votes"), "currency")


def _tolerances(settings: Reconciliation) -> tuple[Column, Column]:
    known = settings.tolerances.items()
    pick = lambda get: F.coalesce(*(F.when(F.col("field") == name, get(t)) for name, t in known)) if known else F.lit(None)
    return pick(lambda t: F.lit(t.kind)).cast("string"), pick(lambda t: X.double(t.value)).cast("double")


def elect(voted: DataFrame, settings: Reconciliation) -> DataFrame:
    """Adds ``golden_value`` (null: a break), ``quorum_sources``, ``dissenting_sources``, ``confidence``, ``tolerance_band``.

    From each source in turn a group grows by every other source that agrees with all of its members; the first of
    the largest groups wins if it has enough members, and its mean is golden: HIGH if nobody dissents, else MEDIUM.  A
    field without tolerance needs all values identical, from however many sources.  A break is LOW, all dissent.
    """
    kind, limit = _tolerances(settings)
    rows = voted.withColumns({"_kind": kind, "_limit": limit})

    def grown(seed: Column) -> Column:
        agrees = lambda group, v: (v["source"] != seed["source"]) & F.forall(group, lambda m: X.within(v["value"], m["value"], F.col("_kind"), F.col("_limit")))
        return F.aggregate("votes", F.array(seed), lambda group, v: F.when(agrees(group, v), F.concat(group, F.array(v))).otherwise(group))

    groups = F.transform("votes", grown)
    largest = F.aggregate(groups, F.slice("votes", 1, 0), lambda best, g: F.when(F.size(g) > F.size(best), g).otherwise(best))
    quorum = X.let(largest, lambda best: F.when(F.size(best) >= settings.min_agreeing_sources, best))
    alike = F.size(F.array_distinct(F.transform("votes", lambda v: v["value"]))) == 1
    winners = F.when(F.col("_kind").isNotNull(), quorum).when(alike, F.col("votes"))
    names = lambda a: F.array_sort(F.transform(a, lambda v: v["source"]))
    mean = lambda won: F.aggregate(won, X.double(0), lambda s, v: s + v["value"]) / F.size(won)

    def result(won: Column) -> Column:
        golden = F.when(won.isNotNull(), F.when(F.col("_kind").isNull(), F.get(won, 0)["value"]).otherwise(mean(won)))
        agreed = F.coalesce(names(won), X.strings([]))
        return X.let(F.array_except(names(F.col("votes")), agreed), lambda dissent: F.struct(
            golden.alias("golden_value"), agreed.alias("quorum_sources"), dissent.alias("dissenting_sources"),
            F.when(won.isNull(), "LOW").when(F.size(dissent) == 0, "HIGH").otherwise("MEDIUM").alias("confidence"),
        ))

    rows = X.once(rows, "_e", X.let(winners, result)).withColumn("tolerance_band", X.tolerance_label(F.col("field"), F.col("_kind"), F.col("_limit")))
    return rows.select(*voted.columns, "_e.*", "tolerance_band")


#: Sources up to which an election is laid out as plain arithmetic; more are elected over arrays.
MAX_COLUMNS = 4


def _largest_group(n: int, agreeing: set[tuple[int, int]]) -> int:
    """Bits of the group that wins among ``n`` sources of which the given pairs agree."""
    best: list[int] = []
    for seed in range(n):
        group = [seed]
        for other in range(n):
            if other != seed and all((min(other, m), max(other, m)) in agreeing for m in group):
                group.append(other)
        best = max(best, group, key=len)  # the first of the longest
    return sum(1 << m for m in best)


def elect_known(silver: DataFrame, settings: Reconciliation, sources: tuple[str, ...]) -> DataFrame:
    """The same as ``elect(votes(silver))`` where the sources are known beforehand and few.

    Each source's value is a column of one hash aggregate, agreement a bit per pair and a group a number with a bit
    per source, so the election is a few comparisons and a table look-up in generated code instead of array lambdas.
    """
    sources = tuple(sorted(sources))
    if len(sources) > MAX_COLUMNS:
        return elect(votes(silver.filter(F.col("source_id").isin(*sources))), settings)
    n = len(sources)
    value = X.tidy(F.col("value"))
    last = _last_values(silver, sources)
    money = F.min(F.when(F.col("currency").isNotNull() & value.isNotNull(), F.struct("source_id", "currency")))["currency"] if "currency" in silver.columns else F.lit(None).cast("string")
    rows = silver.filter(F.col("source_id").isin(*sources)).groupBy(*KEYS).agg(*(v.alias(f"_v{i}") for i, v in enumerate(last)), F.coalesce(money, F.lit("USD")).alias("currency"))
    there = F.lit(0)
    for i in range(n):
        there = there + F.when(F.col(f"_v{i}").isNotNull(), 1 << i).otherwise(0)
    kind, limit = _tolerances(settings)
    rows = rows.withColumns({"_there": there, "_kind": kind, "_limit": limit}).filter("_there > 0")

    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    code = F.lit(0)
    for k, (i, j) in enumerate(pairs):
        agrees = X.within(F.col(f"_v{i}"), F.col(f"_v{j}"), F.col("_kind"), F.col("_limit"))
        code = code + F.when(agrees, 1 << k).otherwise(0)
    rows = rows.withColumn("_code", code)
    # Who wins depends on who agrees with whom alone, so the rule is run beforehand for every pattern of agreement.
    winners = F.array(*(F.lit(_largest_group(n, {p for k, p in enumerate(pairs) if c >> k & 1})) for c in range(1 << len(pairs))))
    lone = F.col("_there").bitwiseAND(-F.col("_there"))  # nobody agrees: the first source stands alone
    best = F.when(F.col("_code") == 0, lone).otherwise(F.get(winners, F.col("_code")))
    low, high = (f(*(F.col(f"_v{i}") for i in range(n))) if n > 1 else F.col("_v0") for f in (F.least, F.greatest))
    rows = rows.withColumn("_best", best)
    enough = F.when(F.bit_count("_best") >= settings.min_agreeing_sources, F.col("_best")).otherwise(0)
    rows = X.once(rows, "_won", F.when(F.col("_kind").isNotNull(), enough).when(low == high, F.col("_there")).otherwise(0))
    total = X.double(0)
    for i in range(n):
        total = total + F.when(F.col("_won").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"_v{i}")).otherwise(X.double(0))
    dissent = F.col("_there") - F.col("_won")
    table = F.array(*(X.strings(s for i, s in enumerate(sources) if m >> i & 1) for m in range(1 << n)))
    listed = F.filter(F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"_v{i}").alias("value")) for i, s in enumerate(sources))), lambda v: v["value"].isNotNull())
    return rows.select(
        *KEYS, listed.alias("votes"), "currency",
        F.when(F.col("_won") != 0, F.when(F.col("_kind").isNull(), low).otherwise(total / F.bit_count("_won"))).alias("golden_value"),
        F.get(table, F.col("_won")).alias("quorum_sources"), F.get(table, dissent).alias("dissenting_sources"),
        F.when(F.col("_won") == 0, "LOW").when(dissent == 0, "HIGH").otherwise("MEDIUM").alias("confidence"),
        X.tolerance_label(F.col("field"), F.col("_kind"), F.col("_limit")).alias("tolerance_band"),
    )


def decision_id(run_id: str, kind: str = "RECONCILE", part: str = "field") -> Column:
    """Deterministic: the same run decides the same thing under the same id."""
    return X.content_hash(F.lit(run_id), F.lit(kind), "instrument_id", F.coalesce(F.col("business_date").cast("string"), F.lit("")), part)


def gold(elected: DataFrame, run_id: str) -> DataFrame:
    """Golden records; breaks never get here."""
    rows = elected.filter("golden_value IS NOT NULL").withColumn("decision_id", decision_id(run_id))
    return rows.select(*KEYS, X.six_digits(F.col("golden_value")).cast("decimal(28,6)").alias("golden_value"), "confidence", "quorum_sources", "dissenting_sources", "tolerance_band", "currency", "decision_id")


def breaks(elected: DataFrame) -> DataFrame:
    """Pairs without a quorum, with what each source said."""
    return elected.filter("golden_value IS NULL").select(*KEYS, F.map_from_entries("votes").alias("source_values"), "tolerance_band", "dissenting_sources")


def decisions(elected: DataFrame, run_id: str) -> DataFrame:
    """One verified decision per golden record; breaks write none."""
    rows = elected.filter("golden_value IS NOT NULL")
    return rows.select(
        decision_id(run_id).alias("decision_id"), F.lit("reconciliation").alias("agent"), "instrument_id", "business_date", F.lit("RECONCILE").alias("decision_type"),
        F.map_from_entries("votes").alias("inputs"), F.to_json(F.struct(X.number_text(F.col("golden_value")).alias("golden_value"), "confidence")).alias("outcome"), F.col("tolerance_band").alias("rule_applied"), F.lit(True).alias("verified"),
    )


def reconcile(silver: DataFrame, config: Config, failures: DataFrame | None = None) -> DataFrame:
    """Elections over the voters' rows, without those of high-severity failures if the settings say so."""
    rows = silver.filter(F.col("source_id").isin(*config.voters))
    if config.reconciliation.exclude_high_severity_rows:
        found = dq.failures(rows, config) if failures is None else failures
        keys = ["instrument_id", "field", "source_id", "business_date"]
        rows = rows.join(found.filter("severity = 'high'").select(*keys).distinct(), keys, "left_anti")
    return elect_known(rows, config.reconciliation, config.voters)


def _last_values(silver: DataFrame, sources: tuple[str, ...]) -> list[Column]:
    """Per source an aggregate: its value, of several the last one fetched or the largest where that isn't known."""
    value = X.tidy(F.col("value"))
    mine = lambda s, v: F.when(F.col("source_id") == s, v)
    if "fetch_ts" in silver.columns:
        return [F.max(mine(s, F.when(value.isNotNull(), F.struct("fetch_ts", value.alias("value")))))["value"] for s in sources]
    return [F.max(mine(s, value)) for s in sources]


def agreement(silver: DataFrame, tolerance: dict[str, Column], sources: tuple[str, ...]) -> DataFrame:
    """Every pair of ``sources`` that both have a value of an instrument, date and field, ``source_a < source_b``, with
    a column per named predicate over ``value_a`` and ``value_b``.  One hash aggregate, no join."""
    sources = tuple(sorted(sources))
    wide = silver.filter(F.col("source_id").isin(*sources)).groupBy(*KEYS).agg(*(v.alias(f"_v{i}") for i, v in enumerate(_last_values(silver, sources))))
    both = [F.struct(F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), F.col(f"_v{i}").alias("value_a"), F.col(f"_v{j}").alias("value_b")) for i, a in enumerate(sources) for j, b in enumerate(sources) if i < j]
    pairs = wide.select(*KEYS, F.explode(F.array(*both)).alias("p")).select(*KEYS, "p.*").filter("value_a IS NOT NULL AND value_b IS NOT NULL")
    return pairs.select("*", *(test.alias(name) for name, test in tolerance.items()))
