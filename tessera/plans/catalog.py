"""Queries over the star-schema tables, one per capability, and the SQL that each must agree with.

Numbers that engines add up in different orders are cut to four decimals at a border (``0.50031``) that values of few
decimals never stand on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.config import ABSOLUTE, BPS, PCT, Anomaly, Config, CorporateActions, Quality, Reconciliation, Source, Tolerance
from tessera.operators import anomaly, audit, contract, corporate_actions, dq, inject, log, reconcile, remediation
from tessera.sources import feeds, layers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FEED = """feed AS (
  SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS instrument_id, p_partkey, d, business_date, 'CLOSE' AS field, source_id,
         (p_retailprice
           * (CAST(1.0 AS DOUBLE) + CAST((p_partkey*31 + d*17) % 11 - 5 AS DOUBLE) * CAST(0.001 AS DOUBLE))
           * CASE WHEN source_id = 's2' THEN CAST(1.0 AS DOUBLE) + CAST((p_partkey + d) % 7 - 3 AS DOUBLE) * CAST(0.0005 AS DOUBLE)
                  WHEN source_id = 's3' AND (p_partkey + d) % 10 = 0 THEN CAST(1.1 AS DOUBLE)
                  ELSE CAST(1.0 AS DOUBLE) END
           / CASE WHEN p_partkey % 13 = 0 AND d >= 15 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) AS value
  FROM part
  CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS business_date, CAST(EXTRACT(DAY FROM ts) AS INT) - 1 AS d FROM events) t
  CROSS JOIN (VALUES ('s1'), ('s2'), ('s3')) AS s(source_id)
)"""

BARS = """bars AS (
  SELECT event_type AS instrument_id, CAST(ts AS DATE) AS business_date, concat('s', CAST(user_id % 3 + 1 AS VARCHAR)) AS source_id,
         min_by(value, ts) AS open_px, max(value) AS high_px, min(value) AS low_px, max_by(value, ts) AS close_px, count(*) AS volume
  FROM events GROUP BY ALL
)"""

LONG = """long AS (
  SELECT instrument_id, business_date, source_id, unnest(['OPEN', 'HIGH', 'LOW', 'CLOSE', 'VOLUME']) AS field,
         unnest([open_px, high_px, low_px, close_px, CAST(volume AS DOUBLE)]) AS value
  FROM bars
)"""

#: Defects by rule: every seventh volume loses the close, every eleventh has a negative low and high under low, every
#: thirteenth an unknown field name.
FAULTY = """faulty AS (
  SELECT l.instrument_id, l.business_date, l.source_id,
         CASE WHEN b.volume % 13 = 0 AND field = 'VOLUME' THEN 'VOLUMEN' ELSE field END AS field,
         CASE WHEN b.volume % 7 = 0 AND field = 'CLOSE' THEN NULL
              WHEN b.volume % 11 = 0 AND field = 'HIGH' THEN -value - 1
              ELSE value END AS value
  FROM long l JOIN bars b USING (instrument_id, business_date, source_id)
)"""

BARS_FIELDS = {"open_px": "OPEN", "high_px": "HIGH", "low_px": "LOW", "close_px": "CLOSE", "volume": "VOLUME"}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def cut(value: Column) -> Column:
    return F.floor(value * X.double(1e4) + X.double(0.50031)) / X.double(1e4)


def cut_sql(value: str) -> str:
    return f"floor(({value}) * CAST(1e4 AS DOUBLE) + CAST(0.50031 AS DOUBLE)) / CAST(1e4 AS DOUBLE)"


def six_sql(value: str) -> str:
    return f"floor(({value}) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"


def _day(rows: DataFrame) -> Column:
    return F.dayofmonth("business_date") - 1


def _part(rows: DataFrame) -> Column:
    return F.substring("instrument_id", 2, 20).cast("bigint")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.bars(spark, sf_dir).withColumn("n_trades", F.col("volume"))
    return contract.unpivot(rows, ["instrument_id", "business_date", "source_id", "n_trades"], BARS_FIELDS)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _long(spark, sf_dir), F.col("n_trades")
    field = F.when((n % 13 == 0) & (F.col("field") == "VOLUME"), "VOLUMEN").otherwise(F.col("field"))
    value = F.when((n % 7 == 0) & (F.col("field") == "CLOSE"), None).when((n % 11 == 0) & (F.col("field") == "HIGH"), -F.col("value") - 1).otherwise(F.col("value"))
    return rows.withColumn("value", value).withColumn("field", field).drop("n_trades")


# --- Election -------------------------------------------------------------------------------------------------------

_SOURCES = ("s1", "s2", "s3")
_ELECT = Reconciliation(tolerances={"CLOSE": Tolerance(BPS, 25.0)})

_ELECTION = f"""{FEED}, wide AS (
  SELECT instrument_id, business_date, field, max(value) FILTER (source_id = 's1') AS a, max(value) FILTER (source_id = 's2') AS b,
         max(value) FILTER (source_id = 's3') AS c
  FROM feed GROUP BY ALL
), flags AS (
  SELECT *, abs(a - b) / greatest(abs(a), abs(b)) * 10000 <= 25 AS ab, abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25 AS ac,
         abs(b - c) / greatest(abs(b), abs(c)) * 10000 <= 25 AS bc
  FROM wide
), elected AS (
  SELECT instrument_id, business_date, field,
         CASE WHEN ab AND ac AND bc THEN (a + b + c) / 3 WHEN ab THEN (a + b) / 2 WHEN ac THEN (a + c) / 2 WHEN bc THEN (b + c) / 2 END AS golden,
         CASE WHEN ab AND ac AND bc THEN 's1,s2,s3' WHEN ab THEN 's1,s2' WHEN ac THEN 's1,s3' WHEN bc THEN 's2,s3' ELSE '' END AS quorum,
         CASE WHEN ab AND ac AND bc THEN '' WHEN ab THEN 's3' WHEN ac THEN 's2' WHEN bc THEN 's1' ELSE 's1,s2,s3' END AS dissent,
         CASE WHEN ab AND ac AND bc THEN 'HIGH' WHEN ab OR ac OR bc THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM flags
)"""


def _elected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.elect_known(feeds.feed(spark, sf_dir), _ELECT, _SOURCES)


@query(
    "golden_election",
    f"""WITH {_ELECTION}
SELECT instrument_id, business_date, field, {six_sql('golden')} AS golden_value, confidence, quorum AS quorum_sources,
       dissent AS dissenting_sources, 'CLOSE:25bps' AS tolerance_band
FROM elected WHERE golden IS NOT NULL""",
)
def golden_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.gold(_elected(spark, sf_dir), "run")
    return rows.select("instrument_id", "business_date", "field", F.col("golden_value").cast("double").alias("golden_value"), "confidence", X.sorted_list(F.col("quorum_sources")).alias("quorum_sources"), X.sorted_list(F.col("dissenting_sources")).alias("dissenting_sources"), "tolerance_band")


@query(
    "reconciliation_breaks",
    f"""WITH {FEED}, wide AS (
  SELECT instrument_id, business_date, field, max(value) FILTER (source_id = 's1') AS a, max(value) FILTER (source_id = 's3') AS c FROM feed GROUP BY ALL
)
SELECT instrument_id, business_date, field, a AS value_s1, c AS value_s3, 's1,s3' AS dissenting_sources, 'CLOSE:25bps' AS tolerance_band
FROM wide WHERE NOT abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25""",
)
def reconciliation_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir).filter("source_id <> 's2'")
    found = reconcile.breaks(reconcile.elect_known(rows, _ELECT, _SOURCES))
    return found.select("instrument_id", "business_date", "field", F.col("source_values")["s1"].alias("value_s1"), F.col("source_values")["s3"].alias("value_s3"), X.sorted_list(F.col("dissenting_sources")).alias("dissenting_sources"), "tolerance_band")


@query(
    "election_unanimous_no_tolerance",
    f"""WITH {FEED}
SELECT instrument_id, business_date, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS golden_value,
       CASE WHEN count(DISTINCT value) = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence, 'CLOSE:exact' AS tolerance_band
FROM feed GROUP BY instrument_id, business_date""",
)
def election_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.elect_known(feeds.feed(spark, sf_dir), Reconciliation(tolerances={}), _SOURCES)
    return rows.select("instrument_id", "business_date", "golden_value", "confidence", "tolerance_band")


@query(
    "tolerance_pairs",
    f"""WITH {FEED}, wide AS MATERIALIZED (
  SELECT instrument_id, business_date, max(value) FILTER (source_id = 's1') AS v1, max(value) FILTER (source_id = 's2') AS v2, max(value) FILTER (source_id = 's3') AS v3
  FROM feed GROUP BY instrument_id, business_date
), pairs AS (
  SELECT instrument_id, business_date, 's1' AS source_a, 's2' AS source_b, v1 AS a, v2 AS b FROM wide
  UNION ALL SELECT instrument_id, business_date, 's1', 's3', v1, v3 FROM wide
  UNION ALL SELECT instrument_id, business_date, 's2', 's3', v2, v3 FROM wide
)
SELECT instrument_id, business_date, source_a, source_b, abs(a - b) / greatest(abs(a), abs(b)) * 10000 <= 25 AS within_bps,
       abs(a - b) / greatest(abs(a), abs(b)) * 100 <= 5 AS within_pct, abs(a - b) <= CAST(0.5 AS DOUBLE) AS within_abs
FROM pairs""",
)
def tolerance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("value_a"), F.col("value_b")
    tests = {n: X.within_fixed(a, b, t) for n, t in (("within_bps", Tolerance(BPS, 25)), ("within_pct", Tolerance(PCT, 5)), ("within_abs", Tolerance(ABSOLUTE, 0.5)))}
    return reconcile.agreement(feeds.feed(spark, sf_dir), tests, _SOURCES).drop("field", "value_a", "value_b")


@query("confidence_distribution", f"WITH {_ELECTION} SELECT confidence, count(*) AS n, min(business_date) AS first_date FROM elected GROUP BY confidence")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elected(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n"), F.min("business_date").alias("first_date"))


@query("dissent_by_source", f"WITH {_ELECTION} SELECT source_id, count(*) AS n FROM (SELECT unnest(string_split(dissent, ',')) AS source_id FROM elected WHERE dissent <> '') GROUP BY source_id")
def dissent_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elected(spark, sf_dir).select(F.explode("dissenting_sources").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))


# --- Conforming and contract ----------------------------------------------------------------------------------------


@query("bars_ohlcv", f"WITH {BARS} SELECT * FROM bars")
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.bars(spark, sf_dir)


@query("silver_unpivot", f"WITH {BARS}, {LONG} SELECT instrument_id, business_date, source_id, field, value, 'USD' AS currency, FALSE AS ca_adjusted FROM long")
def silver_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).drop("n_trades").withColumns({"currency": F.lit("USD"), "ca_adjusted": F.lit(False)})


@query(
    "silver_pivot_ohlc",
    f"""WITH {BARS} SELECT instrument_id, business_date, source_id, open_px AS open, high_px AS high, low_px AS low, close_px AS close FROM bars""",
)
def silver_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = contract.pivot_ohlc(_long(spark, sf_dir))
    return wide.select("instrument_id", "business_date", "source_id", F.col("OPEN").alias("open"), F.col("HIGH").alias("high"), F.col("LOW").alias("low"), F.col("CLOSE").alias("close"))


@query(
    "contract_violations",
    f"""WITH {BARS}, {LONG}, {FAULTY}
SELECT instrument_id, business_date, source_id, field, rule FROM (
  SELECT *, 'value_missing' AS rule FROM faulty WHERE value IS NULL
  UNION ALL SELECT *, 'field_unknown' FROM faulty WHERE field NOT IN ('OPEN', 'HIGH', 'LOW', 'CLOSE', 'ADJ_CLOSE', 'VOLUME', 'SHARES'))""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.violations(_faulty(spark, sf_dir)).select("instrument_id", "business_date", "source_id", "field", "rule")


@query(
    "contract_verdicts",
    f"""WITH {BARS}, {LONG}, {FAULTY}
SELECT source_id, business_date, count(*) AS n_rows,
       count(*) FILTER (value IS NULL OR field NOT IN ('OPEN', 'HIGH', 'LOW', 'CLOSE', 'ADJ_CLOSE', 'VOLUME', 'SHARES')) AS n_broken,
       n_broken = 0 AS passed
FROM faulty GROUP BY source_id, business_date""",
)
def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.verdicts(_faulty(spark, sf_dir))


@query(
    "content_hash",
    f"""WITH {BARS}, {LONG}
SELECT instrument_id, business_date, source_id, field,
       sha256(concat_ws('|', instrument_id, CAST(business_date AS VARCHAR), field, source_id, CAST(CAST(value AS DECIMAL(28,6)) AS VARCHAR))) AS content_hash
FROM long""",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("instrument_id", "business_date", "source_id", "field", contract.row_hash().alias("content_hash"))


# --- Data quality ---------------------------------------------------------------------------------------------------

_KEYS = "instrument_id, business_date, source_id, field"


def _keys(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("instrument_id", "business_date", "source_id", "field", *more)


@query("dq_null_check", f"WITH {BARS}, {LONG}, {FAULTY} SELECT {_KEYS}, 'null_check' AS rule, 'high' AS severity FROM faulty WHERE value IS NULL")
def dq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(dq.null_check(_faulty(spark, sf_dir), Quality()), "rule", "severity")


@query("dq_range_check", f"WITH {BARS}, {LONG}, {FAULTY} SELECT {_KEYS}, value, 'high' AS severity FROM faulty WHERE field <> 'VOLUME' AND value < 0")
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(dq.range_check(_faulty(spark, sf_dir), Quality()), "value", "severity")


@query(
    "dq_staleness",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS business_date, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60""",
)
def dq_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments whose order was taken more than sixty days before, by the staleness rule."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("business_date"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("fetch_ts"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.lit(None).cast("string").alias("instrument_id"), "business_date", "fetch_ts", F.lit("SHIP").alias("field"), F.date_diff("business_date", "fetch_ts").cast("double").alias("value"), F.lit("orders").alias("source_id"))
    found = dq.staleness_check(rows, Config(sources=(Source("orders", staleness_max_days=60),)), keep=("l_orderkey", "l_linenumber"))
    return found.select("l_orderkey", "l_linenumber", "business_date", F.col("value").cast("bigint").alias("lag_days"))


_MONOTONE = """monotone AS (
  SELECT b.instrument_id, b.business_date, b.source_id, u.field, u.reason FROM (
    SELECT instrument_id, business_date, source_id, max(value) FILTER (field = 'OPEN') AS o, max(value) FILTER (field = 'HIGH') AS h,
           max(value) FILTER (field = 'LOW') AS l, max(value) FILTER (field = 'CLOSE') AS c
    FROM faulty GROUP BY ALL) b,
  LATERAL (SELECT 'HIGH/LOW' AS field, 'HIGH < LOW' AS reason WHERE b.h < b.l
           UNION ALL SELECT 'OPEN', 'OPEN > HIGH' WHERE b.o > b.h UNION ALL SELECT 'OPEN', 'OPEN < LOW' WHERE b.o < b.l
           UNION ALL SELECT 'CLOSE', 'CLOSE > HIGH' WHERE b.c > b.h UNION ALL SELECT 'CLOSE', 'CLOSE < LOW' WHERE b.c < b.l) u
)"""


@query("dq_monotonicity", f"WITH {BARS}, {LONG}, {FAULTY}, {_MONOTONE} SELECT {_KEYS}, reason FROM monotone")
def dq_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(dq.monotonicity_check(_faulty(spark, sf_dir), Quality()), "reason")


@query("dq_duplicates", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS n_duplicates FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later lines of an order and line number, by the duplicate rule."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    none = F.lit(None).cast("string")
    rows = lines.select("l_orderkey", "l_linenumber", none.alias("instrument_id"), F.lit(None).cast("date").alias("business_date"), none.alias("field"), F.col("l_extendedprice").alias("value"), F.lit("lineitem").alias("source_id"))
    found = dq.duplicate_check(rows, Quality(), ("l_orderkey", "l_linenumber"), keep=("l_orderkey", "l_linenumber"))
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_duplicates"))


_FOUND = f"""{_MONOTONE}, found AS (
  SELECT instrument_id, business_date, source_id, field, 'null_check' AS rule, 'high' AS severity FROM faulty WHERE value IS NULL
  UNION ALL SELECT instrument_id, business_date, source_id, field, 'range_check', 'high' FROM faulty WHERE field <> 'VOLUME' AND value < 0
  UNION ALL SELECT instrument_id, business_date, source_id, field, 'monotonicity_check', 'medium' FROM monotone
)"""


@query(
    "dq_summary_by_rule",
    f"""WITH {BARS}, {LONG}, {FAULTY}, {_FOUND}
SELECT rule, count(*) AS n_failures, count(DISTINCT instrument_id) AS n_instruments, min(severity) AS severity FROM found GROUP BY rule""",
)
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.summary(dq.failures(_faulty(spark, sf_dir), Config()))


@query(
    "dq_batch_verdicts",
    f"""WITH {BARS}, {LONG}, {FAULTY}, {_FOUND}
SELECT b.source_id, b.business_date, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, high + medium > 0 AS failed
FROM (SELECT DISTINCT source_id, business_date FROM faulty) b LEFT JOIN found f ON f.source_id = b.source_id AND f.business_date = b.business_date
GROUP BY b.source_id, b.business_date""",
)
def dq_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty(spark, sf_dir)
    return dq.verdicts(rows, dq.failures(rows, Config()))


@query(
    "quarantine_rows",
    f"""WITH {BARS}, {LONG}, {FAULTY}, {_FOUND}
SELECT {_KEYS}, value FROM faulty t WHERE EXISTS (
  SELECT 1 FROM found f WHERE f.severity = 'high' AND f.instrument_id = t.instrument_id AND f.field = t.field AND f.source_id = t.source_id AND f.business_date = t.business_date)""",
)
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty(spark, sf_dir)
    return _keys(dq.quarantine(rows, dq.failures(rows, Config())), "value")


# --- Time series ----------------------------------------------------------------------------------------------------

_WINDOW = "PARTITION BY source_id, instrument_id ORDER BY business_date RANGE BETWEEN INTERVAL 20 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING"
_SERIES = "instrument_id, source_id, business_date"


def _series(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("instrument_id", "source_id", "business_date", *more)


@query(
    "rolling_stats_20d",
    f"""WITH {FEED} SELECT {_SERIES}, hist_n, {cut_sql('m')} AS hist_mean, {cut_sql('s')} AS hist_std FROM (
  SELECT {_SERIES}, count(value) OVER w AS hist_n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM feed WINDOW w AS ({_WINDOW}))""",
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(anomaly.rolling_stats(feeds.feed(spark, sf_dir), 20), "hist_n", cut(F.col("hist_mean")).alias("hist_mean"), cut(F.col("hist_std")).alias("hist_std"))


@query(
    "rolling_zscore",
    f"""WITH {FEED} SELECT {_SERIES}, {cut_sql('(value - m) / s')} AS zscore FROM (
  SELECT {_SERIES}, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM feed WINDOW w AS ({_WINDOW}))
WHERE n >= 3 AND s > 0""",
)
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.rolling_stats(feeds.feed(spark, sf_dir), 20).withColumn("z", anomaly.zscore()).filter("z IS NOT NULL")
    return _series(rows, cut(F.col("z")).alias("zscore"))


_FENCES = f"""fenced AS (
  SELECT *, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS fence_low, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS fence_high FROM (
    SELECT {_SERIES}, value, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM feed WINDOW w AS ({_WINDOW}))
)"""


@query("iqr_fences", f"WITH {FEED}, {_FENCES} SELECT {_SERIES}, {cut_sql('q1')} AS q1, {cut_sql('q3')} AS q3, {cut_sql('fence_low')} AS fence_low, {cut_sql('fence_high')} AS fence_high FROM fenced")
def iqr_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(anomaly.fences(feeds.feed(spark, sf_dir), Anomaly()), *(cut(F.col(c)).alias(c) for c in ("q1", "q3", "fence_low", "fence_high")))


@query(
    "returns_pct_change",
    f"""WITH {FEED} SELECT {_SERIES}, {cut_sql('value / p - 1')} AS daily_return FROM (
  SELECT {_SERIES}, value, lag(value) OVER (PARTITION BY source_id, instrument_id ORDER BY business_date) AS p FROM feed) WHERE p IS NOT NULL""",
)
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.daily_returns(feeds.feed(spark, sf_dir)).filter("prev_value IS NOT NULL")
    return _series(rows, cut(F.col("return")).alias("daily_return"))


def _regime_sql(source: str) -> str:
    return f"""hist AS (
  SELECT {_SERIES}, value, list(value) OVER ({_WINDOW}) AS h FROM {source}
), rets AS (
  SELECT *, CASE WHEN len(h) >= 4 THEN list_transform(range(1, len(h)), lambda i: h[i + 1] / h[i] - 1) END AS r FROM hist
), regime AS (
  SELECT *, CASE WHEN list_stddev_samp(r) > 0 THEN list_stddev_samp(r[greatest(1, len(r) - 4):]) / list_stddev_samp(r) END AS ratio FROM rets
)"""


@query("volatility_regime_ratio", f"WITH {FEED}, {_regime_sql('feed')} SELECT {_SERIES}, {cut_sql('ratio')} AS regime_ratio FROM regime WHERE ratio IS NOT NULL")
def volatility_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anomaly.regime_ratio(feeds.feed(spark, sf_dir), Anomaly()).filter("regime_ratio IS NOT NULL")
    return _series(rows, cut(F.col("regime_ratio")).alias("regime_ratio"))


_SPIKED = """spiked AS (
  SELECT instrument_id, source_id, business_date, value * CASE WHEN p_partkey % 37 = 0 AND d = 27 THEN CAST(100.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS value FROM feed
)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir)
    spike = F.when((_part(rows) % 37 == 0) & (_day(rows) == 27), X.double(100)).otherwise(X.double(1))
    return anomaly.classify(rows.withColumn("value", F.col("value") * spike), Anomaly())


_CLASSIFIED = f"""WITH {FEED}, {_SPIKED}, {_regime_sql('spiked')}, stats AS (
  SELECT {_SERIES}, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s,
         quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3 FROM spiked WINDOW w AS ({_WINDOW})
), tested AS (
  SELECT t.*, (t.value - m) / s AS z, abs((t.value - m) / s) > 4 AS by_z,
         t.value < q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) OR t.value > q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS by_fence, coalesce(ratio > 2, FALSE) AS wild
  FROM stats t JOIN regime USING (instrument_id, source_id, business_date) WHERE n >= 3 AND s > 0
)"""


@query(
    "anomaly_classification",
    f"""{_CLASSIFIED}
SELECT {_SERIES}, {cut_sql('z')} AS zscore, by_fence AS iqr_outlier, NOT (by_z AND wild) AS is_likely_error,
       CASE WHEN by_z AND wild THEN 'volatility_regime' WHEN by_z THEN 'zscore_exceeded' ELSE 'iqr_fence' END AS reason
FROM tested WHERE by_z OR by_fence""",
)
def anomaly_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(_classified(spark, sf_dir), cut(F.col("zscore")).alias("zscore"), "iqr_outlier", "is_likely_error", "reason")


@query(
    "anomaly_counts",
    f"""{_CLASSIFIED}
SELECT source_id, count(*) AS anomalies, count(*) FILTER (NOT (by_z AND wild)) AS likely_errors, count(*) FILTER (by_z AND wild) AS regime_moves
FROM tested WHERE by_z OR by_fence GROUP BY source_id""",
)
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("anomalies"), F.count_if("is_likely_error").alias("likely_errors"), F.count_if(F.col("reason") == "volatility_regime").alias("regime_moves"))


@query(
    "prev_close_asof",
    f"""WITH {FEED}, dealt AS (SELECT * FROM feed WHERE (p_partkey + d) % 3 <> 0)
SELECT f.instrument_id, f.source_id, f.business_date, f.value, p.value AS prev_close
FROM feed f ASOF LEFT JOIN dealt p ON f.instrument_id = p.instrument_id AND f.source_id = p.source_id AND f.business_date > p.business_date""",
)
def prev_close_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every close with the latest strictly earlier one of a thinned series."""
    rows = feeds.feed(spark, sf_dir)
    thinned = rows.filter((_part(rows) + _day(rows)) % 3 != 0)
    return corporate_actions.asof(rows, thinned, ["instrument_id", "source_id"], "business_date", "value").select("instrument_id", "source_id", "business_date", "value", F.col("asof_value").alias("prev_close"))


# --- Splits ---------------------------------------------------------------------------------------------------------


def _ratio_sql(ratio: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({ratio} - CAST({c} AS DOUBLE)) / CAST({c} AS DOUBLE) <= CAST(0.05 AS DOUBLE) THEN CAST({c} AS DOUBLE)" for c in (2.0, 3.0, 1.5, 4.0)) + " END"


def _splits_sql(source: str) -> str:
    return f"""closes AS (
  SELECT {_SERIES}, value, lag(value) OVER (PARTITION BY instrument_id, source_id ORDER BY business_date) AS prev FROM {source}
), single AS (
  SELECT {_SERIES}, {_ratio_sql('prev / value')} AS ratio, prev / value AS detected FROM closes WHERE value > 0 AND prev > 0 AND {_ratio_sql('prev / value')} IS NOT NULL
), paired AS (
  SELECT a.instrument_id, a.business_date, a.source_id AS sa, b.source_id AS sb, a.value AS va, b.value AS vb, a.prev AS pa, b.prev AS pb,
         greatest(a.value, b.value) / least(a.value, b.value) AS detected, {_ratio_sql('greatest(a.value, b.value) / least(a.value, b.value)')} AS ratio
  FROM closes a JOIN closes b ON a.instrument_id = b.instrument_id AND a.business_date = b.business_date AND a.source_id < b.source_id
), blamed AS (
  SELECT *, CASE WHEN coalesce(pa > 0 AND abs(pa / va - ratio) / ratio <= CAST(0.05 AS DOUBLE), FALSE) THEN sa
                 WHEN coalesce(pb > 0 AND abs(pb / vb - ratio) / ratio <= CAST(0.05 AS DOUBLE), FALSE) THEN sb
                 WHEN va > vb THEN sa ELSE sb END AS source_id
  FROM paired WHERE ratio IS NOT NULL
), crossed AS (
  SELECT instrument_id, source_id, business_date, arg_min(ratio, sa || sb) AS ratio, arg_min(detected, sa || sb) AS detected FROM blamed GROUP BY ALL
), actions AS (
  SELECT *, 'cross' AS method FROM crossed
  UNION ALL SELECT s.*, 'single' FROM single s ANTI JOIN crossed c ON s.instrument_id = c.instrument_id AND s.source_id = c.source_id AND s.business_date = c.business_date
)"""


#: ``s1`` misses the split of every 13th part for three days: its closes are doubled back on days 15 to 17.
_LATE = """late AS (
  SELECT instrument_id, source_id, business_date, p_partkey, d, field,
         value * CASE WHEN source_id = 's1' AND p_partkey % 13 = 0 AND d BETWEEN 15 AND 17 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS value FROM feed
)"""


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir)
    missed = (F.col("source_id") == "s1") & (_part(rows) % 13 == 0) & _day(rows).between(15, 17)
    return rows.withColumn("value", F.col("value") * F.when(missed, X.double(2)).otherwise(X.double(1)))


@query("split_single_source", f"WITH {FEED}, {_splits_sql('feed')} SELECT {_SERIES}, 'SPLIT' AS action_type, ratio, {cut_sql('detected')} AS detected_ratio FROM single")
def split_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(corporate_actions.single_source(feeds.feed(spark, sf_dir), CorporateActions()), "action_type", "ratio", cut(F.col("detected_ratio")).alias("detected_ratio"))


@query("split_cross_source", f"WITH {FEED}, {_LATE}, {_splits_sql('late')} SELECT {_SERIES}, ratio, {cut_sql('detected')} AS detected_ratio FROM crossed")
def split_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(corporate_actions.cross_source(_late(spark, sf_dir), CorporateActions()), "ratio", cut(F.col("detected_ratio")).alias("detected_ratio"))


@query("split_actions_merged", f"WITH {FEED}, {_LATE}, {_splits_sql('late')} SELECT {_SERIES}, ratio, method FROM actions")
def split_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(corporate_actions.actions(_late(spark, sf_dir), CorporateActions()), "ratio", "method")


_ADJUSTED = """adjusted AS (
  SELECT f.instrument_id, f.source_id, f.business_date, f.field, f.value, coalesce(product(s.ratio), 1) AS factor
  FROM feed f LEFT JOIN single s ON s.instrument_id = f.instrument_id AND s.source_id = f.source_id AND s.business_date > f.business_date
  GROUP BY ALL
)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir)
    return corporate_actions.back_adjusted(rows, corporate_actions.single_source(rows, CorporateActions()))


@query("back_adjusted_history", f"WITH {FEED}, {_splits_sql('feed')}, {_ADJUSTED} SELECT {_SERIES}, {cut_sql('value / factor')} AS value, CAST(factor AS DOUBLE) AS adjustment, factor <> 1 AS ca_adjusted FROM adjusted")
def back_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(_adjusted(spark, sf_dir), cut(F.col("value")).alias("value"), "adjustment", "ca_adjusted")


@query(
    "gold_after_adjustment",
    "WITH " + _ELECTION.replace("FROM feed GROUP BY ALL", "FROM fixed GROUP BY ALL").replace("), wide AS (", f"), {_splits_sql('feed')}, {_ADJUSTED}, fixed AS (SELECT instrument_id, source_id, business_date, field, value / factor AS value FROM adjusted), wide AS (", 1)
    + f" SELECT instrument_id, business_date, {cut_sql('golden')} AS golden_value, confidence, quorum AS quorum_sources FROM elected WHERE golden IS NOT NULL",
)
def gold_after_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconcile.elect_known(_adjusted(spark, sf_dir), _ELECT, _SOURCES).filter("golden_value IS NOT NULL")
    return rows.select("instrument_id", "business_date", cut(F.col("golden_value")).alias("golden_value"), "confidence", X.sorted_list(F.col("quorum_sources")).alias("quorum_sources"))


# --- Remediation ----------------------------------------------------------------------------------------------------

#: ``s3`` is silent where part and day add up to a multiple of 17, ``s2`` has no number for multiples of 19.
_GAPPY = """gappy AS (
  SELECT instrument_id, business_date, field, source_id, CASE WHEN source_id = 's2' AND (p_partkey + d) % 19 = 0 THEN NULL ELSE value END AS value
  FROM feed WHERE NOT (source_id = 's3' AND (p_partkey + d) % 17 = 0)
)"""


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir)
    n = _part(rows) + _day(rows)
    rows = rows.filter(~((F.col("source_id") == "s3") & (n % 17 == 0)))
    return rows.withColumn("value", F.when(~((F.col("source_id") == "s2") & (n % 19 == 0)), F.col("value")))


@query(
    "absent_sources",
    f"""WITH {FEED}, {_GAPPY}, present AS (SELECT instrument_id, business_date, list(source_id) AS names FROM gappy WHERE value IS NOT NULL GROUP BY ALL)
SELECT instrument_id, business_date, array_to_string(list_filter(['s1', 's2', 's3'], lambda s: NOT list_contains(names, s)), ',') AS absent_sources
FROM present WHERE len(names) < 3""",
)
def absent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.absent_sources(reconcile.votes(_gappy(spark, sf_dir)), ("s1", "s2", "s3"))
    return rows.select("instrument_id", "business_date", X.sorted_list(F.col("absent_sources")).alias("absent_sources"))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks between ``s1`` and ``s3`` where ``s2`` is silent; ``s3`` is silent too on the last days."""
    rows = feeds.feed(spark, sf_dir)
    rows = rows.filter((F.col("source_id") != "s2") & ~((F.col("source_id") == "s3") & (_day(rows) >= 25)))
    return reconcile.breaks(reconcile.elect_known(rows, _ELECT, _SOURCES))


_TWO = f"""{FEED}, wide AS (
  SELECT instrument_id, business_date, max(value) FILTER (source_id = 's1') AS a, max(value) FILTER (source_id = 's3' AND d < 25) AS c FROM feed WHERE source_id <> 's2' GROUP BY ALL
), broken AS (
  SELECT business_date, c IS NULL AS lone FROM wide WHERE c IS NULL OR NOT abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25
), suspects AS (
  SELECT business_date, count(*) AS n_breaks, CASE WHEN bool_or(lone) THEN ['s2', 's3'] ELSE ['s2'] END AS names FROM broken GROUP BY business_date
)"""


@query(
    "bad_source_choice",
    f"""WITH {_TWO}
SELECT business_date, n_breaks, CAST(attempt AS INT) AS attempt, names[(attempt - 1) % len(names) + 1] AS bad_source, CAST([5, 20, 60][attempt] AS INT) AS lookback_days
FROM suspects, range(1, 4) t(attempt)""",
)
def bad_source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.attempts(_two(spark, sf_dir), Config())


@query(
    "remediation_outcomes",
    f"""WITH {FEED}, wide AS (
  SELECT instrument_id, business_date, max(value) FILTER (source_id = 's1') AS a, max(value) FILTER (source_id = 's2') AS b, max(value) FILTER (source_id = 's3') AS c FROM feed GROUP BY ALL
), tried AS (
  SELECT business_date, count(*) FILTER (NOT abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25) AS attempted,
         count(*) FILTER (NOT abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25 AND abs(a - b) / greatest(abs(a), abs(b)) * 10000 <= 25) AS succeeded
  FROM wide GROUP BY business_date
)
SELECT business_date, attempted, succeeded, {cut_sql('CASE WHEN attempted = 0 THEN 1.0 ELSE CAST(succeeded AS DOUBLE) / attempted END')} AS success_rate,
       CASE WHEN attempted > succeeded THEN 'RED' WHEN attempted > 0 THEN 'AMBER' ELSE 'GREEN' END AS overall_status
FROM tried""",
)
def remediation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of two sources, and how many are gone once the third source has answered."""
    rows = feeds.feed(spark, sf_dir)
    before = reconcile.elect_known(rows.filter("source_id <> 's2'"), _ELECT, _SOURCES).select("instrument_id", "business_date", "golden_value")
    after = _elected(spark, sf_dir).select("instrument_id", "business_date", F.array_contains("quorum_sources", "s2").alias("joined"), F.array_contains("quorum_sources", "s1").alias("kept"))
    both = before.join(after, ["instrument_id", "business_date"]).groupBy("business_date").agg(
        F.count_if(F.col("golden_value").isNull()).alias("attempted"), F.count_if(F.col("golden_value").isNull() & F.col("joined") & F.col("kept")).alias("succeeded")
    )
    rate = remediation.success_rate(F.col("succeeded"), F.col("attempted"))
    return both.select("*", cut(rate).alias("success_rate"), audit.status(F.col("attempted") - F.col("succeeded"), F.col("attempted")).alias("overall_status"))


# --- Audit ----------------------------------------------------------------------------------------------------------


@query(
    "gold_lineage_join",
    f"""WITH {_ELECTION}
SELECT e.instrument_id, e.business_date, {six_sql('golden')} AS golden_value, a AS input_s1, b AS input_s2, c AS input_s3, 'CLOSE:25bps' AS rule_applied, TRUE AS verified
FROM elected e JOIN wide w USING (instrument_id, business_date, field) WHERE golden IS NOT NULL""",
)
def gold_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = _elected(spark, sf_dir)
    rows = audit.lineage(reconcile.gold(elected, "run"), reconcile.decisions(elected, "run"))
    return rows.select("instrument_id", "business_date", F.col("golden_value").cast("double").alias("golden_value"), *(F.col("inputs")[s].alias(f"input_{s}") for s in ("s1", "s2", "s3")), "rule_applied", "verified")


_LOG = f"""log AS (
  SELECT business_date, 'RECONCILE' AS decision_type FROM elected WHERE golden IS NOT NULL
  UNION ALL SELECT business_date, CASE WHEN confidence = 'MEDIUM' AND dissent = 's3' THEN 'REMEDIATE' ELSE 'ESCALATE' END FROM elected WHERE confidence <> 'HIGH' AND EXTRACT(DAY FROM business_date) % 2 = 0
  UNION ALL SELECT business_date, 'CORP_ACTION' FROM single
)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: elections, remediations of dissent on even days, and detected splits."""
    elected = _elected(spark, sf_dir)
    even = (F.col("confidence") != "HIGH") & (F.dayofmonth("business_date") % 2 == 0)
    mended = (F.col("confidence") == "MEDIUM") & (F.array_join("dissenting_sources", ",") == "s3")
    kinds = F.array_compact(F.array(F.when(F.col("golden_value").isNotNull(), "RECONCILE"), F.when(even, F.when(mended, "REMEDIATE").otherwise("ESCALATE"))))
    rows = elected.select("business_date", F.explode(kinds).alias("decision_type"))
    splits = corporate_actions.single_source(feeds.feed(spark, sf_dir), CorporateActions())
    return rows.unionByName(splits.select("business_date", F.lit("CORP_ACTION").alias("decision_type")))


@query("decision_counts", f"WITH {_ELECTION}, {_splits_sql('feed')}, {_LOG} SELECT business_date, decision_type, count(*) AS n FROM log GROUP BY ALL")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_counts(_log(spark, sf_dir), "business_date")


@query(
    "scorecard_status",
    f"""WITH {_ELECTION}, {_splits_sql('feed')}, {_LOG}
SELECT business_date, count(*) FILTER (decision_type = 'ESCALATE') AS escalations, count(*) FILTER (decision_type = 'REMEDIATE') AS remediations_succeeded,
       count(*) FILTER (decision_type = 'CORP_ACTION') AS corporate_actions_detected, escalations + remediations_succeeded AS breaks_detected,
       escalations + remediations_succeeded AS remediations_attempted,
       CASE WHEN escalations > 0 THEN 'RED' WHEN remediations_succeeded > 0 THEN 'AMBER' ELSE 'GREEN' END AS overall_status
FROM log GROUP BY business_date""",
)
def scorecard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scorecard_from_decisions(_log(spark, sf_dir), ["business_date"])


@query(
    "scorecard_upsert_latest",
    "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer stands: the upsert rule."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return audit.latest(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query(
    "replay_diff",
    f"""WITH {_ELECTION}, stored AS (
  SELECT instrument_id, business_date, {six_sql('golden')} + CASE WHEN instrument_id LIKE '%77' THEN 1 ELSE 0 END AS golden_value, confidence FROM elected WHERE golden IS NOT NULL
), replayed AS (SELECT instrument_id, business_date, {six_sql('golden')} AS golden_value, confidence FROM elected WHERE golden IS NOT NULL)
SELECT *, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM replayed)
UNION ALL SELECT *, 'replayed' FROM (SELECT * FROM replayed EXCEPT ALL SELECT * FROM stored)""",
)
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored gold, tampered with where the instrument ends in 77, against its replay."""
    rows = reconcile.gold(_elected(spark, sf_dir), "run").select("instrument_id", "business_date", F.col("golden_value").cast("double").alias("golden_value"), "confidence")
    stored = rows.withColumn("golden_value", F.col("golden_value") + F.when(F.col("instrument_id").endswith("77"), X.double(1)).otherwise(X.double(0)))
    return audit.replay_difference(stored, rows, rows.columns).drop("surplus")


@query(
    "replay_recomputed",
    f"""WITH {_ELECTION}, stored AS (
  SELECT instrument_id, business_date, {six_sql('golden')} + CASE WHEN instrument_id LIKE '%7' AND confidence = 'HIGH' THEN 1 ELSE 0 END AS golden_value, confidence, quorum, dissent FROM elected WHERE golden IS NOT NULL
), replayed AS (SELECT instrument_id, business_date, {six_sql('golden')} AS golden_value, confidence, quorum, dissent FROM elected WHERE golden IS NOT NULL)
SELECT instrument_id, business_date, golden_value, confidence, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM replayed)
UNION ALL SELECT instrument_id, business_date, golden_value, confidence, 'replayed' FROM (SELECT * FROM replayed EXCEPT ALL SELECT * FROM stored)""",
)
def replay_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold elected over columns, tampered with where it was unanimous and the instrument ends in 7, against its
    recomputation from the same silver by the election over arrays."""
    kept = ["instrument_id", "business_date", "golden_value", "confidence", "quorum_sources", "dissenting_sources"]
    rows = lambda elected: reconcile.gold(elected, "run").select(*kept).withColumn("golden_value", F.col("golden_value").cast("double"))
    wrong = F.col("instrument_id").endswith("7") & (F.col("confidence") == "HIGH")
    stored = rows(_elected(spark, sf_dir)).withColumn("golden_value", F.col("golden_value") + F.when(wrong, X.double(1)).otherwise(X.double(0)))
    fresh = rows(reconcile.elect(reconcile.votes(feeds.feed(spark, sf_dir)), _ELECT))
    return audit.replay_difference(stored, fresh, kept).select(*kept[:4], "side")


@query(
    "symbol_lookup",
    """SELECT l_orderkey, l_linenumber, p_name AS instrument, n_name AS market FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
)
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider keys to canonical names through a universe of (source, symbol); unknown symbols vanish."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    universe = read("part").select(F.lit("part").alias("source_id"), F.col("p_partkey").alias("source_symbol"), F.col("p_name").alias("instrument"))
    markets = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("market"))
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.lit("part").alias("source_id"), F.col("l_partkey").alias("source_symbol"))
    return feeds.map_symbols(rows, universe).join(markets, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "instrument", "market")


@query(
    "scorecard_rollup",
    f"""WITH {_ELECTION} SELECT confidence, business_date, count(*) AS n, CAST(grouping(confidence, business_date) AS BIGINT) AS level FROM elected GROUP BY ROLLUP (confidence, business_date)""",
)
def scorecard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elected(spark, sf_dir).rollup("confidence", "business_date").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# --- Events ---------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("event_topic_histogram", "SELECT user_id AS run_id, event_type AS topic, count(*) AS n FROM events GROUP BY ALL")
def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.topic_counts(_events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("topic")))


@query("event_dedup_insert_ignore", "SELECT event_id, ts, user_id, event_type, value FROM events")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, written again with other values: first writes stand."""
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    again = rows.withColumn("value", F.col("value") + 1)
    return audit.insert_ignore(rows, again.unionByName(again), "event_id", ["value"])


@query("barrier_all_sources_reported", "SELECT user_id, count(DISTINCT event_type) AS n_sources, n_sources >= 5 AS complete FROM events GROUP BY user_id")
def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.number_of_sources(_events(spark, sf_dir), "user_id", "event_type", 5)


@query(
    "latest_filing_argmax",
    """SELECT cik, "end", form, val FROM (
  SELECT CAST(user_id AS VARCHAR) AS cik, CAST(ts AS VARCHAR) AS "end", event_type AS form, CAST(json_extract(props, '$.k') AS DOUBLE) AS val,
         row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type IN ('10-K', '10-Q') THEN 1 ELSE 0 END DESC, ts DESC, CAST(json_extract(props, '$.k') AS DOUBLE) DESC) AS n
  FROM (SELECT user_id, ts, props, CASE WHEN event_type IN ('purchase', 'click') THEN '10-Q' ELSE event_type END AS event_type FROM events)) WHERE n = 1""",
)
def latest_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry per company with preferred forms first, entries from JSON."""
    form = F.when(F.col("event_type").isin("purchase", "click"), "10-Q").otherwise(F.col("event_type"))
    stamp = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")
    end = F.when(F.date_format("ts", "SSSSSS") == "000000", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(stamp)
    val = F.from_json("props", "k double")["k"]
    entries = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("cik"), form.alias("form"), end.alias("end"), F.lit(None).cast("string").alias("filed"), val.alias("val"))
    return feeds.latest_filing(entries).drop("filed")


@query(
    "fx_reference_shape",
    """SELECT concat('EUR/', n_name) AS instrument_id, 'CLOSE' AS field, CAST(n_regionkey + 1 AS DOUBLE) AS value, n_name AS currency, 'rates' AS source_id FROM nation
UNION ALL SELECT s_name, 'SHARES', s_acctbal, 'shares', 'filings' FROM supplier""",
)
def fx_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference feeds in canonical shape: they never reach the vote."""
    day = F.lit("2024-01-02").cast("timestamp")
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    fx = nation.select(day.alias("Date"), F.concat(F.lit("EUR/"), "n_name").alias("instrument_id"), F.col("n_name").alias("source_symbol"), (F.col("n_regionkey") + 1).cast("double").alias("rate"), F.col("n_name").alias("currency"), day.alias("fetch_ts"))
    shares = supplier.select(day.alias("Date"), F.col("s_name").alias("instrument_id"), F.col("s_suppkey").cast("string").alias("cik"), F.col("s_acctbal").alias("value"), day.alias("fetch_ts"))
    both = contract.rates_to_silver(fx, "rates").unionByName(contract.shares_to_silver(shares, "filings"))
    return both.select("instrument_id", "field", "value", "currency", "source_id")


@query(
    "currency_fallback",
    f"""WITH {FEED}, tagged AS (SELECT *, CASE WHEN source_id = 's2' AND p_partkey % 3 = 0 THEN 'GBP' WHEN source_id = 's3' AND p_partkey % 2 = 0 THEN 'EUR' END AS currency FROM feed)
SELECT instrument_id, business_date, coalesce(arg_min(currency, source_id) FILTER (currency IS NOT NULL), 'USD') AS currency FROM tagged GROUP BY instrument_id, business_date""",
)
def currency_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir)
    currency = F.when((F.col("source_id") == "s2") & (_part(rows) % 3 == 0), "GBP").when((F.col("source_id") == "s3") & (_part(rows) % 2 == 0), "EUR")
    return reconcile.votes(rows.withColumn("currency", currency)).select("instrument_id", "business_date", "currency")


@query("inject_cross_source_break", f"WITH {FEED} SELECT {_SERIES}, {cut_sql(chr(39).join(['CASE WHEN source_id = ', 's3', ' THEN value * CAST(1.1 AS DOUBLE) ELSE value END']))} AS value FROM feed")
def inject_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(inject.inject(feeds.feed(spark, sf_dir), "cross_source_break", source_id="s3"), cut(F.col("value")).alias("value"))


@query("inject_stale", "SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL 3 DAYS AS event_ts FROM events")
def inject_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.inject(_events(spark, sf_dir).select("event_id", F.col("ts").alias("event_ts")), "stale_feed", days=3)


@query("inject_volatility_regime", f"WITH {FEED} SELECT {_SERIES}, {cut_sql('value * 3')} AS value FROM feed")
def inject_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(inject.inject(feeds.feed(spark, sf_dir), "volatility_regime"), cut(F.col("value")).alias("value"))


@query("tumbling_hourly_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "max_value")


@query(
    "event_query_ordered",
    "SELECT event_id, event_type AS topic, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events",
)
def events_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"), "ts")
    return audit.numbered(rows, "topic", "ts", ["event_id"])


# --- Rounds of remediation and the whole log -------------------------------------------------------------------------

_PAIR = Config(sources=(Source("s1"), Source("s3")), reconciliation=_ELECT)


def _healed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``remediate`` over ``s1`` and ``s3``, where ``s3``, asked again, gives what ``s1`` has."""
    rows = feeds.feed(spark, sf_dir)
    silver = rows.filter("source_id <> 's2'")
    true = lambda source: rows.filter("source_id = 's1'").withColumn("source_id", F.lit(source))
    return silver, *remediation.remediate(spark, silver, _PAIR, lambda source, days: true(source), "run", lambda frame: frame)


_PAIRED = f"""{FEED}, duo AS MATERIALIZED (
  SELECT instrument_id, business_date, max(value) FILTER (source_id = 's1') AS a, max(value) FILTER (source_id = 's3') AS c FROM feed WHERE source_id <> 's2' GROUP BY instrument_id, business_date
), torn AS (SELECT instrument_id, business_date, NOT abs(a - c) / greatest(abs(a), abs(c)) * 10000 <= 25 AS broken, a, c FROM duo)"""


@query(
    "remediation_rounds",
    f"""WITH {_PAIRED}, n AS (SELECT count(*) FILTER (broken) AS n_breaks FROM torn)
SELECT CAST(1 AS INT) AS attempt, 's1' AS bad_source, CAST(5 AS INT) AS lookback_days, n_breaks, 'refetched' AS outcome FROM n WHERE n_breaks > 0
UNION ALL SELECT 2, 's3', 20, n_breaks, 'refetched' FROM n WHERE n_breaks > 0
UNION ALL SELECT CASE WHEN n_breaks > 0 THEN 2 ELSE 0 END, NULL, NULL, 0, CASE WHEN n_breaks > 0 THEN 'remediated' ELSE 'clean' END FROM n""",
)
def remediation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts that the loop makes until nothing is broken any more."""
    return _healed(spark, sf_dir)[3].drop("run_id")


@query(
    "remediated_gold",
    f"""WITH {_PAIRED} SELECT instrument_id, business_date, {six_sql('a')} AS golden_value, 'HIGH' AS confidence FROM torn""",
)
def remediated_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of the last election of the loop."""
    rows = reconcile.gold(_healed(spark, sf_dir)[1], "run")
    return rows.select("instrument_id", "business_date", F.col("golden_value").cast("double").alias("golden_value"), "confidence")


@query(
    "decision_log_all_kinds",
    f"""WITH {BARS}, {LONG}, {FAULTY}, {_FOUND}, {_PAIRED}, {_splits_sql('feed')},
batches AS (SELECT source_id, business_date, count(*) AS n_rows, count(*) FILTER (value IS NULL OR field = 'VOLUMEN') = 0 AS passed FROM faulty GROUP BY ALL),
wrong AS (SELECT DISTINCT source_id, business_date FROM found),
entries AS (
  SELECT business_date, 'INGEST' AS decision_type, 'ingestion' AS agent, TRUE AS verified FROM batches
  UNION ALL SELECT business_date, 'CONTRACT', 'contract', passed FROM batches
  UNION ALL SELECT b.business_date, 'DQ', 'quality', w.source_id IS NULL FROM batches b LEFT JOIN wrong w ON w.source_id = b.source_id AND w.business_date = b.business_date
  UNION ALL SELECT business_date, 'CORP_ACTION', 'corporate_actions', TRUE FROM single
  UNION ALL SELECT business_date, 'REMEDIATE', 'remediation', TRUE FROM (SELECT DISTINCT business_date FROM torn WHERE broken)
  UNION ALL SELECT business_date, 'RECONCILE', 'reconciliation', TRUE FROM torn
)
SELECT business_date, decision_type, agent, verified, count(*) AS n FROM entries GROUP BY ALL""",
)
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all kinds of decisions by date: batches of the faulty bars, splits of the feed, a healed election."""
    faulty = _faulty(spark, sf_dir)
    judged = contract.verdicts(faulty)
    found = dq.failures(faulty, Config(quality=Quality(enabled=("null_check", "range_check", "monotonicity_check"))))
    _, elected, _, attempts, opened = _healed(spark, sf_dir)
    splits = corporate_actions.single_source(feeds.feed(spark, sf_dir), CorporateActions()).withColumn("method", F.lit("single"))
    decisions = log.together(
        log.ingestion_decisions(judged, "run"), log.contract_decisions(judged, "run"), log.quality_decisions(dq.verdicts(faulty, found), "run"),
        log.split_decisions(splits, "run"), log.remediation_decisions(opened, reconcile.breaks(elected), attempts, "run"), reconcile.decisions(elected, "run"),
    )
    return decisions.groupBy("business_date", "decision_type", "agent", "verified").agg(F.count("*").alias("n"))


# --- Scans, limits and sums ------------------------------------------------------------------------------------------


@query(
    "violations_reported",
    f"""WITH {BARS}, {LONG}, {FAULTY}
SELECT rule, source_id, instrument_id, business_date, field FROM (
  SELECT *, 'value_missing' AS rule FROM faulty WHERE value IS NULL UNION ALL SELECT *, 'field_unknown' FROM faulty WHERE field = 'VOLUMEN')
ORDER BY rule, source_id, instrument_id, business_date, field LIMIT 20""",
)
def violations_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many violations as a message carries."""
    return contract.report(contract.violations(_faulty(spark, sf_dir))).select("rule", "source_id", "instrument_id", "business_date", "field")


@query(
    "rows_adjusted",
    f"""WITH {FEED}, {_splits_sql('feed')}, adjusted AS (SELECT source_id, business_date, d >= 0 AND EXISTS (SELECT 1 FROM single s WHERE s.instrument_id = f.instrument_id AND s.source_id = f.source_id AND s.business_date > f.business_date) AS hit FROM feed f)
SELECT source_id, business_date, count(*) AS n_rows, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_adjusted FROM adjusted GROUP BY ALL""",
)
def rows_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a source and day the back-adjustment has changed."""
    rows = feeds.feed(spark, sf_dir)
    found = corporate_actions.back_adjusted(rows, corporate_actions.single_source(rows, CorporateActions()))
    return found.groupBy("source_id", "business_date").agg(F.count("*").alias("n_rows"), F.sum(F.col("ca_adjusted").cast("bigint")).alias("n_adjusted"))


_RUNS = """runs AS (
  SELECT l_suppkey % 3 AS supplier, CAST(l_shipdate AS DATE) AS business_date, concat('r', CAST(l_linenumber % 2 AS VARCHAR)) AS run_id,
         concat('s', CAST(l_suppkey % 3 AS VARCHAR)) AS source_id, l_orderkey, l_linenumber, l_quantity
  FROM lineitem
)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_shipdate").cast("date").alias("business_date"), F.concat(F.lit("r"), (F.col("l_linenumber") % 2).cast("string")).alias("run_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source_id"), "l_orderkey", "l_linenumber", "l_quantity")


@query(
    "silver_window",
    f"""WITH {_RUNS}, near AS (SELECT * FROM runs WHERE business_date BETWEEN DATE '1995-03-01' - 30 AND DATE '1995-03-01')
SELECT source_id, business_date, run_id, l_orderkey, l_linenumber, l_quantity FROM near n
WHERE run_id = (SELECT max(run_id) FROM near m WHERE m.source_id = n.source_id AND m.business_date = n.business_date)""",
)
def silver_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of thirty days up to a date, both ends included, of the latest run per source and day."""
    rows = layers.window(_runs(spark, sf_dir), "1995-03-01", 30)
    return rows.select("source_id", "business_date", "run_id", "l_orderkey", "l_linenumber", "l_quantity")


@query(
    "silver_for_replay",
    f"""WITH {_RUNS}, own AS (SELECT * FROM runs WHERE run_id = 'r1')
SELECT source_id, business_date, l_orderkey, l_linenumber, l_quantity FROM own o WHERE business_date = (SELECT max(business_date) FROM own m WHERE m.source_id = o.source_id)""",
)
def silver_for_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's rows of its last date in a run."""
    return layers.last_of_run(_runs(spark, sf_dir), "r1").select("source_id", "business_date", "l_orderkey", "l_linenumber", "l_quantity")


def _injected(spark: SparkSession, sf_dir: str, defect: str, **settings: object) -> DataFrame:
    """Rows of the feed, rows without a value, rows whose value has changed, and by how much."""
    rows = feeds.feed(spark, sf_dir).withColumn("was", F.col("value"))
    found = inject.inject(rows, defect, **settings)
    changed = F.col("value").isNotNull() & (F.col("value") != F.col("was"))
    return found.agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(changed).alias("n_changed"), cut(F.max(F.when(changed, F.col("value") / F.col("was")))).alias("factor"))


@query("inject_null_burst", f"WITH {FEED} SELECT count(*) AS n_rows, CAST(greatest(1, floor(count(*) * CAST(0.3 AS DOUBLE))) AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_changed, CAST(NULL AS DOUBLE) AS factor FROM feed")
def inject_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "null_burst")


@query("inject_out_of_range", f"WITH {FEED} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(1 AS BIGINT) AS n_changed, CAST(100 AS DOUBLE) AS factor FROM feed")
def inject_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "out_of_range")


@query("inject_unadjusted_split", f"WITH {FEED} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(1 AS BIGINT) AS n_changed, CAST(2 AS DOUBLE) AS factor FROM feed")
def inject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "unadjusted_split")


@query("inject_schema_drift", f"WITH {FEED} SELECT {_SERIES}, {cut_sql('value')} AS price FROM feed")
def inject_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed(spark, sf_dir).withColumn("value", cut(F.col("value")))
    return inject.inject(rows, "schema_drift", rename={"value": "price"}, drop=["field"])
