"""Readers and writers of the layers: partitioned Parquet with the write rules of each layer."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import schemas

#: Hive partitions of each layer, outermost first.
PARTITIONS = {
    "bronze": ("source_id", "run_id", "business_date"),
    "silver": ("run_id", "source_id", "business_date"),
    "gold": ("run_id", "business_date"),
    "quarantine": ("run_id", "quarantine_reason", "source_id", "business_date"),
    "decisions": ("business_date",),
    "scorecard": ("run_id",),
    "events": ("run_id",),
}


class Layers:
    """The layers under one root folder.  All reads prune by partition; nothing computes paths by hand."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str) -> str:
        return f"{self.root}/{layer}"

    def read(self, layer: str, schema: T.StructType | None = None) -> DataFrame | None:
        """All of a layer, or ``None`` before anything was written to it."""
        try:
            reader = self.spark.read
            return (reader.schema(schema) if schema else reader).parquet(self.path(layer))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def _write(self, layer: str, rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).partitionBy(*PARTITIONS[layer])
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path(layer))

    def write_bronze(self, rows: DataFrame) -> None:
        """Write-once: partitions that are there already stay as they are."""
        there = self.read("bronze")
        if there is not None:
            keys = list(PARTITIONS["bronze"])
            old = there.select(*(F.col(k).cast(rows.schema[k].dataType) for k in keys)).distinct()
            rows = rows.join(old, keys, "left_anti")
        self._write("bronze", rows, "append")

    def write_silver(self, rows: DataFrame) -> None:
        """The partitions in ``rows`` are replaced, others stay."""
        self._write("silver", rows, "overwrite")

    def write_gold(self, rows: DataFrame) -> None:
        """As silver; an empty batch is an error."""
        if rows.isEmpty():
            raise ValueError("an empty gold batch is not written")
        self._write("gold", rows, "overwrite")

    def write_quarantine(self, rows: DataFrame, reason: str, when: Column | None = None) -> None:
        """Rows with their reason and the time; the source is part of the place, so sources never overwrite one another."""
        self._write("quarantine", rows.withColumns({"quarantine_reason": F.lit(reason), "quarantine_ts": F.current_timestamp() if when is None else when}), "overwrite")

    def read_gold(self, run_id: str, business_date: str) -> DataFrame:
        """Gold of a run and date; empty, with the layer's schema, where there is none."""
        there = self.read("gold")
        empty = self.spark.createDataFrame([], T.StructType([*schemas.GOLD.fields, T.StructField("run_id", T.StringType())]))
        return empty if there is None else there.filter((F.col("run_id") == run_id) & (F.col("business_date") == F.lit(business_date).cast("date")))

    def silver_window(self, business_date: str, days: int, source_id: str | None = None) -> DataFrame | None:
        """Rows of all runs from ``days`` before a date up to it; of several runs the latest per source and date counts."""
        rows = self.read("silver")
        if rows is None:
            return None
        return window(rows, business_date, days, source_id)

    def silver_for_replay(self, run_id: str) -> DataFrame | None:
        """Of a run, each source's rows of its last date."""
        rows = self.read("silver")
        if rows is None:
            return None
        return last_of_run(rows, run_id)

    def append_new(self, layer: str, rows: DataFrame, key: str) -> None:
        """Insert-or-ignore: rows whose key is there already are left out; of several in the batch the least row counts.

        Only those partitions are read that the batch lies between, as equal keys lie in one partition.  A column of
        maps cannot be compared; rows are told apart by the others.
        """
        plain = [c for c in rows.columns if c != key and not isinstance(rows.schema[c].dataType, T.MapType)]
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*plain)).alias("_r")).select("_r.*")
        there = self.read(layer)
        if there is not None:
            part = PARTITIONS[layer][0]
            low, high = rows.agg(F.min(part), F.max(part)).first()
            same = F.col(part).isNull() if low is None else F.col(part).between(low, high) | F.col(part).isNull()
            rows = rows.join(there.filter(same).select(key), key, "left_anti")
        self._write(layer, rows, "append")

    def upsert_scorecard(self, rows: DataFrame) -> None:
        """One row per run and source: the new one wins."""
        there = self.read("scorecard", schemas.SCORECARD)
        if there is not None:
            runs = rows.select("run_id").distinct()
            old = there.join(F.broadcast(runs), "run_id", "left_semi").join(rows.select("run_id", "source_id"), ["run_id", "source_id"], "left_anti")
            # Laid aside first: a partition cannot be read and replaced by one job.
            aside = f"{self.root}/work/scorecard/{uuid.uuid4().hex}"
            rows.unionByName(old).write.parquet(aside)
            rows = self.spark.read.schema(schemas.SCORECARD).parquet(aside)
        self._write("scorecard", rows, "overwrite")

    def read_scorecard(self, run_id: str) -> DataFrame | None:
        rows = self.read("scorecard", schemas.SCORECARD)
        return None if rows is None else rows.filter(F.col("run_id") == run_id).orderBy("source_id")

    def events(self, run_id: str | None = None, topic: str | None = None) -> DataFrame | None:
        """Logged events by run and topic, in order of time."""
        rows = self.read("events")
        if rows is None:
            return None
        for name, value in (("run_id", run_id), ("topic", topic)):
            rows = rows if value is None else rows.filter(F.col(name) == value)
        return rows.orderBy("ts", "event_id")

    def write_text(self, name: str, text: str) -> None:
        """A small text file under the root, through Spark's file system, so any store will do."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def sql(self, text: str) -> DataFrame:
        """Ad-hoc SQL over the layers that there are, as views of their names."""
        for layer in PARTITIONS:
            rows = self.read(layer)
            if rows is not None:
                rows.createOrReplaceTempView(layer)
        return self.spark.sql(text)


def window(rows: DataFrame, business_date: str, days: int, source_id: str | None = None) -> DataFrame:
    """Rows from ``days`` before a date up to it, both included, of the latest run per source and date."""
    last = F.lit(business_date).cast("date")
    rows = rows.filter(F.col("business_date").between(F.date_sub(last, days), last))
    return latest_run(rows if source_id is None else rows.filter(F.col("source_id") == source_id))


def last_of_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Of a run, each source's rows of its last date."""
    rows = rows.filter(F.col("run_id") == run_id)
    last = rows.groupBy("source_id").agg(F.max("business_date").alias("business_date"))
    return rows.join(F.broadcast(last), ["source_id", "business_date"], "left_semi")  # a row per source


def latest_run(rows: DataFrame) -> DataFrame:
    """Of several runs of one source and date, the rows of the last run id."""
    last = rows.groupBy("source_id", "business_date").agg(F.max("run_id").alias("run_id"))
    return rows.join(last, ["source_id", "business_date", "run_id"], "left_semi")


class Fixtures:
    """Frozen inputs by source and tag."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def snapshot(self, source_id: str, rows: DataFrame, tag: str) -> str:
        path = f"{self.root}/source={source_id}/tag={tag}"
        rows.write.mode("overwrite").parquet(path)
        return path

    def load(self, source_id: str, tag: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/source={source_id}/tag={tag}")
        except AnalysisException as error:
            raise FileNotFoundError(f"no fixture {tag} of {source_id}") from error

    def names(self) -> list[tuple[str, str]]:
        """Source and tag of every fixture, by Spark's own file listing, so any store will do."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/source=*/tag=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted((p.getParent().getName().split("=", 1)[1], p.getName().split("=", 1)[1]) for p in (s.getPath() for s in found))
