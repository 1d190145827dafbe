"""Event log as a stream: append, dedup, windows, the barrier, and stage order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources import schemas
from tessera.sources.schemas import TOPICS



def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events appended to a folder as Parquet, as a stream."""
    reader = spark.readStream.schema(schemas.EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str, starting: str = "latest") -> DataFrame:
    """Events of Kafka topics, JSON values; needs Spark's Kafka connector on the class path.  Offsets are checkpointed."""
    return from_kafka(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).load())


def from_kafka(raw: DataFrame) -> DataFrame:
    """Events of Kafka records; a value that is no event is dropped."""
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.EVENTS).alias("e")).select("e.*").filter("event_id IS NOT NULL")


def to_kafka(events: DataFrame, prefix: str = "") -> DataFrame:
    """Kafka records of events: the run as key, so that a run stays in order, the event as JSON, its topic behind ``prefix``."""
    return events.select(F.col("run_id").cast("binary").alias("key"), F.to_json(F.struct(*schemas.EVENTS.names)).cast("binary").alias("value"), F.concat(F.lit(prefix), "topic").alias("topic"))


def publish(events: DataFrame, servers: str, prefix: str = "", checkpoint: str | None = None) -> StreamingQuery | None:
    """Send events to Kafka: a batch at once, a stream until all that is there is sent.  Needs Spark's Kafka connector."""
    rows = to_kafka(events, prefix)
    if not events.isStreaming:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        return None
    query = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def subscribe(events: DataFrame, topics: list[str]) -> DataFrame:
    """Events of the topics that a stage listens to; a topic that there is not is an error."""
    if unknown := sorted(set(topics) - set(TOPICS)):
        raise ValueError(f"unknown topics: {', '.join(unknown)}")
    return events.filter(F.col("topic").isin(*topics))


def dedup(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Insert-or-ignore on the event id: repeats within the lateness are dropped, and state is forgotten after it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events per topic and window; a window is final once the watermark has passed it."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "topic").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "topic", "n")


def barrier(events: DataFrame, sources: tuple[str, ...], lateness: str = "1 day") -> DataFrame:
    """Runs that all ``sources`` have reported for, each once, with the time of the last report.

    ``agent`` names the source.  A run's state is the set of sources seen, at most as long as ``sources``; it is kept
    until the run is complete and then only remembers that.  A run that reports nothing more is forgotten once the
    watermark is ``lateness`` past its last report.
    """
    wanted = set(sources)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, fired = (state.get[0].split(","), state.get[1]) if state.exists else ([], False)
        have, last = set(filter(None, seen)), None
        for batch in batches:
            have |= wanted & set(batch["agent"])
            last = max(filter(pd.notna, [last, batch["ts"].max()]), default=None)
        done = have == wanted
        state.update((",".join(sorted(have)), done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(last.timestamp() * 1000) if last is not None else 0) + _milliseconds(lateness))
        if done and not fired:
            yield pd.DataFrame({"run_id": [key[0]], "n_sources": [len(have)], "last_report": [last]})

    return events.withWatermark("ts", lateness).groupBy("run_id").applyInPandasWithState(
        step, "run_id string, n_sources bigint, last_report timestamp", "seen string, fired boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there as Parquet and stop: a true barrier, and safe to repeat after a crash."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Persist a stream of events before anything downstream reads it, ignoring ids that are there already.

    A batch that is replayed after a crash finds its rows in the log and adds nothing.  The log lies by day, and a batch
    is held against the days that it has events of, not against the whole log.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy("event_id").agg(F.min(F.struct("ts", "topic", "agent", "run_id", "payload")).alias("r")).select("event_id", "r.*")
        rows = rows.select(*schemas.EVENTS.names, F.to_date("ts").alias("day"))
        days = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        try:
            there = spark.read.schema(T.StructType([*schemas.EVENTS.fields, T.StructField("day", T.DateType())])).parquet(path)
            same = there.filter(F.col("day").between(days.low, days.high) | F.col("day").isNull())
            rows = rows.join(same.select("event_id"), "event_id", "left_anti")
        except AnalysisException as error:  # the first batch finds no log yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        rows.write.mode("append").partitionBy("day").parquet(path)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
