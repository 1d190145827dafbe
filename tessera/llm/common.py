"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that an operator is handed at once, or one row that is longer.
PIECE_BYTES = 1_000_000

#: Rows of ids that may be broadcast to pick texts; with more the texts are shuffled.
BROADCAST_IDS = 500_000

_DIR_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it need not be installed on them."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).resolve().parent.parent
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of ``PIECE_BYTES`` of texts or one longer row; none of them is empty."""
    for batch in batches:
        if batch.nbytes <= PIECE_BYTES:
            if batch.num_rows:
                yield batch
            continue
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over ``pieces``, so that a worker's memory follows the bytes of texts and not the number of rows.

    Spark itself ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set); no setting is changed.
    """
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: function(pieces(batches)), schema)


_own_dirs: dict[str, str] = {}
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own, gone at the end; any other master is an error, as
    executors on other machines would each write to their own disk.
    """
    folder = spark.conf.get(_DIR_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set {_DIR_KEY} to a folder that all executors share: the master is {master}")
        application = spark.sparkContext.applicationId
        folder = _own_dirs.get(application)
        if folder is None:
            folder = _own_dirs[application] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder for stored tables; the driver's JVM deletes it when it ends."""
    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/tessera/{application}"
    if _scratch.get(application) != path:
        _scratch[application] = path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    A lost executor then costs a re-read, not a recomputation, and the reader sees true sizes for its join choices.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in folder:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return F.col(column).cast("string").cast("binary").alias("_text")


def with_row_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``docs``, so that extra columns cannot clash with an operator's own."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def pick(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join of a table of texts with a stored table of ids, without a shuffle of texts while ids are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def keep_rows(df: DataFrame, judge: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text is approved, all columns unchanged; one narrow pass.

    ``judge()``, called once a task, gives a function from a batch's texts (str or None) to booleans.
    """
    place = df.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        approve = judge()
        for batch in batches:
            yield batch.filter(pa.array(approve(batch.column(place).to_pylist()), pa.bool_()))

    return map_arrow(df, run, df.schema)
