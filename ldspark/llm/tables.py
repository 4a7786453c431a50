"""Reading input tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes of one Arrow batch given to Python; a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_LISTENING: ContextVar[list[str] | None] = ContextVar("listening", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what one Python batch holds, and ship this package to the executors (once an application)."""
    ship(spark)
    for key, limit in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        spark.conf.set(key, str(limit))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ldspark-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read from there: a later
    loss of an executor re-reads files instead of recomputing, and every reader sees the same rows.
    The folder is deleted when the application ends, or earlier by whoever listens with `collecting`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(spark, path)
    listening = _LISTENING.get()
    if listening is not None:
        listening.append(path)
    # the shuffles behind the table are done with; executors delete their files when the driver's
    # garbage collector finds that, which it may otherwise do only much later; it takes two rounds
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.1)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder when the application ends."""
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """The folders of all tables that `written` makes meanwhile go to paths."""
    before = _LISTENING.set(paths)
    try:
        yield
    finally:
        _LISTENING.reset(before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete these folders and empty the list. Only results that are built on them break."""
    for path in paths:
        fs, p = _folder(spark, path)
        fs.delete(p, True)
    paths.clear()


def tidy() -> None:
    """Give memory that a finished task has let go back to the system: the worker process lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """df through a function of Arrow record batches; make() runs once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        tidy()

    return df.mapInArrow(run, schema)


def id_crc(col: str = "doc_id"):
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
