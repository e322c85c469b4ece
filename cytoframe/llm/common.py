"""Shared helpers of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII space or control white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders made for sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a session with a local master, as in tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="cytoframe-"))


def folder(spark: SparkSession, path: str):
    """A path of Hadoop and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation.

    ``files`` bounds the number of files, and of the tasks that write them, for tables of a few short columns. The folder goes when the table is discarded, or else when the
    driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    target, system = folder(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for table in tables:
        target, system = folder(table.sparkSession, table._settled)
        system.delete(target, True)


def spare() -> None:
    """Give freed memory of a Python worker, which waits for further tasks, back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sparing(run):
    """A function over the batches of a partition that spares memory at the end of the partition."""

    def spared(batches):
        try:
            yield from run(batches)
        finally:
            spare()

    return spared


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
