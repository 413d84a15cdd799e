"""Helpers shared by the training-data operators: tables, scratch space, size checks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its bound on a row's bytes stay below this.
BROADCAST_BYTES = 32 << 20

_local: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows to and from Python, unless the session sets its own number: a row here is a whole document."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local tests) one temporary folder of the machine serves; on a
    cluster that would not be shared, so it is refused there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="kilnlog-"))
        root = _local[0]
    return f"{root.rstrip('/')}/kilnlog-{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str, *, outlive: bool = False) -> str:
    """A path for a scratch table; it belongs to the innermost scope, or with outlive to the one around that."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > outlive:
        _scopes[-1 - outlive].append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Collect garbage in Python and the JVM: Spark drops the shuffle files and broadcasts of plans that are gone only then."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Scratch tables written inside go at the end, but for those that outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)
        release(spark)


def materialise(spark: SparkSession, df: DataFrame, name: str, *, outlive: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    small_batches(spark)
    path = new_path(spark, name, outlive=outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(spark: SparkSession, df: DataFrame, by: str, n: int, name: str):
    """df as a scratch table in n buckets of the column by: written without a shuffle, and a grouping by it leaves the rows in place."""
    small_batches(spark)
    at = f"kilnlog_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("path", new_path(spark, name)).saveAsTable(at)
    try:
        yield spark.table(at)
    finally:
        spark.sql(f"drop table {at}")


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The caller's columns as _c0, _c1 and so on, so that their names cannot meet the ones used here, and columns, which are of docs."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)), *(c.alias(k) for k, c in columns.items()))


def restored(df: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns of docs under their own names, with columns in the place of those of their name or behind them."""
    own = [columns[c].alias(c) if c in columns else F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return df.select(*own, *(c.alias(k) for k, c in columns.items() if k not in docs.columns))


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows of row_bytes at most fit the limit; df must be cheap to count."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df


def tidy(part):
    """part, a function from batches to batches, that gives its worker's freed memory back when it ends; workers live on."""

    @functools.wraps(part)
    def run(batches):
        try:
            yield from part(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables."""
    drop(spark, shared_dir(spark))


def _drop_local() -> None:
    import shutil

    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_drop_local)
