"""Logs as tables (file, line_no, raw), from text files or from any table with an order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; of this machine only in local mode, where the setting may be absent."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="kilnlog-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/kilnlog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders of this application; results that were not written elsewhere go with them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "any")).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet, for results that read it several times; lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sum(df: DataFrame, value: Column, file: list[str], coarse: str, order: list[str], name: str, *, latest: tuple[Column, str] | None = None) -> DataFrame:
    """df with name, the running sum of value in each file; no window spans more than a file's rows of one coarse value.

    coarse must not decrease along the order.  Its totals are summed first (one row for a file and coarse value), then rows inside.
    latest, a column and a name, adds the running maximum of the column in the same pass; null before its first value.
    """
    value = F.coalesce(value, F.lit(0))
    best = latest[0] if latest else F.lit(None).cast("long")
    totals = df.groupBy(*file, coarse).agg(F.sum(value).alias("_sum"), F.max(best).alias("_max"))
    blocks = Window.partitionBy(*file).orderBy(coarse)
    before = totals.select(
        *file, coarse,
        (F.sum("_sum").over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
        F.max("_max").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_best"),
    )
    inside = Window.partitionBy(*file, coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(before, [*file, coarse]).withColumn(name, F.col("_before") + F.sum(value).over(inside))
    if latest:
        out = out.withColumn(latest[1], F.greatest("_best", F.max(best).over(inside)))
    return out.drop("_before", "_best")


def from_table(df: DataFrame, *, file: Column, order: list[str], raw: Column, coarse: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(file, line_no, raw, keep...) of any table: file is its stream, order its order in the stream.

    coarse, a column that does not decrease along the order (such as the day), keeps long streams from being one window.
    """
    base = df.select(file.cast("string").alias("file"), *order, raw.alias("raw"), *[c for c in keep or [] if c not in order], *([coarse.alias("_coarse")] if coarse is not None else []))
    if coarse is None:
        base = base.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long") - 1)
    else:
        base = prefix_sum(base, F.lit(1).cast("long"), ["file"], "_coarse", order, "_n").withColumn("line_no", F.col("_n") - 1)
    return base.select("file", "line_no", "raw", *(keep or []))


def from_texts(df: DataFrame, *, file: Column, text: Column) -> DataFrame:
    """(file, line_no, raw) of the lines of a text column; a final line end opens no further line."""
    ended = F.regexp_replace(text, r"(\r\n|\r|\n)\z", "")
    return df.where(F.length(text) > 0).select(file.cast("string").alias("file"), F.posexplode(F.split(ended, r"\r\n|\r|\n", -1)).alias("line_no", "raw")).select("file", F.col("line_no").cast("long"), "raw")


def read_log(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, line_no, raw) of text files; bad bytes become U+FFFD.

    Lines are numbered by two steps: inside each file block, then by the counts of the blocks before it.
    """
    kind = encoding.lower().replace("-", "").replace("_", "")
    if kind.startswith(("utf16", "utf32")):  # line ends are no single bytes there
        whole = spark.read.format("binaryFile").load(path)
        return from_texts(whole, file=F.col("path"), text=F.decode("content", encoding))
    raw = F.make_valid_utf8("value") if kind == "utf8" else F.decode(F.col("value").cast("binary"), encoding)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), raw.alias("raw"))
    counts = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("file", "_block", "_first", (F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).alias("_before"))
    # rows of a block are consecutive in one task, so their ids are too
    return rows.join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "raw")


def head(lines: DataFrame, n: int = 2000) -> DataFrame:
    return lines.where(F.col("line_no") < n)


def ordered_distinct(paths: DataFrame, by: str = "position", key: str = "path") -> DataFrame:
    """Each key once, at its least position: the union of several lists in order."""
    return paths.groupBy(key).agg(F.min(by).alias(by))


def resolve(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The full paths of files, each once, in order; a FileNotFoundError names those that are no files."""
    out, odd = {}, []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(place) and system.getFileStatus(place).isFile():
            out[system.getFileStatus(place).getPath().toString()] = None
        else:
            odd.append(path)
    if odd:
        raise FileNotFoundError(f"no such file: {', '.join(odd)}")
    return list(out)


def fingerprint(spark: SparkSession, path: str) -> dict:
    """Path, size and time of change of a log, of all its files together; empty for one that isn't there."""
    if not exists(spark, path):
        return {"path": "", "size_bytes": 0, "mtime_ms": 0}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getPath().toString()
    files = spark.read.format("binaryFile").load(path).agg(F.sum("length"), F.max(F.unix_millis("modificationTime"))).first()
    return {"path": full, "size_bytes": files[0] or 0, "mtime_ms": files[1] or 0}


def read_documents(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """(source, text, metadata...) of whole files; metadata are found by source, the resolved path, or else by the path as it was given."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    if metadata is None:
        return docs
    more = [c for c in metadata.columns if c != "source"]
    own = metadata.select(F.regexp_replace("source", "^file:/+", "/").alias("_key"), F.struct(*more).alias("_more"))
    found = docs.join(own, F.regexp_replace(docs["source"], "^file:/+", "/") == F.col("_key"), "left").drop("_key")
    given = own.where(F.col("_key") == path).select(F.col("_more").alias("_given"))
    return found.join(F.broadcast(given.limit(1)), F.lit(True), "left").select("source", "text", *(F.coalesce(F.col("_more").getField(c), F.col("_given").getField(c)).alias(c) for c in more))  # one row
