"""Boot cycles: a line with an anchor opens a new cycle of its file; what stands before the first is cycle 0."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnlog.functions.lines import has_any, timestamp
from kilnlog.profiles import TIMESTAMP
from kilnlog.sources.logs import prefix_sum

BLOCK = 1 << 20  # lines of a file that one window may span


def anchor(raw: Column, anchors: Iterable[str]) -> Column:
    return has_any(raw, anchors)


def with_anchor(lines: DataFrame, anchors: Iterable[str], fallback: Iterable[str] = ()) -> DataFrame:
    """lines with is_anchor; the fallback anchors serve the files that have no line with an anchor."""
    main = has_any(F.col("raw"), anchors)
    if not (fallback := list(fallback)):
        return lines.withColumn("is_anchor", main)
    has = lines.groupBy("file").agg(F.max(main).alias("_has"))
    return lines.join(has, "file").withColumn("is_anchor", F.when(F.col("_has"), main).otherwise(has_any(F.col("raw"), fallback))).drop("_has")


def with_cycle(lines: DataFrame, anchors: Iterable[str], *, fallback: Iterable[str] = (), timestamp_pattern: str | None = TIMESTAMP) -> DataFrame:
    """lines, numbered from 0 in each file, with is_anchor, cycle_id, cycle_start (its first line_no) and ts."""
    marked = with_anchor(lines, anchors, fallback).withColumn("_block", F.floor(F.col("line_no") / BLOCK))
    at = F.when(F.col("is_anchor"), F.col("line_no"))
    out = prefix_sum(marked, F.col("is_anchor").cast("long"), ["file"], "_block", ["line_no"], "cycle_id", latest=(at, "cycle_start"))
    return out.drop("_block").withColumn("cycle_start", F.coalesce("cycle_start", F.lit(0))).withColumn("ts", timestamp(F.col("raw"), timestamp_pattern))


def cycles(numbered: DataFrame, *, files: DataFrame | None = None, max_cycle_lines: int = 100_000) -> DataFrame:
    """(file, cycle_id, start_line, end_line, anchor_line, ts_start, ts_end, line_count, truncated); cycle 0 of a file even when it is empty.

    Times are the first and the last in line order.  files lists the files, empty ones too; else those with lines.
    """
    timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    found = numbered.groupBy("file", "cycle_id").agg(
        F.min("line_no").alias("start_line"), (F.max("line_no") + 1).alias("end_line"), F.count(F.lit(1)).alias("line_count"),
        F.max(F.when(F.col("is_anchor"), F.col("raw"))).alias("anchor_line"), F.min_by("ts", timed).alias("ts_start"), F.max_by("ts", timed).alias("ts_end"),
    )
    # a file that begins with an anchor has an empty cycle 0, which its cycle 1 brings along
    opens = (F.col("cycle_id") == 1) & (F.col("start_line") == 0)
    ids = F.when(opens, F.array(F.lit(0).cast("long"), F.col("cycle_id"))).otherwise(F.array("cycle_id"))
    own = found.withColumn("_id", F.explode(ids))
    real = F.col("_id") == F.col("cycle_id")
    times = [F.when(real, F.col(c)).alias(c) for c in ("anchor_line", "ts_start", "ts_end")]
    counts = [F.when(real, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("start_line", "end_line", "line_count")]
    both = own.select("file", F.col("_id").alias("cycle_id"), *times, *counts)
    if files is not None:
        bare = files.select("file").distinct().join(both.select("file").distinct(), "file", "left_anti")
        empty = {"cycle_id": F.lit(0).cast("long"), **{c: F.lit(None) for c in ("anchor_line", "ts_start", "ts_end")}, **{c: F.lit(0) for c in ("start_line", "end_line", "line_count")}}
        both = both.unionByName(bare.select("file", *(v.cast(both.schema[c].dataType).alias(c) for c, v in empty.items())))
    return both.select("file", "cycle_id", "start_line", "end_line", F.coalesce("anchor_line", F.lit("")).alias("anchor_line"), "ts_start", "ts_end", "line_count", (F.col("line_count") > max_cycle_lines).alias("truncated"))


def in_cycle(numbered: DataFrame) -> DataFrame:
    """numbered with line_in_cycle, from 0."""
    return numbered.withColumn("line_in_cycle", F.col("line_no") - F.col("cycle_start")).drop("cycle_start")


def cycle_lines(numbered: DataFrame, cycle_id: int) -> DataFrame:
    return numbered.where(F.col("cycle_id") == cycle_id)
