"""Which platform a log is of: the number of a profile's marks that its first lines hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def platform_scores(lines: DataFrame, marks: Sequence[tuple[str, Sequence[str]]], *, scan_lines: int = 2000) -> DataFrame:
    """(file, place, platform, score) from the first lines of each file, in one pass."""
    raw = F.col("raw")
    present = lines.where(F.col("line_no") < scan_lines).groupBy("file").agg(*(sum((F.max(raw.contains(p)).cast("int") for p in ps), F.lit(0)).alias(f"_{i}") for i, (_, ps) in enumerate(marks)))
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("platform"), F.col(f"_{i}").alias("score")) for i, (n, _) in enumerate(marks)))
    return present.select("file", F.inline(each))


def detect_platform(lines: DataFrame, marks: Sequence[tuple[str, Sequence[str]]], *, default: str, scan_lines: int = 2000) -> DataFrame:
    """(file, platform, score): the highest score, the first listed among equals, the default at 0."""
    w = Window.partitionBy("file").orderBy(F.desc("score"), "place")
    best = platform_scores(lines, marks, scan_lines=scan_lines).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("file", F.when(F.col("score") > 0, F.col("platform")).otherwise(default).alias("platform"), "score")
