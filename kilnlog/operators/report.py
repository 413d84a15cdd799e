"""Boot timing: when each process first appears, totals of cycles, and statistics over the valid ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnlog.functions.lines import seconds
from kilnlog.operators.detect import KEY


def first_lines(lines: DataFrame, processes: Sequence[tuple[str, str]]) -> DataFrame:
    """(file, cycle_id, process, line_offset, ts): the first line of each cycle that holds a process's mark."""
    raw = F.col("raw")
    hit = F.filter(F.array(*(F.when(raw.contains(p), F.lit(n)) for n, p in processes)), lambda x: x.isNotNull())
    return lines.select(*KEY, "line_in_cycle", "ts", F.explode(hit).alias("process")).groupBy(*KEY, "process").agg(F.min(F.struct("line_in_cycle", "ts")).alias("_f")).select(*KEY, "process", F.col("_f.line_in_cycle").alias("line_offset"), F.col("_f.ts").alias("ts"))


def process_offsets(first: DataFrame, cycles: DataFrame) -> DataFrame:
    """(file, cycle_id, process, offset) in seconds from the cycle's first time; none where the first line has no time."""
    return first.where("ts is not null").join(cycles.select(*KEY, "ts_start"), KEY).where("ts_start is not null").select(*KEY, "process", seconds(F.col("ts"), F.col("ts_start")).alias("offset"))


def process_line_offsets(first: DataFrame, cycles: DataFrame, *, has_time: bool = False) -> DataFrame:
    """(file, cycle_id, process, line_offset): of all cycles, or of those without a time if the platform has time."""
    if has_time:
        first = first.join(cycles.where("ts_start is null").select(*KEY), KEY, "left_semi")
    return first.select(*KEY, "process", "line_offset")


def cycle_totals(cycles: DataFrame, offsets: DataFrame) -> DataFrame:
    """(file, cycle_id, total_seconds, total_lines): the largest offset, else from the first to the last time, else 0."""
    most = offsets.groupBy(*KEY).agg(F.max("offset").alias("_most"))
    total = F.coalesce("_most", seconds(F.col("ts_end"), F.col("ts_start")), F.lit(0.0))
    return cycles.join(most, KEY, "left").select(*KEY, total.alias("total_seconds"), F.col("line_count").alias("total_lines"))


def valid_cycles(totals: DataFrame, *, skip: int = 2, has_time: bool = True) -> DataFrame:
    """totals without the first skip cycles of each file and without empty ones."""
    # cycles are numbered from 0 without gaps, so the place of a cycle is its number
    return totals.where(F.col("cycle_id") >= skip).where("total_seconds > 0" if has_time else "total_lines > 0")


def boot_time_summary(totals: DataFrame, valid: DataFrame) -> DataFrame:
    stats = valid.agg(F.count(F.lit(1)).alias("valid_cycles"), *(F.coalesce(f("total_seconds"), F.lit(0.0)).alias(n) for n, f in (("mean", F.avg), ("stddev", F.stddev_pop), ("min", F.min), ("max", F.max))))
    return totals.agg(F.count(F.lit(1)).alias("total_cycles")).join(stats)  # one row each


def process_stats(offsets: DataFrame, valid: DataFrame, processes: Sequence[tuple[str, str]], value: str = "offset") -> DataFrame:
    """(place, process, mean, stddev, min, max, hit_count, total_cycles, hit_percent) of every process, in the order of the list."""
    spark = offsets.sparkSession
    own = offsets.join(valid.select(*KEY), KEY, "left_semi").withColumn("_v", F.col(value).cast("double"))
    stats = own.groupBy("process").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("stddev"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.count(F.lit(1)).alias("hit_count"))
    names = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(processes)], "place int, process string, pattern string")
    total = valid.agg(F.count(F.lit(1)).alias("total_cycles"))
    out = names.join(stats, "process", "left").join(total)  # one row
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    hits = F.coalesce("hit_count", F.lit(0))
    return out.select("place", "process", "pattern", zero("mean"), zero("stddev"), zero("min"), zero("max"), hits.alias("hit_count"), "total_cycles", F.when(F.col("total_cycles") > 0, hits * 100.0 / F.col("total_cycles")).otherwise(0.0).alias("hit_percent"))


def timing_pivot(totals: DataFrame, offsets: DataFrame, processes: Sequence[tuple[str, str]], *, first: int = 6, value: str = "offset") -> DataFrame:
    """A row a cycle with its total and the first processes' offsets, null where absent."""
    names = [n for n, _ in processes[:first]]
    wide = offsets.where(F.col("process").isin(*names)).groupBy(*KEY).pivot("process", names).agg(F.first(value))
    return totals.join(wide, KEY, "left")


def to_markdown(summary: DataFrame, stats: DataFrame, pivot: DataFrame, *, device: str = "unknown", platform: str = "unknown", has_time: bool = True, untimed: DataFrame | None = None) -> str:
    """The report's text; the cycle table is as long as the log has cycles and meant for single logs."""
    unit, fmt = ("s", "{:.3f}") if has_time else (" lines", "{:.0f}")
    show = lambda v: "N/A" if v is None else fmt.format(v) + unit
    s = summary.first()
    out = ["# Boot Timing Report", "", f"Device: {device}", f"Platform: {platform}", f"Cycles: {s['total_cycles']} ({s['valid_cycles']} valid)", ""]
    if has_time:
        out += ["## Boot time", "", "| | |", "|-|-|", *(f"| {k} | {s[k]:.3f}s |" for k in ("mean", "stddev", "min", "max")), ""]
    out += ["## Processes", "", "| Process | Mean | StdDev | Min | Max | Hit% |", "|-|-|-|-|-|-|"]
    for r in stats.orderBy("place").collect():
        cells = [show(r[k]) for k in ("mean", "stddev", "min", "max")] if r["hit_count"] else ["N/A"] * 4
        out.append(f"| {r['process']} | {' | '.join(cells)} | {r['hit_percent']:.0f}% |")
    names = pivot.columns[4:]
    out += ["", "## Cycles", "", f"| Cycle | Total | {' | '.join(names)} |", "|-" * (len(names) + 2) + "|"]
    for r in pivot.orderBy(*KEY).toLocalIterator():
        total = r["total_seconds"] if has_time else r["total_lines"]
        out.append(f"| {r['cycle_id']} | {show(total)} | {' | '.join(show(r[n]) for n in names)} |")
    rows = untimed.orderBy(*KEY).collect() if untimed is not None else []  # of one log
    if rows:
        out += ["", "## Cycles without a time", "", f"| Cycle | Lines | {' | '.join(names)} |", "|-" * (len(names) + 2) + "|"]
        out += [f"| {r['cycle_id']} | {r['total_lines']} | {' | '.join('N/A' if r[n] is None else f'{r[n]} lines' for n in names)} |" for r in rows]
    return "\n".join([*out, ""])


def running_first_seen(firsts: DataFrame, per: str) -> DataFrame:
    """(per, seen): how many things were first seen up to each value of per."""
    n = firsts.groupBy(per).agg(F.count(F.lit(1)).alias("_n"))
    return n.select(per, F.sum("_n").over(Window.orderBy(per)).alias("seen"))
