"""Milestones, baselines and the three kinds of anomaly rules.

All rules and milestones are looked for in one pass over the lines: each line makes an array of what it hits, which
is exploded.  No line meets a rule table in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnlog.functions.lines import matches, seconds
from kilnlog.profiles import BASE_RULES, Milestone, Rule

KEY = ["file", "cycle_id"]


def _hits(raw: Column, items: Sequence[tuple[int, Column]]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(i)) for i, test in items)), lambda x: x.isNotNull())


def milestone_hits(lines: DataFrame, milestones: Sequence[Milestone]) -> DataFrame:
    """(file, cycle_id, milestone, place, line_number, ts, line_content): each milestone's first line in each cycle.

    place orders the milestones by their expected order, then by their place in the list.  lines need line_in_cycle and ts.
    """
    ranked = sorted(range(len(milestones)), key=lambda i: (milestones[i].order, i))
    place = {i: n for n, i in enumerate(ranked)}
    raw = F.col("raw")
    hit = lines.select(*KEY, "line_in_cycle", "ts", "raw", F.explode(_hits(raw, [(i, matches(raw, m.pattern, m.is_regex)) for i, m in enumerate(milestones)])).alias("_i"))
    first = hit.groupBy(*KEY, "_i").agg(F.min(F.struct("line_in_cycle", "ts", "raw")).alias("_f"))
    names = F.array(*(F.lit(m.name) for m in milestones))
    places = F.array(*(F.lit(place[i]) for i in range(len(milestones))))
    return first.select(*KEY, F.element_at(names, F.col("_i") + 1).alias("milestone"), F.element_at(places, F.col("_i") + 1).alias("place"), F.col("_f.line_in_cycle").alias("line_number"), F.col("_f.ts").alias("ts"), F.col("_f.raw").alias("line_content"))


def milestone_deltas(hits: DataFrame) -> DataFrame:
    """(file, cycle_id, pair, seconds) between neighbouring milestones of those present; none where a time is missing."""
    w = Window.partitionBy(*KEY).orderBy("place")
    paired = hits.withColumns({"_name": F.lag("milestone").over(w), "_ts": F.lag("ts").over(w)})
    return paired.where(F.col("_ts").isNotNull() & F.col("ts").isNotNull()).select(*KEY, F.concat("_name", F.lit("->"), "milestone").alias("pair"), seconds(F.col("ts"), F.col("_ts")).alias("seconds"))


def missing_milestones(cycles: DataFrame, hits: DataFrame, milestones: Sequence[Milestone]) -> DataFrame:
    """(file, cycle_id, milestone) for each milestone that a cycle lacks."""
    return _missing(cycles, hits, [m.name for m in milestones]).select(*KEY, F.explode("missing").alias("milestone"))


def _missing(cycles: DataFrame, hits: DataFrame, names: Sequence[str]) -> DataFrame:
    got = hits.groupBy(*KEY).agg(F.collect_set("milestone").alias("_got"))  # as many as there are milestones at most
    wanted = F.array(*(F.lit(n) for n in names)).cast("array<string>")
    return cycles.select(*KEY).join(got, KEY, "left").select(*KEY, F.array_except(wanted, F.coalesce("_got", F.array().cast("array<string>"))).alias("missing"))


def train_baseline(deltas: DataFrame, cycles: DataFrame) -> DataFrame:
    """(pair, mean, stddev, sample_count); sample_count is the number of cycles, with or without the pair."""
    n = cycles.agg(F.count(F.lit(1)).alias("sample_count"))
    return deltas.groupBy("pair").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("stddev")).join(F.broadcast(n))  # one row


def anomaly_id(*parts: str) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8)


_COLUMNS = ["file", "cycle_id", "rule_id", "rule_name", "severity", "rule_type", "timestamp", "line_number", "message", "metadata", "phase", "rule_pos"]
_METADATA = "struct<actual:double,mean:double,stddev:double,threshold:double,sigma:double,missing:array<string>>"


def pattern_anomalies(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row for each line and pattern rule that match; lines need line_in_cycle and ts."""
    rules = [(i, r) for i, r in enumerate(rules or BASE_RULES) if r.kind == "pattern"]
    raw = F.col("raw")
    table = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(r.rule_id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("sev")) for i, r in rules))
    hit = lines.select(*KEY, "line_in_cycle", "ts", "raw", F.explode(_hits(raw, [(n, matches(raw, r.pattern, r.is_regex)) for n, (_, r) in enumerate(rules)])).alias("_n")).withColumn("_r", F.element_at(table, F.col("_n") + 1))
    return hit.select(*KEY, F.col("_r.id").alias("rule_id"), F.col("_r.name").alias("rule_name"), F.col("_r.sev").alias("severity"), F.lit("pattern").alias("rule_type"), F.col("ts").alias("timestamp"), F.col("line_in_cycle").alias("line_number"), F.col("raw").alias("message"), F.lit(None).cast(_METADATA).alias("metadata"), F.lit(0).alias("phase"), F.col("_r.pos").alias("rule_pos"))


SIGMA = 3.0


def timeout_anomalies(deltas: DataFrame, baseline: DataFrame, rules: Sequence[Rule], sigma: float = SIGMA) -> DataFrame:
    """Cycles in which a rule's pair took longer than its mean and sigma deviations, the rule's own or else those given."""
    rules = [(i, r) for i, r in enumerate(rules) if r.kind == "timeout" and r.pair]
    if not rules:
        return _none(deltas)
    table = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(r.rule_id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("sev"), F.lit(r.pair).alias("pair"), F.lit(float(sigma if r.sigma is None else r.sigma)).alias("sigma")) for i, r in rules))
    base = baseline.select(F.col("pair").alias("_pair"), "mean", F.coalesce("stddev", F.lit(0.0)).alias("stddev"))
    own = deltas.where(F.col("pair").isin(*{r.pair for _, r in rules})).join(base, F.col("pair") == F.col("_pair"))
    own = own.withColumn("_r", F.explode(F.filter(table, lambda r: r["pair"] == F.col("pair")))).withColumn("threshold", F.col("mean") + F.col("_r.sigma") * F.col("stddev")).where("seconds > threshold")
    message = F.format_string("%s took %.3fs (threshold %.3fs = mean %.3fs + %ss x %.3fs)", "pair", "seconds", "threshold", "mean", F.col("_r.sigma").cast("string"), "stddev")
    meta = F.struct(F.col("seconds").alias("actual"), "mean", "stddev", "threshold", F.col("_r.sigma").alias("sigma"), F.lit(None).cast("array<string>").alias("missing"))
    return own.select(*KEY, F.col("_r.id").alias("rule_id"), F.col("_r.name").alias("rule_name"), F.col("_r.sev").alias("severity"), F.lit("timeout").alias("rule_type"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(0).cast("long").alias("line_number"), message.alias("message"), meta.alias("metadata"), F.lit(1).alias("phase"), F.col("_r.pos").alias("rule_pos"))


def sequence_anomalies(cycles: DataFrame, hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Cycles that lack a milestone which a rule requires."""
    rules = [(i, r) for i, r in enumerate(rules) if r.kind == "sequence" and r.required]
    if not rules:
        return _none(cycles)
    got = hits.groupBy(*KEY).agg(F.collect_set("milestone").alias("_got"))
    table = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(r.rule_id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("sev"), F.array(*(F.lit(m) for m in r.required)).alias("required")) for i, r in rules))
    own = cycles.select(*KEY).join(got, KEY, "left").withColumn("_r", F.explode(table)).withColumn("missing", F.array_except("_r.required", F.coalesce("_got", F.array().cast("array<string>")))).where(F.size("missing") > 0)
    none = F.lit(None).cast("double")
    meta = F.struct(none.alias("actual"), none.alias("mean"), none.alias("stddev"), none.alias("threshold"), none.alias("sigma"), "missing")
    return own.select(*KEY, F.col("_r.id").alias("rule_id"), F.col("_r.name").alias("rule_name"), F.col("_r.sev").alias("severity"), F.lit("sequence").alias("rule_type"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(0).cast("long").alias("line_number"), F.concat(F.lit("Missing milestones: "), F.array_join("missing", ", ")).alias("message"), meta.alias("metadata"), F.lit(2).alias("phase"), F.col("_r.pos").alias("rule_pos"))


def _none(df: DataFrame) -> DataFrame:
    kinds = ["string", "long", "string", "string", "string", "string", "timestamp_ntz", "long", "string", _METADATA, "int", "int"]
    return df.sparkSession.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS, kinds, strict=True)))


def detect(lines: DataFrame, rules: Sequence[Rule] = (), *, cycles: DataFrame | None = None, hits: DataFrame | None = None, deltas: DataFrame | None = None, baseline: DataFrame | None = None, sigma: float = SIGMA) -> DataFrame:
    """All anomalies with their ids; order inside a cycle is (phase, line_number, rule_pos)."""
    rules = tuple(rules) or BASE_RULES
    out = pattern_anomalies(lines, rules)
    if baseline is not None and deltas is not None:
        out = out.unionByName(timeout_anomalies(deltas, baseline, rules, sigma))
    if cycles is not None and hits is not None:
        out = out.unionByName(sequence_anomalies(cycles, hits, rules))
    return out.withColumn("anomaly_id", anomaly_id("file", "cycle_id", "rule_id", "line_number"))


def with_context(anomalies: DataFrame, lines: DataFrame, before: int = 50, after: int = 50) -> DataFrame:
    """anomalies with context_before and context_after, the lines around in the same cycle; empty for rules that name no line.

    Only lines near a hit are gathered: a hit asks for the line numbers around it, and these meet the lines in an equi join.
    """
    asked = anomalies.where("phase = 0").select(*KEY, F.col("line_number").alias("_hit")).distinct()
    asked = asked.select(*KEY, "_hit", F.explode(F.sequence(F.greatest(F.col("_hit") - before, F.lit(0)), F.col("_hit") + after)).alias("line_in_cycle")).where("line_in_cycle <> _hit")
    near = asked.join(lines.select(*KEY, "line_in_cycle", "raw"), [*KEY, "line_in_cycle"])
    side = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("line_in_cycle", "raw")))), lambda x: x["raw"])
    gathered = near.groupBy(*KEY, "_hit").agg(side(F.col("line_in_cycle") < F.col("_hit")).alias("context_before"), side(F.col("line_in_cycle") > F.col("_hit")).alias("context_after"))
    none = F.array().cast("array<string>")
    joined = anomalies.withColumn("_hit", F.when(F.col("phase") == 0, F.col("line_number"))).join(gathered, [*KEY, "_hit"], "left").drop("_hit")
    return joined.withColumns({"context_before": F.coalesce("context_before", none), "context_after": F.coalesce("context_after", none)})
