"""Trace documents of anomalies, their summaries, and root-cause text."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.functions.lines import epoch_nanos
from kilnlog.operators.detect import KEY
from kilnlog.profiles import Milestone

RANK = {"critical": 0, "warning": 1, "info": 2}
ORDER = ["phase", "line_number", "rule_pos"]


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), severity), F.lit(99))


def severity_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def spans(anomalies: DataFrame) -> DataFrame:
    """A row an anomaly: trace_id, cycle, and the span as a struct; metadata are not part of it."""
    a = lambda n: F.col(n).alias(f"anomaly.{n}")
    context = F.struct(F.array_join("context_before", "\n").alias("log.context_before"), F.array_join("context_after", "\n").alias("log.context_after"))
    span = F.struct(
        F.substring(F.md5(F.col("anomaly_id").cast("binary")), 1, 16).alias("spanId"), F.concat(F.lit("anomaly."), "rule_id").alias("name"), epoch_nanos(F.col("timestamp")).alias("startTimeUnixNano"),
        F.struct(a("severity"), a("rule_id"), a("rule_name"), a("rule_type"), a("cycle_id"), a("line_number"), a("message")).alias("attributes"),
        F.array(F.struct(F.lit("context").alias("name"), context.alias("attributes"))).alias("events"),
    )
    return anomalies.select(*KEY, F.md5(F.concat(F.lit("cycle_"), F.col("cycle_id")).cast("binary")).alias("traceId"), *ORDER, span.alias("span"))


def traces(anomalies: DataFrame) -> DataFrame:
    """(file, traceId, cycle_id, spans): a row a cycle with anomalies, its spans in the order of detection."""
    return spans(anomalies).groupBy(*KEY, "traceId").agg(F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "span"))), lambda x: x["span"]).alias("spans")).select("file", "traceId", "cycle_id", "spans")


def summary(anomalies: DataFrame) -> DataFrame:
    """(file, total_anomalies, by_severity, affected_cycles) of each log."""
    by = anomalies.groupBy("file", "severity").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("by_severity"), F.sum("n").alias("total_anomalies"))
    cycles = anomalies.select(*KEY).distinct().groupBy("file").agg(F.sort_array(F.collect_list("cycle_id")).alias("affected_cycles"))
    return by.join(cycles, "file").select("file", "total_anomalies", "by_severity", "affected_cycles")


def documents(anomalies: DataFrame, *, service: str = "kilnlog", device: str = "unknown") -> DataFrame:
    """(file, document): each log's document as JSON with its nulls."""
    resource = F.struct(F.lit(service).alias("service.name"), F.lit(device).alias("device.model"))
    each = traces(anomalies).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("cycle_id", "traceId", "spans"))), lambda t: F.struct(t["traceId"].alias("traceId"), t["cycle_id"].alias("cycle_id"), t["spans"].alias("spans"))).alias("traces"))
    joined = each.join(summary(anomalies), "file")
    doc = F.struct(resource.alias("resource"), F.struct("total_anomalies", "by_severity", "affected_cycles").alias("summary"), "traces")
    return joined.select("file", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


_SPAN = "struct<spanId:string,name:string,startTimeUnixNano:bigint,attributes:struct<`anomaly.severity`:string,`anomaly.rule_id`:string,`anomaly.rule_name`:string,`anomaly.rule_type`:string,`anomaly.cycle_id`:bigint,`anomaly.line_number`:bigint,`anomaly.message`:string>,events:array<struct<name:string,attributes:struct<`log.context_before`:string,`log.context_after`:string>>>>"
DOCUMENT = f"struct<resource:struct<`service.name`:string,`device.model`:string>,summary:struct<total_anomalies:bigint,by_severity:map<string,bigint>,affected_cycles:array<bigint>>,traces:array<struct<traceId:string,cycle_id:bigint,spans:array<{_SPAN}>>>>"


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("document").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(document): the JSON of each document."""
    return spark.read.text(path).select(F.col("value").alias("document"))


def parsed(docs: DataFrame) -> DataFrame:
    """A row a document, with a fixed schema."""
    return docs.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parsed(read_json(spark, path))


def exploded(docs: DataFrame) -> DataFrame:
    """(cycle_id, place, rule_id, rule_name, severity, line_number, message, before, after) of every span of documents."""
    t = docs.select(F.posexplode("traces").alias("_t", "t")).select("_t", "t.cycle_id", F.posexplode("t.spans").alias("_s", "s"))
    at = lambda n: F.col("s.attributes").getField(f"anomaly.{n}")
    ctx = lambda n: F.element_at("s.events", 1)["attributes"].getField(f"log.context_{n}")
    return t.select("cycle_id", (F.shiftleft(F.col("_t").cast("long"), 32) + F.col("_s")).alias("place"), at("rule_id").alias("rule_id"), at("rule_name").alias("rule_name"), at("severity").alias("severity"), at("line_number").alias("line_number"), at("message").alias("message"), ctx("before").alias("before"), ctx("after").alias("after"), F.col("s.startTimeUnixNano").alias("nanos"))


def cycle_summary(anomalies: DataFrame) -> DataFrame:
    """(file, cycle_id, anomalies, highest): the highest severity is the one of least rank."""
    return anomalies.groupBy(*KEY).agg(F.count(F.lit(1)).alias("anomalies"), F.min_by("severity", severity_rank(F.col("severity"))).alias("highest"))


def cycle_report(document: dict, cycle_id: int) -> str:
    """Root-cause text of one cycle of one document."""
    found = next((t["spans"] for t in document.get("traces", []) if t.get("cycle_id") == cycle_id), [])
    if not found:
        return f"## Cycle {cycle_id}\n\nNo anomalies were found in this cycle.\n"
    highest = min((s["attributes"].get("anomaly.severity", "info") for s in found), key=lambda s: RANK.get(s, 99))
    out = [f"## Cycle {cycle_id}", "", f"Severity: {highest.capitalize()}", f"Anomalies: {len(found)}", ""]
    for s in found:
        a = s["attributes"]
        ctx = next((e["attributes"] for e in s.get("events", []) if e.get("name") == "context"), {})
        out += [f"- **[{a.get('anomaly.severity', 'info')}] {a.get('anomaly.rule_name', '')}** ({a.get('anomaly.rule_id', '')})", f"  - time: {s.get('startTimeUnixNano', 0)}", f"  - line: {a.get('anomaly.line_number', 0)}", f"  - message: {a.get('anomaly.message', '')}"]
        out += [f"  - {side}: {', '.join((ctx.get(f'log.context_{side}') or '').split(chr(10))[:5])}" for side in ("before", "after")]
    return "\n".join([*out, ""])


def summary_report(document: dict, now: datetime) -> str:
    s, counts = document.get("summary", {}), document.get("summary", {}).get("by_severity", {})
    out = ["# Root cause summary", "", f"Device: {document.get('resource', {}).get('device.model', 'unknown')}", f"Time: {now:%Y-%m-%d %H:%M:%S}", f"Anomalies: {s.get('total_anomalies', 0)}", "", *(f"- {k.capitalize()}: {counts.get(k, 0)}" for k in RANK), ""]
    cycles = [t["cycle_id"] for t in document.get("traces", []) if "cycle_id" in t]
    return "\n".join([*out, *(cycle_report(document, c) for c in cycles)] if cycles else [*out, "No anomalies were found.", ""])


def milestones(saved: DataFrame) -> tuple[Milestone, ...]:
    """Saved milestones, in their order; a baseline has as many as it was trained with."""
    return tuple(Milestone(r["name"], r["pattern"], r["order"], r["is_regex"]) for r in saved.orderBy("order").collect())


def write_baseline(baseline: DataFrame, milestones: DataFrame, path: str) -> None:
    """One JSON object: milestones, mean_deltas, stddev_deltas, sample_count.  As many pairs as milestones can make."""
    if baseline.isEmpty():
        raise RuntimeError("the baseline has no pairs; train it first")
    pairs = baseline.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pair", "mean")))).alias("mean_deltas"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("pair", "stddev")))).alias("stddev_deltas"), F.max("sample_count").alias("sample_count"))
    named = milestones.groupBy().agg(F.sort_array(F.collect_list(F.struct("order", "name", "pattern", "is_regex"))).alias("milestones"))
    named.join(pairs).coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pair, mean, stddev, sample_count) and the milestones that it was trained with."""
    doc = spark.read.schema("milestones array<struct<order:int,name:string,pattern:string,is_regex:boolean>>, mean_deltas map<string,double>, stddev_deltas map<string,double>, sample_count long").json(path)
    pairs = doc.select(F.explode("mean_deltas").alias("pair", "mean"), "stddev_deltas", "sample_count").select("pair", "mean", F.coalesce(F.col("stddev_deltas")[F.col("pair")], F.lit(0.0)).alias("stddev"), "sample_count")
    return pairs, doc.select(F.inline("milestones"))


def as_dict(docs: DataFrame) -> dict:
    """The document of one log, on the driver; an empty one if there is none."""
    row = docs.select("document").first()
    return json.loads(row[0]) if row else {"resource": {}, "summary": {}, "traces": []}
