"""Experiences: what an analysis found, kept by platform for later retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.functions.text import clean, entity, quote, short_summary
from kilnlog.operators.export import severity_rank
from kilnlog.operators.templates import FORMAT, compact_template
from kilnlog.sources.logs import exists

FINDINGS, TEMPLATES, SNIPPETS = 10, 5, 3


def findings(spans: DataFrame, limit: int = FINDINGS) -> DataFrame:
    """The worst anomalies, by severity, then cycle, then place; spans as export.exploded gives them."""
    return spans.select("cycle_id", "rule_id", "rule_name", "severity", "line_number", "message", "place").orderBy(severity_rank(F.col("severity")), F.coalesce("cycle_id", F.lit(0)), "place").limit(limit)


def highest(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.min_by("severity", severity_rank(F.col("severity"))), F.lit("info")).alias("highest_severity"))


def snippets(spans: DataFrame, limit: int = SNIPPETS) -> DataFrame:
    """(place, snippet): the first contexts that aren't empty."""
    text = F.btrim(F.array_join(F.filter(F.array("before", "after"), lambda x: x != ""), "\n"), F.lit(" \t\n\r\x0b\x0c"))
    return spans.select("place", text.alias("snippet")).where("snippet <> ''").orderBy("place").limit(limit)


def evidence(templates: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, place, text) of the top templates and the first snippets."""
    best = templates.orderBy(F.desc("count"), "template_id").limit(TEMPLATES).select(F.lit("template").alias("kind"), F.col("template_id").alias("place"), F.col("template").alias("text"))
    return best.unionByName(snippets(spans).select(F.lit("snippet").alias("kind"), "place", F.col("snippet").alias("text")))


def experience(spark: SparkSession, *, platform: str, device: str, spans: DataFrame, templates: DataFrame, analysis: str, source: dict | None = None, created: str = "", top: int = 5) -> DataFrame:
    """One row with the experience and its id, a digest of platform, source and findings."""
    found = findings(spans)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_rank", "cycle_id", "place", "rule_id", "severity", "line_number", "message"))), lambda x: F.struct(*(x[c].alias(c) for c in ("cycle_id", "rule_id", "severity", "line_number", "message"))))
    listed = found.withColumn("_rank", severity_rank(F.col("severity"))).agg(rows.alias("findings"))
    stats = spans.agg(F.count(F.lit(1)).alias("total_anomalies"), F.sort_array(F.collect_set("cycle_id")).alias("affected_cycles"))
    best = templates.orderBy(F.desc("count"), "template_id").limit(TEMPLATES).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "template_id", "template"))), lambda x: x["template"]).alias("top_templates"))
    cuts = snippets(spans).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "snippet"))), lambda x: x["snippet"]).alias("log_snippets"))
    one = listed.join(stats).join(highest(found)).join(best).join(cuts)  # one row each
    one = one.select(F.lit(platform).alias("platform"), F.lit(device or "unknown").alias("device_model"), F.lit(created).alias("created_at"), F.to_json(F.create_map(*(F.lit(str(x)) for kv in sorted((source or {"path": ""}).items()) for x in kv))).alias("source_log"), short_summary(F.lit(analysis)).alias("short_summary"), "*")
    one = one.withColumn("experience_id", F.concat_ws("-", "platform", F.substring(F.sha2(F.to_json(F.struct("findings", "platform", "source_log"), {"ignoreNullFields": "false"}), 256), 1, 16)))
    return one.withColumn("compact", compact(top))


def compact(top: int = 5):
    """The compact text of a row of experience()."""
    v = lambda c: clean(F.coalesce(c.cast("string"), F.lit("?")))
    cycles = F.coalesce(F.nullif(F.array_join(F.transform("affected_cycles", lambda c: c.cast("string")), ","), F.lit("")), F.lit("-"))
    head = F.concat(F.lit(f"EXP|fmt={FORMAT}|plat="), "platform", F.lit("|model="), clean(F.col("device_model")), F.lit("|anom="), F.col("total_anomalies").cast("string"), F.lit("|sev="), "highest_severity", F.lit("|cycles="), cycles)

    def finding(f):
        rule, message = v(f["rule_id"]), v(f["message"])
        return F.concat(F.lit("F|"), entity(F.concat_ws(" ", rule, message)), F.lit("|sev="), v(f["severity"]), F.lit("|rule="), rule, F.lit("|cycle="), v(f["cycle_id"]), F.lit("|line="), v(f["line_number"]), F.lit('|"'), quote(message), F.lit('"'))

    own = F.transform(F.slice("findings", 1, top), finding)
    best = F.transform(F.filter(F.slice("top_templates", 1, top), lambda t: F.trim(t) != ""), lambda t: compact_template(t))
    rca = F.when(F.trim("short_summary") != "", F.array(F.concat(F.lit("RCA|"), entity(F.col("short_summary")), F.lit('|"'), quote(F.col("short_summary")), F.lit('"')))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), own, best, rca), "\n")


def markdown():
    """The Markdown text of a row of experience()."""
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(rows, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    found = F.transform("findings", lambda f: F.concat(F.lit("- Cycle "), F.coalesce(f["cycle_id"].cast("string"), F.lit("?")), F.lit(" / "), f["rule_id"], F.lit(" / "), f["severity"], F.lit(": "), f["message"]))
    head = F.concat(F.lit("# Platform Experience: "), "platform", F.lit("\n\n- Experience ID: `"), "experience_id", F.lit("`\n- Device Model: "), "device_model", F.lit("\n- Total anomalies: "), F.col("total_anomalies").cast("string"), F.lit("\n- Highest severity: "), "highest_severity", F.lit("\n\n## Summary\n\n"), "short_summary", F.lit("\n"))
    return F.concat(head, part("Findings", found), part("Top Templates", F.transform("top_templates", lambda t: F.concat(F.lit("- "), t))), part("Evidence", F.transform("log_snippets", lambda t: F.concat(F.lit("```text\n"), t, F.lit("\n```")))))


def write(spark: SparkSession, root: str, rows: DataFrame) -> bool:
    """Append the experiences that root doesn't have yet, by platform; whether there was any."""
    table = f"{root}/experiences"
    full = rows.withColumn("markdown", markdown())
    if exists(spark, table):
        full = full.join(spark.read.parquet(table).select("experience_id"), "experience_id", "left_anti")
    if full.isEmpty():
        return False
    full.write.mode("append").partitionBy("platform").parquet(table)
    return True


def documents(spark: SparkSession, root: str, platform: str, prefer_compact: bool = False) -> DataFrame:
    """(source, text) of a platform's experiences, in the order of ids; the compact form where there is one and it is preferred."""
    rows = spark.read.parquet(f"{root}/experiences").where(F.col("platform") == platform)
    text = F.coalesce(F.nullif("compact", F.lit("")), "markdown") if prefer_compact else F.col("markdown")
    return rows.select(F.col("experience_id").alias("source"), text.alias("text")).orderBy("source")
