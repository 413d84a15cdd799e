"""The command line: parse, analyze, report, train-baseline, train-templates, rca, agent-analyze, agent-chat."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog import agent as A
from kilnlog import client, profiles
from kilnlog.analysis import Analysis, read
from kilnlog.config import Settings
from kilnlog.functions.tables import text_table
from kilnlog.operators import export as E
from kilnlog.operators import report as R
from kilnlog.operators import templates as M
from kilnlog.sources import logs as S


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kilnlog")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("parse", "analyze", "report", "train-baseline", "train-templates"):
        p = sub.add_parser(name)
        p.add_argument("log")
        p.add_argument("--output")
        p.add_argument("--config")
        p.add_argument("--platform", default="auto")
        p.add_argument("--anchors", nargs="*")
        p.add_argument("--baseline")
        p.add_argument("--device-model", default="unknown")
        p.add_argument("--skip-cycles", type=int, default=2)
    p = sub.add_parser("rca")
    p.add_argument("documents")
    p.add_argument("--cycle", type=int)
    for name in ("agent-analyze", "agent-chat"):
        p = sub.add_parser(name)
        p.add_argument("--anomalies", default="anomalies.json")
        p.add_argument("--baseline")
        p.add_argument("--templates")
        p.add_argument("--logfile")
        p.add_argument("--cycle", type=int)
        p.add_argument("--config")
        p.add_argument("--platform", default="auto")
        p.add_argument("--anchors", nargs="*")
        p.add_argument("--docs", nargs="*", default=[])
        p.add_argument("--index")
        p.add_argument("--store")
        p.add_argument("--model", default=client.MODEL)
        p.add_argument("--api-base")
        p.add_argument("--api-key")
        p.add_argument("--temperature", type=float, default=client.TEMPERATURE)
        p.add_argument("--max-tokens", type=int, default=client.MAX_TOKENS)
        p.add_argument("--with-model", action="store_true", help="ask a language model; without it answers are by rule")
    return top


def _numbered(spark: SparkSession, a: argparse.Namespace, settings: Settings, path: str) -> tuple[Analysis, DataFrame, DataFrame]:
    """The analysis, the numbered lines of a log, and the lines as they were read."""
    analysis, lines = read(spark, path, settings, a.platform, tuple(a.anchors or ()))
    return analysis, analysis.numbered(lines), lines


def _templates(spark: SparkSession, path: str) -> DataFrame:
    """Of a table, or of a state in JSON."""
    return M.read_state(spark, path, "saved") if path.endswith(".json") else spark.read.parquet(path)


def _agent(spark: SparkSession, a: argparse.Namespace, settings: Settings, ask, read_line, encoder) -> str:
    """Knowledge and experiences are of a platform that a log or a name tells; a new experience makes the knowledge be built again."""
    profile, lines = None, None
    if a.logfile:
        analysis, lines, _ = _numbered(spark, a, settings, a.logfile)
        profile = analysis.profile
    elif a.platform != "auto":
        profile = profiles.get(a.platform)
    own = settings.retrieval
    place = a.index or own.index or (f"{a.store}/index/{profile.name if profile else 'all'}" if a.store else S.scratch(spark, "knowledge"))
    docs = S.resolve(spark, [*own.docs, *a.docs])

    def knowledge(force: bool = False):
        encode, encode_one = encoder or (None, None)
        return A.build_knowledge(spark, place, documents=docs, store=a.store, platform=profile.name if profile else None, size=own.chunk_size, overlap=own.chunk_overlap, force=force, backend=own.backend, bits=own.bits, top_k=own.top_k, encode=encode, encode_one=encode_one)

    session = A.Session(E.read_json(spark, a.anomalies), _templates(spark, a.templates) if a.templates else None, E.read_baseline(spark, a.baseline)[0] if a.baseline else None, lines, knowledge())
    if a.command == "agent-chat":
        said = []
        for text in session.chat(read_line, ask):
            print(text)
            said.append(text)
        return "\n".join(said)
    text = session.analyse(a.cycle, ask)
    if a.store and profile and a.logfile and session.remember(a.store, platform=profile.name, analysis=text, source=S.fingerprint(spark, a.logfile), created=f"{datetime.now():%Y-%m-%d %H:%M:%S}"):
        knowledge(force=True)
    return text


def _parse(spark: SparkSession, a: argparse.Namespace, analysis: Analysis, numbered: DataFrame, lines: DataFrame) -> str:
    known = M.templates(analysis.mined(lines))
    if a.output:
        known = S.stored(known, "templates")
        known.write.mode("overwrite").parquet(f"{a.output}/templates")
        M.write_state(known, f"{a.output}/state.json")
        if analysis.settings.miner.compact_summary:
            M.compact_templates(known).select("summary").write.mode("overwrite").text(f"{a.output}/summary")
    if a.command == "train-templates":
        return "\n".join(f"{r['template_id']}\t{r['count']}\t{r['template']}" for r in M.top(known).collect())
    routed = numbered.groupBy("file", "cycle_id").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(analysis.channel()).alias("channels")).orderBy("file", "cycle_id")
    rows = [(r["file"].rsplit("/", 1)[-1], r["cycle_id"], f"{r['lines']} lines", f"{r['channels']} channels") for r in routed.toLocalIterator()]
    return text_table(f"Cycles ({analysis.profile.title})", ["log", "cycle", "lines", "channels"], rows)


def _report(spark: SparkSession, a: argparse.Namespace, analysis: Analysis, numbered: DataFrame) -> str:
    t = analysis.timing(numbered, a.skip_cycles)
    text = R.to_markdown(t["summary"], t["stats"], t["pivot"], device=a.device_model, platform=analysis.profile.name, has_time=analysis.profile.has_time, untimed=t["untimed"])
    if a.output:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.output)
    return text


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable | None = None, read=lambda: input("kilnlog> "), encoder: tuple[Callable, Callable] | None = None) -> str:
    """ask is a client of a language model, as Toolbox.converse takes it; --with-model makes one, and without either the answers are by rule.

    encoder, a function that adds v to chunks and one from a text to a vector, lets knowledge be searched by the backend of the settings.
    """
    a = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "rca":
        row = spark.read.text(a.documents).first()
        doc = json.loads(row[0]) if row else {}
        return E.summary_report(doc, datetime.now()) if a.cycle is None else E.cycle_report(doc, a.cycle)
    settings = Settings.load(a.config) if a.config else Settings()
    if a.command.startswith("agent-"):
        if ask is None and a.with_model:
            ask = client.chat_client(a.model, api_base=a.api_base, api_key=a.api_key, temperature=a.temperature, max_tokens=a.max_tokens, system=A.ROLE)
        return _agent(spark, a, settings, ask, read, encoder)
    analysis, numbered, lines = _numbered(spark, a, settings, a.log)
    if a.command in ("parse", "train-templates"):
        return _parse(spark, a, analysis, numbered, lines)
    if a.command == "report":
        return _report(spark, a, analysis, numbered)
    if a.command == "train-baseline":
        base = S.stored(analysis.baseline(numbered), "baseline")
        named = spark.createDataFrame([(m.order, m.name, m.pattern, m.is_regex) for m in analysis.profile.milestones], "order int, name string, pattern string, is_regex boolean")
        if a.output:
            E.write_baseline(base, named, a.output)
        return text_table("Baseline", ["pair", "mean", "stddev"], [(r["pair"], f"{r['mean']:.3f}s", f"{r['stddev']:.3f}s") for r in base.orderBy("pair").collect()])
    base = None
    if a.baseline:
        # a baseline is of the milestones that it was trained with
        base, saved = E.read_baseline(spark, a.baseline)
        analysis = Analysis(analysis.profile, settings, analysis.anchors, E.milestones(saved))
    found = S.stored(analysis.anomalies(numbered, base), "anomalies")
    if a.output:
        E.write_documents(E.documents(found, device=a.device_model), a.output)
    counts = E.severity_counts(found).orderBy(E.severity_rank(F.col("severity"))).collect()
    return text_table("Anomalies", ["severity", "count"], [(r["severity"], r["n"]) for r in counts]) if counts else "no anomalies"


if __name__ == "__main__":
    print(main())
