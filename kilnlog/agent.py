"""One analysed log, as an agent or a person asks about it: tools, text views, knowledge and experiences.

Everything is a DataFrame until an answer is made; answers are bounded (hits, lines, templates, severities), but for
the anomalies of one log and its root-cause text, which are as long as the document that holds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.operators import experience as X
from kilnlog.operators import export as E
from kilnlog.operators import retrieval as V
from kilnlog.operators import tools as Q
from kilnlog.sources import logs as S

HELP = {
    "help": "the commands",
    "cycles": "cycles with anomalies",
    "anomalies [cycle]": "anomalies of a cycle, or totals by severity",
    "report [cycle]": "root-cause text of a cycle, or of all",
    "templates": "the first ten templates",
    "baseline": "means and deviations of the baseline",
    "quit": "end",
}
ROLE = "You analyse logs. Find the root cause with the tools at hand and say what should be done."
TASK = "Analyse the anomalies{0} and give a root-cause report. Use the tools for anomalies, lines, templates, the baseline and background knowledge."


@dataclass
class Knowledge:
    """Chunks (id, text, source_type, platform) and their lexical index, perhaps with vectors and what turns a text into one."""

    chunks: DataFrame
    index: tuple[DataFrame, DataFrame]
    vectors: V.VectorBackend | None = None
    encode: Callable[[str], list[float]] | None = None
    top_k: int = 5

    def search(self, query: str, k: int | None = None) -> DataFrame:
        """Lexical hits, fused with those of the vectors where there are any."""
        k = k or self.top_k
        spark = self.chunks.sparkSession
        asked = spark.createDataFrame([(0, query)], "query_id long, text string")
        if self.vectors is None or self.encode is None:
            ranked = V.lexical(self.chunks, asked, k, index=self.index)
        else:
            near = self.vectors.search(self.encode(query), 2 * k).select(F.lit(0).cast("long").alias("query_id"), "id", "score", "rank")
            ranked = V.fuse(V.lexical(self.chunks, asked, 2 * k, index=self.index), near, k)
        return Q.knowledge(ranked, self.chunks).join(self.chunks.select("id", "platform"), "id").orderBy("rank")


def build_knowledge(spark: SparkSession, path: str, *, documents: list[str] = (), store: str | None = None, platform: str | None = None, size: int = 512, overlap: int = 64, prefer_compact: bool = False, force: bool = False, backend: str = "none", bits: int = 4, top_k: int = 5, encode: Callable[[DataFrame], DataFrame] | None = None, encode_one: Callable[[str], list[float]] | None = None) -> Knowledge | None:
    """The knowledge stored at path, made of documents and of a platform's experiences if absent or forced; None without any source.

    encode adds v, a vector, to chunks (id, text); without it, or with backend none, search is lexical.  Vectors that
    the backend of that name cannot serve are served by the next one of quantised, exact and none.
    """
    def chunks() -> DataFrame:
        parts = [S.read_documents(spark, p).select("source", "text", F.lit("doc").alias("source_type")) for p in dict.fromkeys(documents)]
        if store and platform and S.exists(spark, f"{store}/experiences"):
            parts.append(X.documents(spark, store, platform, prefer_compact).withColumn("source_type", F.lit("experience")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        once = every.groupBy("source", "source_type").agg(F.first("text").alias("text"))
        cut = V.chunk_chars(once.select("source", "text"), size, overlap)
        return cut.join(once.select("source", "source_type"), "source").select(F.col("chunk_id").alias("id"), "text", "source", "source_type", F.lit(platform).cast("string").alias("platform"))

    known = bool(documents) or bool(store and platform and S.exists(spark, f"{store}/experiences"))
    force = force and known
    if not known and not S.exists(spark, f"{path}/chunks"):
        return None
    table = V.load_or_build(spark, f"{path}/chunks", chunks, force=force)
    index = tuple(V.load_or_build(spark, f"{path}/{n}", lambda i=i: V.bm25_index(table)[i], force=force) for i, n in enumerate(("postings", "lengths")))
    vectors = None
    if backend != "none" and encode is not None and encode_one is not None:
        v = V.load_or_build(spark, f"{path}/vectors", lambda: encode(table.select("id", "text")).select("id", "v"), force=force)
        vectors = V.first_backend(v, len(encode_one("width")), backend, bits)
    return Knowledge(table, index, vectors, encode_one, top_k)


@dataclass
class Session:
    """documents as export.documents gives them, of one log; templates, baseline pairs and numbered lines where they are known."""

    documents: DataFrame
    templates: DataFrame | None = None
    baseline: DataFrame | None = None
    lines: DataFrame | None = None
    knowledge: Knowledge | None = None

    def __post_init__(self) -> None:
        self.document = E.as_dict(self.documents)
        self.spans = E.exploded(E.parsed(self.documents))

    # --- the tools; each gives an object that JSON can hold ---

    def get_anomalies(self, cycle_id: int | None = None) -> dict:
        rows = _rows(Q.anomalies(self.spans, cycle_id).orderBy("cycle_id", "place"))
        return {"total": len(rows), "anomalies": rows}

    def get_cycle_context(self, cycle_id: int, start_line: int | None = None, end_line: int | None = None) -> dict:
        if self.lines is None or self.lines.where(F.col("cycle_id") == cycle_id).isEmpty():
            return {"error": f"no lines of cycle {cycle_id}"}
        rows = _rows(Q.context(self.lines, cycle_id, start_line, end_line).orderBy("line_in_cycle"))
        counts = {c: rows[0][c] if rows else 0 for c in ("total_lines", "returned_lines")}
        return {"cycle_id": cycle_id, **counts, "lines": [r["raw"] for r in rows]}

    def get_baseline(self) -> dict:
        rows = [] if self.baseline is None else _rows(Q.baseline(self.baseline))
        return {"mean_deltas": {r["pair"]: r["mean"] for r in rows}, "stddev_deltas": {r["pair"]: r["stddev"] for r in rows}, "sample_count": rows[0]["sample_count"] if rows else 0}

    def get_templates(self, top_k: int = 20) -> dict:
        rows = [] if self.templates is None else _rows(Q.templates(self.templates, top_k).orderBy(F.desc("count"), "template_id"))
        return {"total_templates": rows[0]["total_templates"] if rows else 0, "templates": [{k: r[k] for k in ("template_id", "count", "template")} for r in rows]}

    def search_logs(self, query: str, cycle_id: int | None = None) -> dict:
        rows = [] if self.lines is None else _rows(Q.search(self.lines, query, cycle_id).select("cycle_id", "line_in_cycle", "raw"))
        return {"query": query, "total_matches": len(rows), "results": rows}

    def search_knowledge_base(self, query: str, top_k: int | None = None) -> dict:
        if self.knowledge is None:
            return {"error": "no knowledge base is configured"}
        rows = _rows(self.knowledge.search(query, top_k).drop("query_id"))
        return {"query": query, "total_results": len(rows), "results": rows}

    def toolbox(self, max_rounds: int = 5) -> Q.Toolbox:
        box = Q.Toolbox(max_rounds)
        for name, schema in Q.SCHEMAS.items():
            box.register(name, schema, lambda name=name, **a: json.dumps(getattr(self, name)(**a), ensure_ascii=False, default=str))
        return box

    # --- root cause, by a model or by rule ---

    def analyse(self, cycle_id: int | None = None, ask=None, now: datetime | None = None) -> str:
        """The answer of ask, a model's client as Toolbox.converse takes it; without one the text by rule."""
        if not self.document.get("traces"):
            raise ValueError("there are no anomalies; analyse the log first")
        if ask is not None:
            hint = "" if cycle_id is None else f" of cycle {cycle_id}"
            return self.toolbox().converse(ask, [{"role": "user", "content": TASK.format(hint)}])
        return E.summary_report(self.document, now or datetime.now()) if cycle_id is None else E.cycle_report(self.document, cycle_id)

    def remember(self, store: str, *, platform: str, analysis: str, source: dict | None = None, created: str = "") -> bool:
        """Append what was found to the platform's experiences; whether it is new, so that knowledge must be built again."""
        device = self.document.get("resource", {}).get("device.model", "unknown")
        found = self.templates if self.templates is not None else self.documents.sparkSession.createDataFrame([], "template_id long, template string, count long")
        row = X.experience(self.documents.sparkSession, platform=platform, device=device, spans=S.stored(self.spans, "spans"), templates=found, analysis=analysis, source=source, created=created)
        return X.write(self.documents.sparkSession, store, S.stored(row, "experience"))

    # --- the views of the prompt ---

    def cycles(self) -> list[int]:
        return [t["cycle_id"] for t in self.document.get("traces", []) if "cycle_id" in t]

    def answer(self, line: str) -> str | None:
        """The text for one command; None to end."""
        name, *rest = line.split() or [""]
        if name in ("quit", "exit"):
            return None
        if rest and not rest[0].lstrip("-").isdigit():
            return f"{rest[0]} is no cycle"
        cycle = int(rest[0]) if rest else None
        views = {"help": self._help, "cycles": self._cycles, "anomalies": self._anomalies, "report": self._report, "templates": self._templates, "baseline": self._baseline}
        return views[name](cycle) if name in views else f"unknown command: {name}; help lists the commands"

    def _help(self, _) -> str:
        return "\n".join(f"{k}: {v}" for k, v in HELP.items())

    def _cycles(self, _) -> str:
        return ", ".join(map(str, self.cycles())) or "no cycles"

    def _anomalies(self, cycle: int | None) -> str:
        if cycle is None:
            s = self.document.get("summary", {})
            return "\n".join([f"{s.get('total_anomalies', 0)} anomalies", *(f"{k}: {n}" for k, n in s.get("by_severity", {}).items())])
        rows = self.get_anomalies(cycle)["anomalies"]
        return "\n".join(f"[{r['severity']}] {r['rule_name']}: {r['message']}" for r in rows) or f"no anomalies in cycle {cycle}"

    def _report(self, cycle: int | None) -> str:
        return E.summary_report(self.document, datetime.now()) if cycle is None else E.cycle_report(self.document, cycle)

    def _templates(self, _) -> str:
        if self.templates is None:
            return "no templates"
        rows = _rows(self.templates.orderBy("template_id").limit(10))
        return "\n".join([f"{self.templates.count()} templates", *(f"[{r['template_id']}] x{r['count']} {r['template'][:80]}" for r in rows)])

    def _baseline(self, _) -> str:
        b = self.get_baseline()
        return "\n".join([f"{b['sample_count']} samples", *(f"{p}: {m:.3f}s +- {b['stddev_deltas'][p]:.3f}s" for p, m in b["mean_deltas"].items())]) if b["mean_deltas"] else "no baseline"

    def chat(self, read: Callable[[], str], ask=None) -> Iterator[str]:
        """Answers to the lines that read gives, until it ends; lines that are no commands go to ask where there is one."""
        box, said = self.toolbox(), []
        while True:
            try:
                line = read().strip()
            except (EOFError, KeyboardInterrupt):
                return
            if ask is not None and (line.split() or [""])[0] not in {k.split()[0] for k in HELP} | {"exit"}:
                said.append({"role": "user", "content": line})
                text = box.converse(ask, list(said))
                said.append({"role": "assistant", "content": text})
            elif (text := self.answer(line)) is None:
                return
            yield text


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
