"""The questions that an agent may ask of an analysed log; each is one query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCH_HITS, CONTEXT_LINES, DEFAULT_SLICE, TEXT_CHARS = 50, 200, 100, 500


def anomalies(spans: DataFrame, cycle_id: int | None = None) -> DataFrame:
    """(cycle_id, place, severity, rule_id, rule_name, message, line_number, anomaly_count) of all cycles or of one."""
    own = spans if cycle_id is None else spans.where(F.col("cycle_id") == cycle_id)
    count = own.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return own.join(count, "cycle_id").select("cycle_id", "place", "severity", "rule_id", "rule_name", "message", "line_number", "anomaly_count")


def context(lines: DataFrame, cycle_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(line_in_cycle, raw, total_lines, returned_lines) of at most 200 lines; no row if the cycle has no lines.

    A start alone means 100 lines from there, an end alone nothing.
    """
    own = lines.where(F.col("cycle_id") == cycle_id)
    lo, hi = (start or 0, end) if start is not None and end is not None else (start, start + DEFAULT_SLICE) if start is not None else (0, None)
    inside = F.col("line_in_cycle") >= lo
    inside = inside if hi is None else inside & (F.col("line_in_cycle") < hi)
    counts = own.agg(F.count(F.lit(1)).alias("total_lines"), F.count(F.when(inside, 1)).alias("returned_lines"))
    return own.where(inside).orderBy("line_in_cycle").limit(CONTEXT_LINES).select("line_in_cycle", "raw").join(counts)  # one row


def search(lines: DataFrame, text: str, cycle_id: int | None = None, order: tuple[str, ...] = ("cycle_id", "line_in_cycle")) -> DataFrame:
    """The first 50 lines that hold text, whatever its case; a cycle without lines is searched as all."""
    found = lines.where(F.contains(F.lower("raw"), F.lit(text.lower())))
    if cycle_id is not None and not lines.where(F.col("cycle_id") == cycle_id).isEmpty():
        found = found.where(F.col("cycle_id") == cycle_id)
    return found.orderBy(*order).limit(SEARCH_HITS)


def baseline(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("pair")


def templates(found: DataFrame, k: int = 20) -> DataFrame:
    """(template_id, count, template, total_templates), the most frequent first, then in the order of ids."""
    total = found.agg(F.count(F.lit(1)).alias("total_templates"))
    return found.orderBy(F.desc("count"), "template_id").limit(k).select("template_id", "count", "template").join(total)  # one row


def knowledge(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, id, source_type, score, text) of search results; chunks has id, text, source_type."""
    own = chunks.select("id", F.coalesce("source_type", F.lit("doc")).alias("source_type"), F.substring("text", 1, TEXT_CHARS).alias("text"))
    return ranked.join(own, "id").select("query_id", "rank", "id", "source_type", F.round("score", 4).alias("score"), "text")


#: Names and parameters of the tools that a model may call.
SCHEMAS = {
    "get_anomalies": {"type": "object", "properties": {"cycle_id": {"type": "integer"}}, "required": []},
    "get_cycle_context": {"type": "object", "properties": {"cycle_id": {"type": "integer"}, "start_line": {"type": "integer"}, "end_line": {"type": "integer"}}, "required": ["cycle_id"]},
    "get_baseline": {"type": "object", "properties": {}, "required": []},
    "get_templates": {"type": "object", "properties": {"top_k": {"type": "integer"}}, "required": []},
    "search_logs": {"type": "object", "properties": {"query": {"type": "string"}, "cycle_id": {"type": "integer"}}, "required": ["query"]},
    "search_knowledge_base": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["query"]},
}


class Toolbox:
    """Registers functions under names and answers a model's calls, in at most max_rounds rounds."""

    def __init__(self, max_rounds: int = 5) -> None:
        self.functions, self.schemas, self.max_rounds = {}, {}, max_rounds

    def register(self, name: str, schema: dict, function) -> None:
        self.functions[name], self.schemas[name] = function, schema

    def call(self, name: str, arguments: dict):
        if name not in self.functions:
            return {"error": f"no tool {name}"}
        try:
            return self.functions[name](**arguments)
        except TypeError as e:
            return {"error": str(e)}

    def converse(self, ask, messages: list[dict]) -> str:
        """ask(messages, schemas) gives a text, a list of calls (id, name, arguments), or both as a pair.

        The model's own message goes back before the results of its calls, until it calls nothing more; after the last round its last text stands.
        """
        text = ""
        for _ in range(self.max_rounds):
            answer = ask(messages, self.schemas)
            text, calls = (answer, []) if isinstance(answer, str) else answer if isinstance(answer, tuple) else ("", answer)
            if not calls:
                break
            made = [{"id": i, "type": "function", "function": {"name": n, "arguments": json.dumps(a, ensure_ascii=False)}} for i, n, a in calls]
            said = {"role": "assistant", "content": text or None, "tool_calls": made}
            messages = [*messages, said, *({"role": "tool", "tool_call_id": i, "content": self.call(n, a)} for i, n, a in calls)]
        return text or ""
