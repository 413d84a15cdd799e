"""Chat formatting: tool calls linked to their results.

A message whose text is a JSON object with a list "tool_calls" makes calls ({"id", "name", "arguments", "depends_on"}, arguments as an
object or as JSON text); a message of role tool whose text is an object with "tool_call_id" is a result.
Calls and results meet in a hash join on (conversation, id).  Calls are ordered topologically: level 0 has no
dependencies, and a call's level is one more than the highest among its dependencies; calls on a cycle or behind one have none.  A message sorts
by (order_turn, order_level, turn): a result never before its call, a call never before a call that it depends on.  Arguments are validated against
the tool's schema.  Each message becomes one line of canonical JSON (sorted keys, no spaces, UTF-8).

Messages stay rows.  For the order, the calls of a conversation are dealt into buckets of neighbouring turns of some bounded size; a round
orders all buckets as far as they can be by themselves, then tells other buckets what their calls wait for.  So the rounds are as many
as a chain of dependencies changes its bucket, one for a conversation of one bucket, whatever the length of the chain.

Defined cases: null texts and roles are JSON null.  The first of calls of equal id (by turn) is linked, later ones are "duplicate".  Status of a
message: "plain", "calls" (all answered and valid), else the first of "invalid", "duplicate", "cycle", "unanswered" that a call of it has; of a result "linked", or "orphan" without a call.  A
dependency on an unknown id is ignored.  Text that isn't such JSON is plain, and so is JSON without a canonical form (NaN, infinities, lone surrogates); arguments of that kind are null and invalid.  Repeated rows are kept.
Schemas may have the keywords in KEYWORDS; any other is a ValueError before anything runs.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import materialise, small_side, table, tidy

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Those of the last four say nothing about a value.
KEYWORDS = {"type", "enum", "properties", "required", "additionalProperties", "items", "minimum", "maximum", "title", "description", "default", "examples"}
BUCKET = 20_000  # calls of a conversation that are ordered together


def canonical(value) -> str:
    """Canonical JSON; a ValueError for what has none: NaN, infinities and lone surrogates."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def check_schema(schema) -> None:
    """A ValueError for what fits() does not know."""
    if not isinstance(schema, dict) or not schema.keys() <= KEYWORDS:
        raise ValueError(f"a schema is an object with the keywords {sorted(KEYWORDS)}, not {schema!r}")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in (*_KINDS, "integer", "number"):
            raise ValueError(f"unknown type {kind!r}")
    more = schema.get("additionalProperties", True)
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else []), *([] if isinstance(more, bool) else [more])]:
        check_schema(inner)


def same(a, b) -> bool:
    """Equality of JSON values: 1 is 1.0 and never true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def _is(value, kind: str) -> bool:
    number = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
    if kind == "integer":
        return number and value == int(value)
    return number if kind == "number" else isinstance(value, _KINDS[kind])


def fits(value, schema: dict) -> bool:
    """Whether value fits a checked schema."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, kind) for kind in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return False
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        more = schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", [])) or (more is False and any(k not in known for k in value)):
            return False
        return all(fits(v, known[k]) if k in known else not isinstance(more, dict) or fits(v, more) for k, v in value.items())
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    return True


def _parse(text, role, schemas: dict) -> tuple[str, object, list]:
    """(kind, body, calls): calls as (id, name, arguments in canonical JSON, depends_on, valid)."""
    if text and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text)
            canonical(body)
        except (ValueError, RecursionError):
            return "plain", text, []
        if role == "tool" and isinstance(body.get("tool_call_id"), str):
            return "result", body, []
        made = body.get("tool_calls")
        if isinstance(made, list) and made and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in made):
            calls = []
            for c in made:
                args = c.get("arguments", {})
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                        canonical(args)
                    except (ValueError, RecursionError):
                        args = None
                name = str(c.get("name", ""))
                after = c.get("depends_on") if isinstance(c.get("depends_on"), list) else []
                calls.append((c["id"], name, canonical(args), [str(d) for d in after], isinstance(args, dict) and name in schemas and fits(args, schemas[name])))
            return "calls", body, calls
    return "plain", text, []


_CALL = "struct<id:string,name:string,args:string,after:array<string>,valid:boolean>"


def link_tool_calls(spark: SparkSession, messages: DataFrame, schemas: dict[str, dict], *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(conv_id, turn, role, order_turn, order_level, n_calls, n_valid, status, message) of each message."""
    for schema in schemas.values():
        check_schema(schema)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [_parse(t, r, schemas) for t, r in zip(pdf["_text"], pdf["_role"], strict=True)]
            yield pd.DataFrame({
                "_conv": pdf["_conv"].astype("Int64"), "_turn": pdf["_turn"].astype("Int64"), "_role": pdf["_role"], "_kind": [k for k, _, _ in rows],
                "_content": [canonical(b if k == "plain" else b.get("content")) for k, b, _ in rows],
                "_result": [b["tool_call_id"] if k == "result" else None for k, b, _ in rows],
                "_calls": [[dict(zip(("id", "name", "args", "after", "valid"), c, strict=True)) for c in calls] for _, _, calls in rows],
            })

    named = messages.select(F.col(conv_col).cast("long").alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    parsed = materialise(spark, named.mapInPandas(parse, f"_conv long, _turn long, _role string, _kind string, _content string, _result string, _calls array<{_CALL}>"), "chat-parsed")
    calls = parsed.where("_kind = 'calls'").select("_conv", "_turn", F.posexplode("_calls").alias("_pos", "_call")).select("_conv", "_turn", "_pos", F.col("_call.id").alias("_cid"), F.col("_call.after").alias("_after"))
    first = calls.groupBy("_conv", "_cid").agg(F.min(F.struct("_turn", "_pos", "_after")).alias("_f")).select("_conv", "_cid", F.col("_f._turn").alias("_turn"), F.col("_f._pos").alias("_pos"), F.col("_f._after").alias("_after"))
    first = materialise(spark, first, "chat-calls")
    levels = _levels(spark, first, bucket)
    results = parsed.where("_kind = 'result'")
    answered = results.select(F.col("_conv").alias("_rc"), F.col("_result").alias("_rid")).distinct()
    linked = materialise(spark, levels.join(answered, F.col("_conv").eqNullSafe(F.col("_rc")) & (F.col("_cid") == F.col("_rid")), "left").select(F.col("_conv").alias("_lc"), F.col("_cid").alias("_lid"), F.col("_turn").alias("_lt"), F.col("_pos").alias("_lp"), "_order", "_level", F.col("_rid").isNotNull().alias("_answered")), "chat-links")
    # what a message with calls knows of them: bounded by its own number of calls
    own = parsed.where("_kind = 'calls'").select("_conv", "_turn", F.explode("_calls").alias("_call")).select("_conv", "_turn", F.col("_call.id").alias("_cid")).distinct()
    marks = own.join(linked, F.col("_conv").eqNullSafe(F.col("_lc")) & (F.col("_cid") == F.col("_lid")), "left").groupBy("_conv", "_turn").agg(
        F.max("_order").alias("_o"), F.max("_level").alias("_l"),
        F.collect_list(F.struct(F.col("_cid").alias("id"), F.col("_level").alias("level"), F.col("_answered").alias("answered"), F.col("_lt").alias("turn"), F.col("_lp").alias("pos"))).alias("_marks"),
    ).withColumnsRenamed({"_conv": "_mc", "_turn": "_mt"})

    def show(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, role, content, rid, made, marks_, turn in zip(pdf["_kind"], pdf["_role"], pdf["_content"], pdf["_result"], pdf["_calls"], pdf["_marks"], pdf["_turn"], strict=True):
                body = {"content": json.loads(content), "role": role}
                status, n_valid = "plain", 0
                if k == "calls":
                    by_id = {m["id"]: m for m in marks_}
                    order = sorted(range(len(made)), key=lambda i: (by_id[made[i]["id"]]["level"] is None, by_id[made[i]["id"]]["level"] or 0, i))
                    body["tool_calls"] = [{"function": {"arguments": made[i]["args"], "name": made[i]["name"]}, "id": made[i]["id"], "type": "function"} for i in order]
                    n_valid = sum(bool(c["valid"]) for c in made)
                    faults = set()
                    for i, c in enumerate(made):
                        m = by_id[c["id"]]
                        faults |= {"invalid"} if not c["valid"] else set()
                        faults |= {"duplicate"} if (m["turn"], m["pos"]) != (None if turn is pd.NA else turn, i) else set()
                        faults |= {"cycle"} if m["level"] is None else set()
                        faults |= {"unanswered"} if not m["answered"] else set()
                    status = next((f for f in ("invalid", "duplicate", "cycle", "unanswered") if f in faults), "calls")
                elif k == "result":
                    body["tool_call_id"] = rid
                out.append((len(made), n_valid, status, canonical(body)))
            cols = list(zip(*out, strict=True)) if out else ((), (), (), ())
            yield pd.DataFrame({c: pdf[c] for c in ("_conv", "_turn", "_role", "_o", "_l", "_kind", "_found")} | dict(zip(("n_calls", "n_valid", "status", "message"), cols, strict=True)))

    shown = "_conv long, _turn long, _role string, _o long, _l int, _kind string, _found boolean, n_calls long, n_valid long, status string, message string"
    columns = ["_conv", "_turn", "_role", "_kind", "_content", "_result", "_calls", "_marks", "_o", "_l", "_found"]
    none = {"_marks": F.lit(None).cast("array<struct<id:string,level:int,answered:boolean,turn:long,pos:int>>"), "_o": F.lit(None).cast("long"), "_l": F.lit(None).cast("int"), "_found": F.lit(False)}
    plain = parsed.where("_kind = 'plain'").withColumns(none).select(columns)
    calling = parsed.where("_kind = 'calls'").join(marks, F.col("_conv").eqNullSafe(F.col("_mc")) & F.col("_turn").eqNullSafe(F.col("_mt")), "left").withColumn("_found", F.lit(True)).select(columns)
    answer = results.join(linked, F.col("_conv").eqNullSafe(F.col("_lc")) & (F.col("_result") == F.col("_lid")), "left").withColumns({"_marks": none["_marks"], "_o": F.col("_order"), "_l": F.col("_level") + 1, "_found": F.col("_lid").isNotNull()}).select(columns)
    done = plain.unionByName(calling).unionByName(answer).mapInPandas(show, shown)
    return done.select(
        F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), F.col("_role").alias("role"),
        F.greatest(F.coalesce("_o", "_turn"), F.col("_turn")).alias("order_turn"), F.coalesce("_l", F.lit(0)).cast("long").alias("order_level"), "n_calls", "n_valid",
        F.when(F.col("_kind") == "result", F.when(F.col("_found"), "linked").otherwise("orphan")).otherwise(F.col("status")).alias("status"), "message",
    )


def _order_part(batches):
    """Streams calls sorted by _g, a hash of conversation and bucket; orders each run of equal _g as far as it can be."""
    import pandas as pd

    def solve(rows: list[dict]) -> pd.DataFrame:
        at = {(r["_conv"], r["_cid"]): r for r in rows}
        waiting = {k: [d for d in r["_local"] if (r["_conv"], d) in at] for k, r in at.items()}
        behind: dict = {}
        for (conv, cid), deps in waiting.items():
            for d in deps:
                behind.setdefault((conv, d), []).append((conv, cid))
        open_ = {k: len(deps) for k, deps in waiting.items()}
        ready = [k for k, r in at.items() if r["_level"] is None and not r["_outer"] and not open_[k]]
        while ready:
            k = ready.pop()
            r = at[k]
            r["_level"], r["_fresh"] = r["_base"], True
            for x in behind.get(k, ()):
                w = at[x]
                w["_base"], w["_order"] = max(w["_base"], r["_level"] + 1), max(w["_order"], r["_order"], key=_turn)
                open_[x] -= 1
                if not open_[x] and not w["_outer"]:
                    ready.append(x)
        for k, r in at.items():
            r["_local"] = [d for d in waiting[k] if at[r["_conv"], d]["_level"] is None]
        out = pd.DataFrame(list(at.values()))
        return out.astype({"_conv": "Int64", "_turn": "Int64", "_order": "Int64", "_level": "Int32"})

    held: list[dict] = []
    for pdf in batches:
        for c in ("_conv", "_turn", "_order", "_level"):
            pdf[c] = pdf[c].astype("Int64").astype(object).where(pdf[c].notna(), None)
        rows = pdf.to_dict("records")
        for r in rows:
            r["_fresh"] = False
        if held and rows and held[-1]["_g"] != rows[0]["_g"]:
            yield solve(held)
            held = []
        held += rows
        cut = next((i for i in range(len(held), 0, -1) if held[i - 1]["_g"] != held[-1]["_g"]), 0)
        if cut:
            yield solve(held[:cut])
            held = held[cut:]
    if held:
        yield solve(held)


def _turn(x) -> tuple:
    return x is not None, x or 0


def _levels(spark: SparkSession, calls: DataFrame, bucket: int) -> DataFrame:
    """calls with _level (null on cycles and behind them) and _order, the latest turn among a call and those that it depends on (its own without a level)."""
    asked = calls.select(F.col("_conv").alias("_ec"), F.col("_cid").alias("_to"), F.explode(F.array_distinct("_after")).alias("_from"))
    known = calls.select(F.col("_conv").alias("_kc"), F.col("_cid").alias("_kid"), F.col("_turn").alias("_kt"))
    # conversations of more than one bucket, of which there are few: their buckets are ranges of turns, and hashes of ids in crowded ranges
    many = calls.groupBy("_conv").agg(F.count(F.lit(1)).alias("_n"), F.min("_turn").alias("_lo"), F.max("_turn").alias("_hi")).where(F.col("_n") > bucket)
    many = small_side(materialise(spark, many.withColumnRenamed("_conv", "_bc"), "chat-many"), 32)

    def ranged(df: DataFrame, conv: str, turn: str) -> DataFrame:
        share = (F.col(turn) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
        return df.join(many, F.col(conv).eqNullSafe(F.col("_bc")), "left").withColumn("_range", F.coalesce(F.floor(share * F.ceil(F.col("_n") / bucket)), F.lit(0)).cast("long")).drop("_bc", "_n", "_lo", "_hi")

    crowded = ranged(calls, "_conv", "_turn").groupBy("_conv", "_range").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * bucket)
    crowded = small_side(materialise(spark, crowded.withColumnsRenamed({"_conv": "_bc", "_range": "_br"}), "chat-crowded"), 32)

    def placed(df: DataFrame, conv: str, cid: str, turn: str, name: str) -> DataFrame:
        both = ranged(df, conv, turn)
        both = both.join(crowded, F.col(conv).eqNullSafe(F.col("_bc")) & (F.col("_range") == F.col("_br")), "left")
        salt = F.coalesce(F.pmod(F.xxhash64(cid), F.ceil(F.col("_n") / bucket)), F.lit(0))
        return both.withColumn(name, F.xxhash64(conv, "_range", salt)).drop("_bc", "_br", "_n", "_range")

    edges = asked.join(placed(known, "_kc", "_kid", "_kt", "_fg"), F.col("_ec").eqNullSafe(F.col("_kc")) & (F.col("_from") == F.col("_kid"))).select("_ec", "_from", "_to", "_fg")
    edges = materialise(spark, edges, "chat-edges")
    if edges.isEmpty():
        return calls.withColumns({"_order": F.col("_turn"), "_level": F.lit(0)})
    # as many as the message itself names
    deps = edges.groupBy("_ec", "_to").agg(F.collect_list(F.struct(F.col("_from").alias("id"), F.col("_fg").alias("g"))).alias("_deps"))
    state = placed(calls, "_conv", "_cid", "_turn", "_g").join(deps, F.col("_conv").eqNullSafe(F.col("_ec")) & (F.col("_cid") == F.col("_to")), "left")
    own = lambda here: F.filter(F.coalesce("_deps", F.array()), lambda d: (d["g"] == F.col("_g")) == here)
    state = state.select("_g", "_conv", "_cid", "_turn", "_pos", F.col("_turn").alias("_order"), F.lit(None).cast("int").alias("_level"), F.lit(0).alias("_base"), F.transform(own(True), lambda d: d["id"]).alias("_local"), F.size(own(False)).alias("_outer"))
    schema = "_g long, _conv long, _cid string, _turn long, _pos int, _order long, _level int, _base int, _local array<string>, _outer int, _fresh boolean"
    across = edges.join(state.select("_conv", "_cid", "_g"), F.col("_ec").eqNullSafe(F.col("_conv")) & (F.col("_to") == F.col("_cid"))).where("_g <> _fg").select("_ec", "_from", "_to")
    across = materialise(spark, across, "chat-across")
    while True:
        dealt = state.repartition("_g").sortWithinPartitions("_g")
        state = materialise(spark, dealt.mapInPandas(tidy(_order_part), schema), "chat-levels")
        gone = state.where("_fresh").select(F.col("_conv").alias("_gc"), F.col("_cid").alias("_gid"), "_level", "_order")
        told = across.join(gone, F.col("_ec").eqNullSafe(F.col("_gc")) & (F.col("_from") == F.col("_gid"))).groupBy("_ec", "_to").agg(F.count(F.lit(1)).cast("int").alias("_less"), (F.max("_level") + 1).alias("_b"), F.max("_order").alias("_o"))
        told = materialise(spark, told, "chat-told")
        if told.isEmpty():
            level = F.col("_level")
            return state.select("_conv", "_cid", "_turn", "_pos", F.when(level.isNull(), F.col("_turn")).otherwise(F.col("_order")).alias("_order"), level.alias("_level"))
        now = state.drop("_fresh").join(told, F.col("_conv").eqNullSafe(F.col("_ec")) & (F.col("_cid") == F.col("_to")), "left")
        more = {"_base": F.greatest("_base", F.coalesce("_b", F.lit(0))), "_order": F.greatest("_order", "_o"), "_outer": F.col("_outer") - F.coalesce("_less", F.lit(0))}
        state = now.withColumns(more).drop("_ec", "_to", "_less", "_b", "_o")


#: The tools that production conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """The table's turns as tool messages, by a fixed rule; l is the number of code points of a text (null: empty).

    A user turn t becomes an assistant message of one or two calls.  The first has the id c<t> (c0 if 11 divides l), is fetch(url) if 3 divides l,
    else search(query), with a limit of l mod 5 if l mod 3 is 1, and depends on d<t - 2>, and on c<t + 2> too if 7 divides l.  If l is even the second is d<t>, fetch(url), with a page too if 4 divides l; it depends on the first.
    An assistant turn t becomes the result of x<t> if 5 divides l, else of c<t - 1> if l is even, else of d<t - 1>.  Other turns stay as they are.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    n = F.length(text)
    divides = lambda k: n % k == 0
    name = lambda letter, shift=0: F.concat(F.lit(letter), (turn + shift).cast("string"))
    first = F.when(divides(11), F.lit("c0")).otherwise(name("c"))
    some = lambda when, value: F.when(when, value)
    args = F.struct(some(divides(3), text).alias("url"), some(~divides(3), text).alias("query"), some(n % 3 == 1, n % 5).alias("limit"))
    more = F.struct(text.alias("url"), some(divides(4), F.lit(1)).alias("page"))
    call = lambda id_, tool, arguments, after: F.struct(id_.alias("id"), tool.alias("name"), F.to_json(arguments).alias("arguments"), after.alias("depends_on"))
    one = call(first, F.when(divides(3), F.lit("fetch")).otherwise("search"), args, F.when(divides(7), F.array(name("d", -2), name("c", 2))).otherwise(F.array(name("d", -2))))
    two = call(name("d"), F.lit("fetch"), more, F.array(first))
    calls = F.to_json(F.struct(F.when(divides(2), F.array(one, two)).otherwise(F.array(one)).alias("tool_calls")))
    answer = F.to_json(F.struct(F.when(divides(5), name("x")).when(divides(2), name("c", -1)).otherwise(name("d", -1)).alias("tool_call_id"), text.alias("content")))
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select("conv_id", "turn", F.when(asks, F.lit("assistant")).when(answers, F.lit("tool")).otherwise(F.col("role")).alias("role"), F.when(asks, calls).when(answers, answer).otherwise(F.col("text")).alias("text"))


def op7_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(spark, as_tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


ORACLE = """
with recursive m as (select conv_id, turn, role, text, coalesce(length(text), 0) as l, to_json(coalesce(text, ''))::varchar as q from conversations),
c as (
  select conv_id, turn, 0 as pos, case when l % 11 = 0 then 'c0' else 'c' || turn end as id, case when l % 3 = 0 then 'fetch' else 'search' end as name,
    case l % 3 when 0 then '{"url":' || q || '}' when 1 then '{"limit":' || (l % 5) || ',"query":' || q || '}' else '{"query":' || q || '}' end as args,
    l % 3 <> 1 or l % 5 <> 0 as valid, case when l % 7 = 0 then ['d' || (turn - 2), 'c' || (turn + 2)] else ['d' || (turn - 2)] end as after from m where role = 'user'
  union all
  select conv_id, turn, 1, 'd' || turn, 'fetch', case when l % 4 = 0 then '{"page":1,"url":' || q || '}' else '{"url":' || q || '}' end,
    l % 4 <> 0, [case when l % 11 = 0 then 'c0' else 'c' || turn end] from m where role = 'user' and l % 2 = 0),
a as (select conv_id, turn, case when l % 5 = 0 then 'x' || turn when l % 2 = 0 then 'c' || (turn - 1) else 'd' || (turn - 1) end as id, q from m where role = 'assistant'),
f as (select * from c qualify row_number() over (partition by conv_id, id order by turn, pos) = 1),
e as (select distinct t.conv_id, t.src, t.dst from (select conv_id, unnest(after) as src, id as dst from f) t join f on f.conv_id = t.conv_id and f.id = t.src),
r(conv_id, src, dst) as (select * from e union select r.conv_id, r.src, e.dst from r join e on e.conv_id = r.conv_id and e.src = r.dst),
bad as (select conv_id, src as id from r where src = dst union select r.conv_id, r.dst from r join r z on z.conv_id = r.conv_id and z.src = r.src and z.dst = r.src),
g as (select f.conv_id, f.id, f.turn, f.pos from f anti join bad on bad.conv_id = f.conv_id and bad.id = f.id),
p(conv_id, id, level) as (select conv_id, id, 0 from g union select p.conv_id, e.dst, p.level + 1 from p join e on e.conv_id = p.conv_id and e.src = p.id join g on g.conv_id = e.conv_id and g.id = e.dst),
lv as (select conv_id, id, max(level) as level from p group by all),
o as (select g.conv_id, g.id, greatest(g.turn, coalesce(max(s.turn), g.turn)) as ord from g left join r on r.conv_id = g.conv_id and r.dst = g.id left join f s on s.conv_id = r.conv_id and s.id = r.src group by g.conv_id, g.id, g.turn),
k as (select f.conv_id, f.id, f.turn, f.pos, coalesce(o.ord, f.turn) as ord, lv.level, f.id in (select a.id from a where a.conv_id = f.conv_id) as answered
  from f left join o on o.conv_id = f.conv_id and o.id = f.id left join lv on lv.conv_id = f.conv_id and lv.id = f.id),
calls as (select c.conv_id, c.turn, max(k.ord) as ord, max(k.level) as level, count(*) as n_calls, sum(c.valid::int) as n_valid,
    case when not bool_and(c.valid) then 'invalid' when bool_or(k.turn <> c.turn or k.pos <> c.pos) then 'duplicate' when bool_or(k.level is null) then 'cycle' when not bool_and(k.answered) then 'unanswered' else 'calls' end as status,
    string_agg('{"function":{"arguments":' || to_json(c.args)::varchar || ',"name":"' || c.name || '"},"id":"' || c.id || '","type":"function"}', ',' order by c.pos) as made
  from c join k on k.conv_id = c.conv_id and k.id = c.id group by c.conv_id, c.turn)
select conv_id, turn, 'assistant' as role, greatest(ord, turn) as order_turn, coalesce(level, 0)::bigint as order_level, n_calls::bigint as n_calls, n_valid::bigint as n_valid, status,
  '{"content":null,"role":"assistant","tool_calls":[' || made || ']}' as message from calls
union all
select a.conv_id, a.turn, 'tool', greatest(coalesce(k.ord, a.turn), a.turn), coalesce(k.level + 1, 0)::bigint, 0, 0, case when k.id is null then 'orphan' else 'linked' end,
  '{"content":' || a.q || ',"role":"tool","tool_call_id":"' || a.id || '"}' from a left join k on k.conv_id = a.conv_id and k.id = a.id
union all
select conv_id, turn, role, turn, 0, 0, 0, 'plain', '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' from m where role is null or role not in ('user', 'assistant')
"""
