"""The library's queries over the driver's tables, each with its SQL.

events are read as logs: a stream for each user, anchored at signups; documents as texts, lines and templates; embeddings as vectors.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.functions import lines as L
from kilnlog.functions import text as T
from kilnlog.operators import cycles as C
from kilnlog.operators import detect as D
from kilnlog.operators import export as E
from kilnlog.operators import platforms as P
from kilnlog.operators import report as R
from kilnlog.operators import retrieval as V
from kilnlog.operators import templates as M
from kilnlog.operators import tools as Q
from kilnlog.profiles import Channel, Milestone, Rule
from kilnlog.sources import logs as S

ANCHORS = ("] signup:",)
MILESTONES = tuple(Milestone(n, f"] {n}:", i) for i, n in enumerate(("signup", "view", "click", "purchase"), 1))
PROCESSES = tuple((n, f"] {n}:") for n in ("signup", "view", "click", "purchase", "error"))
RULES = (
    Rule("error_line", "Error line", "critical", pattern="] error:"),
    Rule("new_user", "New user", "info", pattern="] signup:"),
    Rule("buy_or_click", "Buy or click", "warning", pattern=r"\] (purchase|click): user \d*7 ", is_regex=True),
    Rule("slow_view", "Slow view", "warning", kind="timeout", pair="signup->view", sigma=2.0),
    Rule("slow_click", "Slow click", "critical", kind="timeout", pair="view->click", sigma=2.0),
    Rule("no_purchase", "No purchase", "info", kind="sequence", required=("view", "purchase")),
)
CHANNELS = (Channel("browse", ("view", "click")), Channel("money", ("PUR.*", "refund"), True), Channel("fault", ("error",)))
MARKS = (("alpha", ("the ", "tion", "and ")), ("beta", ("der ", "ung", "und ")), ("gamma", ("que ", "les ", "ción")))

queries_: dict = {}
sql_: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        queries_[f.__name__] = f
        if sql is not None:
            sql_[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- events as logs -----------------------------------------------------------

_RAW = "'[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] ' || event_type || ': user ' || user_id || ' ' || coalesce(props, '')"
EV = f"""
ev as (select user_id::varchar as file, row_number() over (partition by user_id order by ts, event_id) - 1 as line_no, event_id, event_type, date_trunc('millisecond', ts) as ts, {_RAW} as raw from events),
ln as (select *, sum((event_type = 'signup')::int) over (partition by file order by line_no) as cycle_id from ev),
lc as (select *, line_no - min(line_no) over (partition by file, cycle_id) as lic from ln),
cy as (select file, cycle_id, min(line_no) as start_line, max(line_no) + 1 as end_line, count(*) as line_count, max(case when event_type = 'signup' then raw end) as anchor_line, arg_min(ts, line_no) as ts_start, arg_max(ts, line_no) as ts_end from ln group by 1, 2
  union all select distinct file, 0::hugeint, 0, 0, 0, null, null::timestamp, null::timestamp from ln l where not exists (select 1 from ln m where m.file = l.file and m.cycle_id = 0))"""
_MS = "(values ('signup', 1), ('view', 2), ('click', 3), ('purchase', 4)) m(milestone, place)"
HITS = f"""{EV},
hits as (select file, cycle_id, milestone, place, min(lic) as line_number, arg_min(ts, lic) as ts, arg_min(raw, lic) as line_content from lc join {_MS} on event_type = milestone group by 1, 2, 3, 4),
dl as (select file, cycle_id, prev || '->' || milestone as pair, (epoch_us(ts) - epoch_us(pts))::double / 1000000.0::double as seconds from (select *, lag(milestone) over w as prev, lag(ts) over w as pts from hits window w as (partition by file, cycle_id order by place)) where pts is not null and ts is not null),
bl as (select pair, avg(seconds) as mean, stddev_pop(seconds) as stddev, (select count(*) from cy) as sample_count from dl group by 1)"""
_RULES = "(values (0, 'error_line', 'Error line', 'critical'), (1, 'new_user', 'New user', 'info'), (2, 'buy_or_click', 'Buy or click', 'warning')) r(pos, rule_id, rule_name, severity)"
ANOM = f"""{HITS},
pa as (select file, cycle_id, rule_id, rule_name, severity, 'pattern' as rule_type, ts as timestamp, lic as line_number, raw as message, 0 as phase, pos from lc join {_RULES}
  on (pos = 0 and contains(raw, '] error:')) or (pos = 1 and contains(raw, '] signup:')) or (pos = 2 and regexp_matches(raw, '\\] (purchase|click): user \\d*7 '))),
ta as (select d.file, d.cycle_id, rule_id, rule_name, severity, 'timeout' as rule_type, null::timestamp as timestamp, 0::bigint as line_number, d.pair, seconds, mean, stddev, 2.0::double as sigma, mean + 2.0::double * stddev as threshold, 1 as phase, pos,
    printf('%s took %.3fs (threshold %.3fs = mean %.3fs + 2.0s x %.3fs)', d.pair, seconds, mean + 2.0::double * stddev, mean, stddev) as message
  from dl d join bl using (pair) join (values (3, 'slow_view', 'Slow view', 'warning', 'signup->view'), (4, 'slow_click', 'Slow click', 'critical', 'view->click')) r(pos, rule_id, rule_name, severity, pair) using (pair) where seconds > mean + 2.0::double * stddev),
sa as (select cy.file, cy.cycle_id, 'no_purchase' as rule_id, 'No purchase' as rule_name, 'info' as severity, 'sequence' as rule_type, null::timestamp as timestamp, 0::bigint as line_number,
  list_filter(['view', 'purchase'], lambda r: not list_contains(coalesce(g, []), r)) as missing, 2 as phase, 5 as pos from cy left join (select file, cycle_id, list(milestone) as g from hits group by 1, 2) h on cy.file = h.file and cy.cycle_id = h.cycle_id),
aa as (select file, cycle_id, rule_id, rule_name, severity, rule_type, timestamp, line_number, message, phase, pos from pa
  union all select file, cycle_id, rule_id, rule_name, severity, rule_type, timestamp, line_number, message, phase, pos from ta
  union all select file, cycle_id, rule_id, rule_name, severity, rule_type, timestamp, line_number, 'Missing milestones: ' || array_to_string(missing, ', '), phase, pos from sa where len(missing) > 0),
ctx as (select file, cycle_id, lic, coalesce(array_to_string(list(raw) over (partition by file, cycle_id order by lic rows between 3 preceding and 1 preceding), chr(10)), '') as context_before,
  coalesce(array_to_string(list(raw) over (partition by file, cycle_id order by lic rows between 1 following and 3 following), chr(10)), '') as context_after from lc)"""


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    raw = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "), "event_type", F.lit(": user "), F.col("user_id").cast("string"), F.lit(" "), F.coalesce("props", F.lit("")))
    return S.from_table(ev, file=F.col("user_id"), order=["ts", "event_id"], raw=raw, coarse=F.to_date("ts"), keep=["event_id"])


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """The lines with their cycles; the numbers are written before the cycles are counted, so that neither prefix sum is computed twice."""
    return C.with_cycle(S.stored(event_lines(spark, d), "numbered"), ANCHORS)


def event_cycles(spark: SparkSession, d: str) -> DataFrame:
    return S.stored(C.in_cycle(numbered_events(spark, d)), "lines")


def _profiled(spark: SparkSession, d: str):
    lines = event_cycles(spark, d)
    cyc, hits = C.cycles(lines), D.milestone_hits(lines, MILESTONES)
    deltas = D.milestone_deltas(hits)
    return lines, cyc, hits, deltas, D.train_baseline(deltas, cyc)


def _anomalies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines, cyc, hits, deltas, base = _profiled(spark, d)
    return D.detect(lines, RULES, cycles=cyc, hits=hits, deltas=deltas, baseline=base), lines


@query("""select doc_id::varchar as file, (i - 1)::bigint as line_no, l[i] as raw
from (select doc_id, string_split(case when ends_with(text, chr(10)) then substr(text, 1, length(text) - 1) else text end, chr(10)) as l from documents where text <> '') t, unnest(range(1, len(l) + 1)) u(i)""")
def scan_lines(spark, d):
    return S.from_texts(_t(spark, d, "documents"), file=F.col("doc_id"), text=F.col("text"))


@query(f"with {EV} select file, line_no, event_id, raw from ev")
def render_events(spark, d):
    return event_lines(spark, d)


@query(f"with {EV} select event_id, ts from ev")
def parse_timestamp(spark, d):
    return event_lines(spark, d).select("event_id", L.timestamp(F.col("raw")).alias("ts"))


@query(f"with {EV} select event_id, regexp_replace(raw, '^\\[[^]]*\\]\\s*', '') as content from ev")
def strip_content(spark, d):
    return event_lines(spark, d).select("event_id", L.content(F.col("raw")).alias("content"))


@query(f"with {EV} select event_id, event_type as module, trim(substr(raw, instr(raw, ': user') + 1)) as rest from ev")
def extract_module(spark, d):
    c = L.content(F.col("raw"))
    return event_lines(spark, d).select("event_id", L.module(c).alias("module"), F.trim(L.after_module(c)).alias("rest"))


@query(f"with {EV} select file, cycle_id::bigint as cycle_id, start_line, end_line, coalesce(anchor_line, '') as anchor_line, ts_start, ts_end, line_count, line_count > 5 as truncated from cy")
def split_cycles(spark, d):
    return C.cycles(S.stored(numbered_events(spark, d), "cycles"), max_cycle_lines=5)


@query(f"with {EV} select file, cycle_id::bigint as cycle_id, line_no, raw from ln")
def cycle_lines(spark, d):
    """The lines of every cycle; C.cycle_lines takes those of one."""
    return event_cycles(spark, d).select("file", "cycle_id", "line_no", "raw")


@query(f"with {HITS} select file, cycle_id::bigint as cycle_id, milestone, line_number, ts, line_content from hits")
def milestone_hits(spark, d):
    return D.milestone_hits(event_cycles(spark, d), MILESTONES).drop("place")


@query(f"with {HITS} select file, cycle_id::bigint as cycle_id, pair, round(seconds, 6) as seconds from dl")
def milestone_deltas(spark, d):
    return D.milestone_deltas(D.milestone_hits(event_cycles(spark, d), MILESTONES)).withColumn("seconds", F.round("seconds", 6))


@query(f"with {HITS} select pair, round(mean, 4) as mean, round(stddev, 4) as stddev, sample_count from bl")
def baseline_train(spark, d):
    base = _profiled(spark, d)[4]
    return base.select("pair", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "sample_count")


@query(f"with {HITS} select cy.file, cy.cycle_id::bigint as cycle_id, milestone from cy, {_MS} where not exists (select 1 from hits h where h.file = cy.file and h.cycle_id = cy.cycle_id and h.milestone = m.milestone)")
def missing_milestones(spark, d):
    _, cyc, hits, _, _ = _profiled(spark, d)
    return D.missing_milestones(cyc, hits, MILESTONES)


@query(f"with {ANOM} select file, cycle_id::bigint as cycle_id, rule_id, severity, round(seconds, 4) as actual, round(threshold, 4) as threshold, message from ta")
def anomaly_timeout(spark, d):
    _, _, _, deltas, base = _profiled(spark, d)
    return D.timeout_anomalies(deltas, base, RULES).select("file", "cycle_id", "rule_id", "severity", F.round("metadata.actual", 4).alias("actual"), F.round("metadata.threshold", 4).alias("threshold"), "message")


@query("""with c as (select conv_id::varchar as file, list_distinct(list(role)) as g from conversations group by 1)
select file, 0::bigint as cycle_id, 'Missing milestones: ' || array_to_string(list_filter(['system', 'user', 'assistant'], lambda r: not list_contains(g, r)), ', ') as message from c where len(list_filter(['system', 'user', 'assistant'], lambda r: not list_contains(g, r))) > 0""")
def anomaly_sequence(spark, d):
    conv = _t(spark, d, "conversations")
    hits = conv.select(F.col("conv_id").cast("string").alias("file"), F.lit(0).cast("long").alias("cycle_id"), F.col("role").alias("milestone"))
    rule = Rule("roles", "Roles", "warning", kind="sequence", required=("system", "user", "assistant"))
    return D.sequence_anomalies(hits.select("file", "cycle_id").distinct(), hits, (rule,)).select("file", "cycle_id", "message")


@query(f"with {ANOM} select file, cycle_id::bigint as cycle_id, rule_id, severity, timestamp, line_number, message from pa")
def anomaly_pattern(spark, d):
    return D.pattern_anomalies(event_cycles(spark, d), RULES).select("file", "cycle_id", "rule_id", "severity", "timestamp", "line_number", "message")


@query(f"with {ANOM} select severity, count(*) as n from aa group by 1")
def severity_counts(spark, d):
    return E.severity_counts(_anomalies(spark, d)[0])


@query(f"with {ANOM} select file, cycle_id::bigint as cycle_id, rule_id, rule_name, severity, rule_type, timestamp, line_number, message, substr(md5(concat_ws('|', file, cycle_id::bigint::varchar, rule_id, line_number::varchar)), 1, 8) as anomaly_id from aa")
def anomalies_all(spark, d):
    return _anomalies(spark, d)[0].select("file", "cycle_id", "rule_id", "rule_name", "severity", "rule_type", "timestamp", "line_number", "message", "anomaly_id")


@query(f"""with {ANOM}
select pa.file, pa.cycle_id::bigint as cycle_id, rule_id, line_number, context_before, context_after from pa join ctx on pa.file = ctx.file and pa.cycle_id = ctx.cycle_id and pa.line_number = ctx.lic""")
def anomaly_context(spark, d):
    lines = event_cycles(spark, d)
    out = D.with_context(D.pattern_anomalies(lines, RULES), lines, 3, 3)
    return out.select("file", "cycle_id", "rule_id", "line_number", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


_CHANNEL = "case when event_type in ('view', 'click') then 'browse' when regexp_full_match(event_type, 'PUR.*|refund', 'i') then 'money' when event_type = 'error' then 'fault' else 'other' end"


@query(f"select event_id, {_CHANNEL} as channel from events")
def demux_route(spark, d):
    return event_lines(spark, d).select("event_id", L.channel(L.module(L.content(F.col("raw"))), CHANNELS))


@query(f"select c.channel, count(e.event_id) as n_lines from (values ('browse'), ('money'), ('fault'), ('other')) c(channel) left join (select event_id, {_CHANNEL} as channel from events) e using (channel) group by 1")
def channel_counts(spark, d):
    names = spark.createDataFrame([(c.name,) for c in CHANNELS] + [("other",)], "channel string")
    counts = event_lines(spark, d).groupBy(L.channel(L.module(L.content(F.col("raw"))), CHANNELS)).agg(F.count(F.lit(1)).alias("_n"))
    return names.join(counts, "channel", "left").select("channel", F.coalesce("_n", F.lit(0)).alias("n_lines"))


def _score(i: int) -> str:
    return " + ".join(f"max(contains(raw, '{m}')::int)" for m in MARKS[i][1])


HEAD_LINES = 50


@query(f"""with l as (select source as file, doc_id, i, l[i] as raw from (select source, doc_id, string_split(case when ends_with(text, chr(10)) then substr(text, 1, length(text) - 1) else text end, chr(10)) as l from documents where text <> '') t, unnest(range(1, len(l) + 1)) u(i)),
h as (select * from l qualify row_number() over (partition by file order by doc_id, i) <= {HEAD_LINES}),
s as (select file, {_score(0)} as a, {_score(1)} as b, {_score(2)} as c from h group by 1)
select file, case when a + b + c = 0 then 'beta' when a >= b and a >= c then 'alpha' when b >= c then 'beta' else 'gamma' end as platform, greatest(a, b, c)::int as score from s""")
def platform_detect(spark, d):
    """Each source's documents as one log; the bound on the lines that are scanned is the feature."""
    return P.detect_platform(_source_lines(_t(spark, d, "documents")), MARKS, default="beta", scan_lines=HEAD_LINES).select("file", "platform", F.col("score").cast("int").alias("score"))


def _source_lines(docs: DataFrame) -> DataFrame:
    ended = F.regexp_replace("text", r"\n\z", "")
    lines = docs.where(F.length("text") > 0).select("source", "doc_id", F.posexplode(F.split(ended, "\n", -1)).alias("at", "raw"))
    return S.from_table(lines, file=F.col("source"), order=["doc_id", "at"], raw=F.col("raw"), coarse=F.floor(F.col("doc_id") / 1000))


@query(f"""with {ANOM} select file, count(*) as total_anomalies, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'info') as info, array_to_string(list_sort(list_distinct(list(cycle_id::bigint))), ',') as affected_cycles from aa group by 1""")
def otel_summary(spark, d):
    n = lambda s: F.coalesce(F.col("by_severity")[s], F.lit(0)).alias(s)
    return E.summary(_anomalies(spark, d)[0]).select("file", "total_anomalies", n("critical"), n("warning"), n("info"), F.array_join(F.col("affected_cycles").cast("array<string>"), ",").alias("affected_cycles"))


@query(f"""with {ANOM} select file, cycle_id::bigint as cycle_id, md5('cycle_' || cycle_id::bigint) as trace_id, row_number() over (partition by file, cycle_id order by phase, line_number, pos) - 1 as place,
  substr(md5(substr(md5(concat_ws('|', file, cycle_id::bigint::varchar, rule_id, line_number::varchar)), 1, 8)), 1, 16) as span_id, 'anomaly.' || rule_id as name, coalesce(epoch_us(timestamp) * 1000, 0)::bigint as nanos, severity from aa""")
def otel_traces(spark, d):
    anomalies, lines = _anomalies(spark, d)
    t = E.traces(D.with_context(anomalies, lines, 3, 3)).select("file", "cycle_id", F.col("traceId").alias("trace_id"), F.posexplode("spans").alias("place", "s"))
    return t.select("file", "cycle_id", "trace_id", F.col("place").cast("long").alias("place"), F.col("s.spanId").alias("span_id"), F.col("s.name").alias("name"), F.col("s.startTimeUnixNano").alias("nanos"), F.col("s.attributes").getField("anomaly.severity").alias("severity"))


_CYCLE_SUM = "select file, cycle_id::bigint as cycle_id, count(*) as anomalies, arg_min(severity, case severity when 'critical' then 0 when 'warning' then 1 else 2 end) as highest from aa group by 1, 2"


@query(f"with {ANOM} {_CYCLE_SUM}")
def rca_cycle_summary(spark, d):
    return E.cycle_summary(_anomalies(spark, d)[0])


# --- boot timing --------------------------------------------------------------

REP = f"""{EV},
fl as (select file, cycle_id, event_type as process, min(lic) as line_offset, arg_min(ts, lic) as ts from lc group by 1, 2, 3),
po as (select fl.file, fl.cycle_id, process, line_offset, (epoch_us(ts) - epoch_us(ts_start))::double / 1000000.0::double as off from fl join cy on fl.file = cy.file and fl.cycle_id = cy.cycle_id),
tot as (select cy.file, cy.cycle_id, coalesce(m, (epoch_us(ts_end) - epoch_us(ts_start))::double / 1000000.0::double, 0.0) as total_seconds, line_count as total_lines from cy left join (select file, cycle_id, max(off) as m from po group by 1, 2) p on cy.file = p.file and cy.cycle_id = p.cycle_id),
ok as (select * from tot where cycle_id >= 2 and total_seconds > 0)"""


def _timing(spark, d):
    lines = event_cycles(spark, d)
    cyc, first = C.cycles(lines), R.first_lines(lines, PROCESSES)
    offsets = R.process_offsets(first, cyc)
    return cyc, first, offsets, R.cycle_totals(cyc, offsets)


@query(f"with {REP} select file, cycle_id::bigint as cycle_id, process, round(off, 6) as off from po")
def process_offsets(spark, d):
    return _timing(spark, d)[2].select("file", "cycle_id", "process", F.round("offset", 6).alias("off"))


@query(f"with {REP} select file, cycle_id::bigint as cycle_id, process, line_offset from fl")
def process_line_offsets(spark, d):
    cyc, first, _, _ = _timing(spark, d)
    return R.process_line_offsets(first, cyc)


@query(f"with {REP} select file, cycle_id::bigint as cycle_id, round(total_seconds, 6) as total_seconds, total_lines from tot")
def cycle_totals(spark, d):
    return _timing(spark, d)[3].withColumn("total_seconds", F.round("total_seconds", 6))


@query(f"with {REP} select (select count(*) from tot) as total_cycles, count(*) as valid_cycles, round(coalesce(avg(total_seconds), 0), 4) as mean, round(coalesce(stddev_pop(total_seconds), 0), 4) as stddev, round(coalesce(min(total_seconds), 0), 4) as min, round(coalesce(max(total_seconds), 0), 4) as max from ok")
def boot_time_summary(spark, d):
    totals = _timing(spark, d)[3]
    out = R.boot_time_summary(totals, R.valid_cycles(totals))
    return out.select("total_cycles", "valid_cycles", *(F.round(c, 4).alias(c) for c in ("mean", "stddev", "min", "max")))


@query(f"""with {REP}, own as (select po.* from po join ok on po.file = ok.file and po.cycle_id = ok.cycle_id)
select p.place, p.process, round(coalesce(avg(off), 0), 4) as mean, round(coalesce(stddev_pop(off), 0), 4) as stddev, round(coalesce(min(off), 0), 4) as min, round(coalesce(max(off), 0), 4) as max, count(off) as hit_count, (select count(*) from ok) as total_cycles,
  round(coalesce(count(off) * 100.0::double / nullif((select count(*) from ok), 0), 0.0), 4) as hit_percent
from (values (0, 'signup'), (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'error')) p(place, process) left join own on p.process = own.process group by 1, 2""")
def process_stats(spark, d):
    _, _, offsets, totals = _timing(spark, d)
    out = R.process_stats(offsets, R.valid_cycles(totals), PROCESSES)
    return out.select("place", "process", *(F.round(c, 4).alias(c) for c in ("mean", "stddev", "min", "max")), "hit_count", "total_cycles", F.round("hit_percent", 4).alias("hit_percent"))


@query(f"with {REP} select tot.file, tot.cycle_id::bigint as cycle_id, round(total_seconds, 6) as total_seconds, " + ", ".join(f"round(max(off) filter (process = '{n}'), 6) as {n}" for n, _ in PROCESSES) + " from tot left join po on tot.file = po.file and tot.cycle_id = po.cycle_id group by 1, 2, 3")
def cycle_timing_pivot(spark, d):
    _, _, offsets, totals = _timing(spark, d)
    return R.timing_pivot(totals, offsets, PROCESSES).select("file", "cycle_id", F.round("total_seconds", 6).alias("total_seconds"), *(F.round(n, 6).alias(n) for n, _ in PROCESSES))


# --- agent tools --------------------------------------------------------------

@query("""with l as (select doc_id, (i - 1)::bigint as line_no, l[i] as raw from (select doc_id, string_split(text, chr(10)) as l from documents where text <> '') t, unnest(range(1, len(l) + 1)) u(i))
select doc_id, line_no, raw from l where contains(lower(raw), 'tion') order by doc_id, line_no limit 50""")
def search_logs(spark, d):
    lines = S.from_texts(_t(spark, d, "documents"), file=F.col("doc_id"), text=F.col("text")).withColumn("doc_id", F.col("file").cast("long"))
    return Q.search(lines, "TION", order=("doc_id", "line_no")).select("doc_id", "line_no", "raw")


@query(f"""with {EV}, c as (select file, cycle_id, max(lic) as m from lc group by 1, 2 order by m desc, file, cycle_id limit 1), own as (select lc.* from lc join c on lc.file = c.file and lc.cycle_id = c.cycle_id)
select lic as line_in_cycle, raw, (select count(*) from own) as total_lines, (select count(*) from own where lic >= 1 and lic < 101) as returned_lines from own where lic >= 1 and lic < 101 order by lic limit 200""")
def tool_context(spark, d):
    lines = event_cycles(spark, d)
    longest = lines.groupBy("file", "cycle_id").agg(F.max("line_in_cycle").alias("_m")).orderBy(F.desc("_m"), "file", "cycle_id").limit(1)
    row = longest.first()
    return Q.context(lines.where(F.col("file") == row["file"]), row["cycle_id"], start=1)


@query(f"with {ANOM} select cycle_id::bigint as cycle_id, rule_id, rule_name, severity, line_number, count(*) over (partition by cycle_id) as anomaly_count from aa")
def tool_anomalies(spark, d):
    spans = S.stored(_anomalies(spark, d)[0].withColumnsRenamed({"phase": "place"}), "spans")
    return Q.anomalies(spans).select("cycle_id", "rule_id", "rule_name", "severity", "line_number", "anomaly_count")


# --- retrieval ----------------------------------------------------------------

_CHUNKS = "select source, row_number() over (partition by source order by s) - 1 as chunk_index, text from (select doc_id::varchar as source, s, substr(text, s + 1, 512) as text from documents, unnest(range(0, length(text), 448)) u(s)) where regexp_matches(text, '\\S')"


@query(f"select source, chunk_index::int as chunk_index, source || ':' || chunk_index as chunk_id, text from ({_CHUNKS})")
def chunk_chars(spark, d):
    return V.chunk_chars(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


@query("""with l as (select doc_id::varchar as source, (i - 1)::bigint as n, l[i] as raw from (select doc_id, string_split(text, chr(10)) as l from documents where text <> '') t, unnest(range(1, len(l) + 1)) u(i)),
w as (select source, unnest(range(greatest(floor((n - 10) / 7.0)::bigint + 1, 0), floor(n / 7.0)::bigint + 1)) as w, n, raw from l),
g as (select source, w, min(n) as start_line, max(n) + 1 as end_line, string_agg(raw, chr(10) order by n) as text from w group by 1, 2)
select source, (row_number() over (partition by source order by w) - 1)::int as chunk_index, start_line, end_line, text from g where regexp_matches(text, '\\S')""")
def chunk_lines(spark, d):
    return V.chunk_lines(S.from_texts(_t(spark, d, "documents"), file=F.col("doc_id"), text=F.col("text")), 10, 3)


_TOK = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
_ASKED = "select item_id as query_id, text from benchmark"
BM = f"""
tok as (select doc_id as id, {_TOK} as w from documents), post as (select id, term, count(*) as tf from (select id, unnest(w) as term from tok) group by 1, 2),
st as (select count(*)::double as n, avg(len(w)) as mean from tok), raw as (select term, ln((n - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from post, st group by term, n),
idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
asked as (select query_id, term, count(*) as q from (select query_id, unnest({_TOK}) as term from ({_ASKED})) group by 1, 2),
sc as (select query_id, post.id, sum(q * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * len(w) / mean))) as score from asked join post using (term) join idf using (term) join tok on tok.id = post.id, st group by 1, 2),
bm as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sc where score > 0)"""


def _corpus(spark, d):
    """All documents, and as queries the whole texts of all benchmark items."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"with {BM} select query_id, id, round(score, 5) as score from bm where rank <= 10")
def bm25_topk(spark, d):
    return V.bm25(*_corpus(spark, d), 10).select("query_id", "id", F.round("score", 5).alias("score"))


@query(f"""with tok as (select doc_id as id, list_distinct({_TOK}) as w from documents), asked as (select query_id, list_distinct({_TOK}) as q from ({_ASKED})),
s as (select query_id, id, len(list_intersect(q, w))::double / len(q) as score from tok, asked), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0)
select query_id, id, round(score, 6) as score, rank::int as rank from r where rank <= 5""")
def overlap_fallback(spark, d):
    return V.overlap(*_corpus(spark, d), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::double * z[2]::double))"


def _vectors(spark, d):
    """All vectors, and as queries those whose id is divisible by 100."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors, vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def _nearest(asked: str) -> str:
    return f"select q.vec_id as query_id, e.vec_id as id, {_DOT} as score, row_number() over (partition by q.vec_id order by {_DOT} desc, e.vec_id) as rank from embeddings e, embeddings q where {asked}"


@query(f"with r as ({_nearest('q.vec_id % 100 = 0')}) select query_id, id, round(score, 6) as score, rank::int as rank from r where rank <= 10")
def vector_topk(spark, d):
    return V.vector_top(*_vectors(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _quantised(width: int = 64, bits: int = 4, seed: int = 0) -> str:
    """SQL of codes and scales: the signed Hadamard matrix as a literal."""
    sign, h = V.signs(width, seed), [[1]]
    while len(h) < width:
        h = [r + r for r in h] + [r + [-x for x in r] for r in h]
    rows = ", ".join("[" + ", ".join(str(int(h[i][j] * sign[j])) for j in range(width)) + "]" for i in range(width))
    levels = (1 << (bits - 1)) - 1
    return f"""
m as (select unnest([{rows}]) as row, unnest(range(0, {width})) as i),
turned as (select vec_id, list(list_sum(list_transform(list_zip(embedding, row), lambda z: z[1]::double * z[2])) / sqrt({width}.0::double) order by i) as x from embeddings, m group by 1),
sc as (select vec_id, x, case when list_max(list_transform(x, lambda v: abs(v))) > 0 then list_max(list_transform(x, lambda v: abs(v))) / {levels} else 1.0 end as scale from turned),
enc as (select vec_id, scale, x, list_transform(x, lambda v: greatest(least(round_even(v / scale, 0), {levels}), -{levels})::int) as codes from sc)"""


@query(f"with {_quantised()} select vec_id as id, array_to_string(codes, ',') as codes, round(scale, 6) as scale from enc")
def quant_encode(spark, d):
    vectors, _ = _vectors(spark, d)
    return V.encode(vectors, width=64).select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.round("scale", 6).alias("scale"))


@query(f"""with {_quantised()}, r as (select q.vec_id as query_id, e.vec_id as id, e.scale * list_sum(list_transform(list_zip(e.codes, q.x), lambda z: z[1] * z[2])) as score from enc e, enc q where q.vec_id % 100 = 0),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from r) select query_id, id, round(score, 5) as score, rank::int as rank from k where rank <= 10""")
def quant_topk(spark, d):
    vectors, asked = _vectors(spark, d)
    return V.quantised_top(V.encode(vectors, width=64), asked, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


# each benchmark item asks with its text and with the vector of its own id; an item without a vector with its text alone
HY = f"""{BM}, vt as ({_nearest('q.vec_id in (select item_id from benchmark)')}),
u as (select query_id, id, 0.5::double / (60 + rank) as s, 0 as side, rank from bm where rank <= 20 union all select query_id, id, 0.5::double / (60 + rank), 1, rank from vt where rank <= 20),
hy as (select query_id, id, sum(s) as score, row_number() over (partition by query_id order by sum(s) desc, min(side * 1000 + rank)) as rank from u group by 1, 2)"""


def _hybrid(spark, d):
    docs, asked = _corpus(spark, d)
    vectors, _ = _vectors(spark, d)
    paired = asked.select("query_id").distinct().join(vectors, F.col("query_id") == F.col("id")).select("query_id", F.col("v").alias("q"))
    return V.fuse(V.lexical(docs, asked, 20), V.vector_top(vectors, paired, 20), 10)


@query(f"with {HY} select query_id, id, round(score, 8) as score, rank::int as rank from hy where rank <= 10")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


@query(f"with {HY} select query_id, hy.id, round(score, 4) as score, rank::int as rank, case when lang = 'en' then 'experience' else 'doc' end as source_type, substr(text, 1, 500) as text from hy join documents d on d.doc_id = hy.id where rank <= 10")
def tool_kb_search(spark, d):
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "en", "experience").alias("source_type"))
    return Q.knowledge(_hybrid(spark, d), chunks)


@query("select min(doc_id) as position, sha256(text) as path from documents where text is not null group by text")
def doc_dedup(spark, d):
    return S.ordered_distinct(_t(spark, d, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("path"), F.col("doc_id").alias("position")))


# --- templates ----------------------------------------------------------------

def _one_log(spark, d):
    """All events as one log, in the order of their ids."""
    return event_lines(spark, d).select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), "raw", F.col("file").alias("user"))


def _mined(spark, d):
    lines = _one_log(spark, d)
    mined = M.mine(lines)
    return lines, mined, M.templates(mined)


_NTOK = "len(list_filter(regexp_split_to_array(replace(replace(replace(regexp_replace(raw, '^\\[[^]]*\\]\\s*', ''), ':', ' '), '=', ' '), '|', ' '), '\\s+'), lambda x: x <> ''))"


def _entity(text: str) -> str:
    """SQL of T.entity."""
    cases = " ".join(f"when contains(lower({text}), '{k}') then '{v}'" for k, v in sorted(T.ENTITIES.items(), key=lambda kv: -len(kv[0])))
    return f"case {cases} else coalesce(nullif(substr(upper(regexp_replace(regexp_extract({text}, '([A-Za-z][A-Za-z0-9_-]*)', 1), '[^A-Za-z0-9]', '', 'g')), 1, 3), ''), 'UNK') end"


def _quote(text: str) -> str:
    """SQL of T.quote."""
    return f"substr(replace(trim(regexp_replace(replace({text}, '<*>', '*'), '\\s+', ' ', 'g')), '\"', chr(39)), 1, 72)"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORDS = f"list_filter(list_transform(list_filter(regexp_extract_all(lower(template), '([A-Za-z][A-Za-z0-9_-]*)', 1), lambda t: t not in ({_STOP})), lambda t: trim(t, '_-')), lambda t: t <> '')"
# every line of a token count and a first word is alike enough for one template, whose wild places are those that have differed
MINED = f"""{EV},
tl as (select event_id as line_no, ts, list_filter(regexp_split_to_array(replace(replace(replace(regexp_replace(raw, '^\\[[^]]*\\]\\s*', ''), ':', ' '), '=', ' '), '|', ' '), '\\s+'), lambda x: x <> '') as t from ev),
tw as (select line_no, len(t) as n, t[1] as head, i, t[i] as w from tl, unnest(range(1, len(t) + 1)) u(i)),
tr as (select *, min(w) over p <> max(w) over p as wild from tw window p as (partition by n, head, i order by line_no)),
tp as (select n, head, string_agg(w, ' ' order by i) as template from (select n, head, i, case when min(w) = max(w) then min(w) else '<*>' end as w from tw group by all) group by all),
tc as (select n, head, count(*) as count, min(line_no) as first_line from tw where i = 1 group by all),
tm as (select row_number() over (order by first_line) as template_id, template, count, first_line, n, head from tp join tc using (n, head)),
tk as (select *, {_WORDS} as ws from tm),
ts_ as (select *, {_entity('template')} as ent, {_quote('template')} as quoted, coalesce(nullif(array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:2], '_'), ''), 'generic') as kw from tk)"""


@query(f"with {EV} select {_NTOK}::int as n_tokens, count(*) as n_lines from ev group by 1")
def template_mining(spark, d):
    return _mined(spark, d)[1].groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"with {MINED} select template_id, template, count from tm")
def template_counts(spark, d):
    return _mined(spark, d)[2].select("template_id", "template", "count")


@query(f"with {MINED} select template_id, template, count from tm order by count desc, template_id limit 20")
def template_topk(spark, d):
    return M.top(_mined(spark, d)[2], 20).select("template_id", "template", "count")


@query(f"""with {MINED} select line_no, template_id, coalesce(string_agg(w, '|' order by i) filter (wild), '') as params from tr join tm using (n, head) group by 1, 2""")
def template_params(spark, d):
    lines, mined, found = _mined(spark, d)
    return M.parsed_lines(lines, mined, found).select("line_no", "template_id", F.array_join("params", "|").alias("params"))


@query(f"with {EV} select event_id as line_no, event_type as module, ts from ev")
def parsed_lines(spark, d):
    lines, mined, found = _mined(spark, d)
    return M.parsed_lines(lines, mined, found).select("line_no", L.module(L.content(F.col("raw"))).alias("module"), L.timestamp(F.col("raw")).alias("ts"))


@query("select strftime(ts, '%Y-%m-%d') as cycle, count(*) as n_lines, count(distinct " + _CHANNEL + ") as n_channels from events group by 1")
def parse_summary(spark, d):
    lines, mined, found = _mined(spark, d)
    own = M.parsed_lines(lines, mined, found).withColumns({"cycle": F.date_format(L.timestamp(F.col("raw")), "yyyy-MM-dd"), "channel": L.channel(L.module(L.content(F.col("raw"))), CHANNELS)})
    return own.groupBy("cycle").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("channel").alias("n_channels"))


@query(f"with {MINED} select cycle, sum(k) over (order by cycle)::bigint as seen from (select tl.ts::date as cycle, count(*) as k from tm join tl on tl.line_no = tm.first_line group by 1)")
def parse_summary_templates(spark, d):
    lines, mined, found = _mined(spark, d)
    firsts = found.join(lines.select(F.col("line_no").alias("first_line"), F.to_date(L.timestamp(F.col("raw"))).alias("cycle")), "first_line")
    return R.running_first_seen(firsts, "cycle")


@query(f"with {MINED} select template_id, count, template, (select count(*) from tm) as total_templates from tm order by count desc, template_id limit 20")
def tool_templates(spark, d):
    return Q.templates(_mined(spark, d)[2], 20)


@query(f"""with {MINED}, best as (select *, row_number() over (order by count desc, template_id desc) as k from ts_ qualify k <= 5)
select 'events' as file, 'TPLSET|fmt=aaak-log-v1|count=' || count(*) || chr(10) || string_agg('TPL|' || ent || '|hit=' || count || '|kw=' || kw || '|"' || quoted || '"', chr(10) order by k) as summary from best""")
def compact_templates(spark, d):
    return M.compact_templates(_mined(spark, d)[2])


@query(f"with {MINED} select template_id, template, count from tm")
def templates_resume(spark, d):
    """Mining in two halves with saved templates between them counts every line once."""
    lines = _one_log(spark, d)
    cut = lines.agg(F.floor(F.avg("line_no"))).first()[0]
    early = M.templates(M.mine(lines.where(F.col("line_no") <= cut)))
    seeds = early.select("file", "template_id", "template", "count")
    late = M.templates(M.mine(lines.where(F.col("line_no") > cut), seeds=seeds), seeds)
    return late.select("template_id", "template", "count")


# --- experiences, documents, streams ------------------------------------------

_SEV = "case severity when 'critical' then 0 when 'warning' then 1 else 2 end"
SPANS = f"""{ANOM},
sp as (select aa.file, aa.cycle_id::bigint as cycle_id, rule_id, rule_name, severity, line_number, message, lpad((row_number() over (partition by aa.file, aa.cycle_id order by phase, line_number, pos))::varchar, 9, '0') as place,
  case when phase = 0 then context_before else '' end as b, case when phase = 0 then context_after else '' end as a from aa left join ctx on aa.file = ctx.file and aa.cycle_id = ctx.cycle_id and aa.line_number = ctx.lic),
sn as (select *, file || ':' || cycle_id || ':' || place as spot, trim(concat_ws(chr(10), nullif(b, ''), nullif(a, '')), ' ' || chr(9) || chr(10) || chr(13)) as snippet from sp),
fi as (select *, file || ':' || place as own, row_number() over (order by {_SEV}, cycle_id, file || ':' || place) as k from sp qualify k <= 10)"""


def _spans(spark, d):
    anomalies, lines = _anomalies(spark, d)
    with_ctx = D.with_context(anomalies, lines, 3, 3)
    order = F.struct("phase", "line_number", "rule_pos")
    return with_ctx.withColumn("place", F.row_number().over(Window.partitionBy("file", "cycle_id").orderBy(order))).withColumns({"before": F.array_join("context_before", "\n"), "after": F.array_join("context_after", "\n")})


def _ordered_spans(spark, d):
    """Spans whose places tell the logs apart too."""
    return _spans(spark, d).withColumn("place", F.concat_ws(":", "file", F.lpad(F.col("place").cast("string"), 9, "0")))


@query(f"with {SPANS} select cycle_id, rule_id, rule_name, severity, line_number, message, own as place from fi")
def experience_findings(spark, d):
    from kilnlog.operators import experience as X

    return X.findings(_ordered_spans(spark, d))


@query(f"""with {MINED}, {SPANS[len(EV) + 2:]}
select * from (select 'template' as kind, template_id::varchar as place, template as text from tm order by count desc, template_id::varchar limit 5)
union all select * from (select 'snippet', spot, snippet from sn where snippet <> '' order by spot limit 3)""")
def experience_evidence(spark, d):
    from kilnlog.operators import experience as X

    spans = _spans(spark, d).withColumn("place", F.concat_ws(":", "file", "cycle_id", F.lpad(F.col("place").cast("string"), 9, "0")))
    return X.evidence(_mined(spark, d)[2].withColumn("template_id", F.col("template_id").cast("string")), spans)


# a message with its quotes made single, as in compact texts
_EXPERIENCE = f"""with {MINED}, {SPANS[len(EV) + 2:]},
fc as (select *, trim(replace(message, '"', chr(39))) as said from fi),
ft as (select *, rule_id || ' ' || said as named from fc),
fl as (select string_agg('F|' || {_entity('named')} || '|sev=' || severity || '|rule=' || rule_id || '|cycle=' || cycle_id || '|line=' || line_number || '|"' || {_quote('said')} || '"', chr(10) order by k) filter (k <= 5) as lines,
  string_agg('{{"cycle_id":' || cycle_id || ',"rule_id":"' || rule_id || '","severity":"' || severity || '","line_number":' || line_number || ',"message":' || to_json(message)::varchar || '}}', ',' order by k) as listed from ft),
tt as (select string_agg('TPL|' || ent || '|kw=' || kw || '|"' || quoted || '"', chr(10) order by count desc, template_id) as lines from (select * from ts_ order by count desc, template_id limit 5)),
hd as (select 'EXP|fmt=aaak-log-v1|plat=events|model=table|anom=' || count(*) || '|sev=' || (select arg_min(severity, {_SEV}) from fi) || '|cycles=' || array_to_string(list_sort(list_distinct(list(cycle_id))), ',') as line from sp),
ex as (select 'events-' || substr(sha256('{{"findings":[' || fl.listed || '],"platform":"events","source_log":"{{\\"path\\":\\"\\"}}"}}'), 1, 16) as experience_id,
  hd.line || chr(10) || fl.lines || chr(10) || tt.lines || chr(10) || 'RCA|ERR|"Errors follow purchases. Views are slow."' as compact from hd, fl, tt)"""


@query(_EXPERIENCE + " select experience_id, compact from ex")
def compact_experience(spark, d):
    return _experience(spark, d).select("experience_id", "compact")


def _experience(spark, d):
    from kilnlog.operators import experience as X

    spans = S.stored(_ordered_spans(spark, d), "spans")
    return X.experience(spark, platform="events", device="table", spans=spans, templates=S.stored(_mined(spark, d)[2], "templates"), analysis="# Events\nErrors follow purchases.\nViews are slow.")


@query(_EXPERIENCE + " select experience_id as source, compact as text from ex")
def experience_docs(spark, d):
    from kilnlog.operators import experience as X

    root = S.scratch(spark, "experiences")
    rows = S.stored(_experience(spark, d), "experience")
    X.write(spark, root, rows)
    X.write(spark, root, rows)  # again: nothing new
    return X.documents(spark, root, "events", prefer_compact=True)


@query(f"with {HITS} select pair, round(mean, 4) as mean, round(stddev, 4) as stddev, sample_count from bl")
def baseline_roundtrip(spark, d):
    path = S.scratch(spark, "baseline")
    named = spark.createDataFrame([(m.order, m.name, m.pattern, m.is_regex) for m in MILESTONES], "order int, name string, pattern string, is_regex boolean")
    E.write_baseline(_profiled(spark, d)[4], named, path)
    pairs, _ = E.read_baseline(spark, path)
    return pairs.select("pair", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "sample_count")


@query(f"""with {ANOM} select aa.cycle_id::bigint as cycle_id, rule_id, rule_name, severity, line_number, message, coalesce(epoch_us(timestamp) * 1000, 0)::bigint as nanos, case when phase = 0 then context_before else '' end as before, case when phase = 0 then context_after else '' end as after
from aa left join ctx on aa.file = ctx.file and aa.cycle_id = ctx.cycle_id and aa.line_number = ctx.lic""")
def otel_roundtrip(spark, d):
    anomalies, lines = _anomalies(spark, d)
    path = S.scratch(spark, "documents")
    E.write_documents(E.documents(S.stored(D.with_context(anomalies, lines, 3, 3), "anomalies")), path)
    return E.exploded(E.read_documents(spark, path)).drop("place")


@contextlib.contextmanager
def _rocks(spark):
    """The state store that streams with state need, for a while."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query(f"with {EV} select file, event_id as seq, line_no, cycle_id::bigint as cycle_id from ln")
def stream_cycles(spark, d):
    from kilnlog.streaming.cycles import stream_cycles as run

    source, out = S.scratch(spark, "stream-in"), S.scratch(spark, "stream-out")
    rows = event_lines(spark, d).select("file", F.col("event_id").alias("seq"), "raw")
    rows.write.parquet(source)
    with _rocks(spark):
        stream = run(spark.readStream.schema(rows.schema).parquet(source), ANCHORS)
        stream.writeStream.format("parquet").option("checkpointLocation", S.scratch(spark, "stream-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("file string, seq long, raw string, line_no long, cycle_id long").parquet(out).select("file", "seq", "line_no", "cycle_id")


@query("select doc_id::varchar as file, sum(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[#$]\\s*$'))))::bigint as n from documents where len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[#$]\\s*$'))) > 0 group by 1")
def stream_prompt(spark, d):
    from kilnlog.streaming.cycles import prompts

    source, out = S.scratch(spark, "prompt-in"), S.scratch(spark, "prompt-out")
    S.from_texts(_t(spark, d, "documents"), file=F.col("doc_id"), text=F.col("text")).write.parquet(source)
    stream = prompts(spark.readStream.schema("file string, line_no long, raw string").parquet(source), r"[#$]\s*$")
    stream.writeStream.format("parquet").option("checkpointLocation", S.scratch(spark, "prompt-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("file string, line_no long, raw string").parquet(out).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


_DURATIONS = [("90", 90), ("10m", 600), ("1h30m", 5400), ("2d", 172800), ("0", None), ("soon", None), ("5x", None)]


@query("select * from (values " + ", ".join(f"('{t}', {'null' if s is None else s}::bigint)" for t, s in _DURATIONS) + ") v(duration, seconds)")
def durations(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _DURATIONS], "duration string").select("duration", T.duration_seconds(F.col("duration")).alias("seconds"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis: cycles, baseline, all anomalies, and the severity of each cycle."""
    return rca_cycle_summary(spark, d)


def queries() -> dict:
    return dict(queries_)


def oracle_sql() -> dict[str, str]:
    return dict(sql_)

