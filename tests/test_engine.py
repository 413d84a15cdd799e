"""The log operators on small logs."""

import json
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from kilnlog import profiles
from kilnlog.config import Settings
from kilnlog.functions import lines as L
from kilnlog.functions import text as T
from kilnlog.operators import cycles as C
from kilnlog.operators import detect as D
from kilnlog.operators import experience as X
from kilnlog.operators import export as E
from kilnlog.operators import platforms as P
from kilnlog.operators import report as R
from kilnlog.operators import retrieval as V
from kilnlog.operators import templates as M
from kilnlog.operators import tools as Q
from kilnlog.profiles import BDK, PRPLOS, Milestone, MinerOptions, Rule
from kilnlog.sources import logs as S
from tests.conftest import SMALL

LOG = ["[2024-03-01 10:00:00.100] early one", "no time here", "[2024-03-01 10:00:01.000] U-Boot TPL 1", "[9999-99-99 10:00:02.000] odd date", "[2024-03-01 10:00:04.500] Starting kernel", "[2024-03-01 10:01:00.000] U-Boot TPL 2", "RPC: done"]


def log(spark, rows, file="f"):
    return spark.createDataFrame([(file, i, r) for i, r in enumerate(rows)], "file string, line_no long, raw string")


def numbered(spark, rows, anchors=("U-Boot TPL",)):
    return C.in_cycle(C.with_cycle(log(spark, rows), anchors))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_cycles(spark):
    rows = C.cycles(numbered(spark, LOG), max_cycle_lines=2).orderBy("cycle_id").collect()
    assert [(r["start_line"], r["end_line"], r["line_count"], r["truncated"]) for r in rows] == [(0, 2, 2, False), (2, 5, 3, True), (5, 7, 2, False)]
    assert rows[1]["anchor_line"] == LOG[2] and rows[1]["ts_start"] == datetime(2024, 3, 1, 10, 0, 1) and rows[1]["ts_end"] == datetime(2024, 3, 1, 10, 0, 4, 500000)
    at_once = C.cycles(numbered(spark, LOG[2:])).orderBy("cycle_id").collect()
    assert [r["line_count"] for r in at_once] == [0, 3, 2]
    empty = C.cycles(numbered(spark, []), files=spark.createDataFrame([("g",)], "file string")).collect()
    assert [(r["file"], r["cycle_id"], r["end_line"]) for r in empty] == [("g", 0, 0)]
    assert C.with_cycle(log(spark, LOG), ("nowhere",), fallback=("Starting kernel",)).agg(F.max("cycle_id")).first()[0] == 1


def test_text_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rthree\n\xff bad\n\nlast")
    (tmp_path / "b.log").write_bytes(b"")
    want = ["one", "two", "three", "\ufffd bad", "", "last"]
    for width in ("128m", "7"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
        got = S.read_log(spark, str(tmp_path / "*.log")).orderBy("line_no").collect()
        assert [r["raw"] for r in got] == want and [r["line_no"] for r in got] == list(range(6))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    latin = S.read_log(spark, str(tmp_path / "a.log"), "iso-8859-1").orderBy("line_no").collect()
    assert latin[3]["raw"] == "ÿ bad"


def test_line_functions(spark):
    assert one(spark, L.content(F.col("x")), x="[2024-03-01 10:00:00.100]  a") == "a"
    for text, want in (("RPC: x", "RPC"), ("wl0: x", "wl0"), ("dhd_x-1 : x", "dhd_x-1"), ("9a: x", None), ("plain", None)):
        assert one(spark, L.module(F.col("x")), x=text) == want
    for name, want in (("wl0", "wifi"), ("dhdpcie0", "dhd"), ("DHD1", "dhd"), ("WL0", "other"), ("pci ", "pcie"), ("NET", "network"), ("xNET", "other")):
        assert one(spark, L.channel(F.col("x"), BDK.channels), x=name) == want
    assert one(spark, L.words(F.col("x")), x="A\u00a0b\u3000C\x1cd  e") == ["a", "b", "c", "d", "e"]
    assert one(spark, L.tokens(F.col("x")), x="a:b=c|d e") == ["a", "b", "c", "d", "e"]


def test_milestones_and_rules(spark):
    ms = (Milestone("a", "A!", 1), Milestone("b", "B!", 2), Milestone("c", r"C\d", 3, True))
    t = lambda s, x: f"[2024-03-01 10:00:{s:06.3f}] {x}"
    lines = numbered(spark, [t(0, "go"), t(1, "go A! C1"), t(9, "A!"), t(3, "C2"), "go", t(20, "A!"), t(5, "B!"), "C1 without time"], ("go",))
    hits = D.milestone_hits(lines, ms)
    assert {(r["cycle_id"], r["milestone"], r["line_number"]) for r in hits.collect()} == {(2, "a", 0), (2, "c", 0), (3, "a", 1), (3, "b", 2), (3, "c", 3)}
    deltas = D.milestone_deltas(hits)
    assert {(r["cycle_id"], r["pair"], r["seconds"]) for r in deltas.collect()} == {(2, "a->c", 0.0), (3, "a->b", -15.0)}
    cyc = C.cycles(lines)
    assert {(r["cycle_id"], r["milestone"]) for r in D.missing_milestones(cyc, hits, ms).collect() if r["cycle_id"]} == {(1, m) for m in "abc"} | {(2, "b")}
    base = spark.createDataFrame([("x->y", 10.0, 1.0, 2)], "pair string, mean double, stddev double, sample_count long")
    long = spark.createDataFrame([("f", 1, "x->y", 15.0), ("f", 2, "x->y", 12.0)], "file string, cycle_id long, pair string, seconds double")
    rule = lambda k: (Rule("slow", "Slow", "warning", kind="timeout", pair="x->y", sigma=k),)
    got = D.timeout_anomalies(long, base, rule(2.0)).collect()
    assert [r["cycle_id"] for r in got] == [1] and got[0]["message"] == "x->y took 15.000s (threshold 12.000s = mean 10.000s + 2.0s x 1.000s)"
    seq = D.sequence_anomalies(cyc, hits, (Rule("s", "S", "info", kind="sequence", required=("a", "b")),)).collect()
    assert {r["cycle_id"]: r["message"] for r in seq}[2] == "Missing milestones: b"
    with pytest.raises(ValueError):
        Rule("x", "X", "fatal")


def test_patterns_and_context(spark):
    rows = [f"line {i}" for i in range(200)]
    rows[100] = "Kernel panic and watchdog does reset"
    lines = numbered(spark, rows)
    found = D.with_context(D.detect(lines), lines, 5, 3).collect()
    assert [r["rule_id"] for r in sorted(found, key=lambda r: r["rule_pos"])] == ["kernel_panic", "watchdog_reset"]
    assert found[0]["context_before"] == rows[95:100] and found[0]["context_after"] == rows[101:104] and found[0]["line_number"] == 100
    alone = numbered(spark, ["segfault"])
    r = D.with_context(D.detect(alone), alone).first()
    assert r["context_before"] == [] and r["context_after"] == []


def test_report(spark):
    t = lambda s, x: f"[2024-03-01 10:00:{s:06.3f}] {x}"
    lines = numbered(spark, [t(0, "U-Boot TPL"), t(5, "Starting kernel"), "Link UP", t(7, "Link UP"), t(15, "acsd: up"), t(16, "end")])
    cyc, first = C.cycles(lines), R.first_lines(lines, BDK.processes)
    off = R.process_offsets(first, cyc)
    assert {(r["process"], r["offset"]) for r in off.collect()} == {("U-Boot TPL", 0.0), ("Kernel Start", 5.0), ("ACS Daemon", 15.0)}
    totals = R.cycle_totals(cyc, off)
    assert totals.where("cycle_id = 1").first()["total_seconds"] == 15.0
    valid = R.valid_cycles(totals, skip=0)
    stats = R.process_stats(off, valid, BDK.processes)
    assert stats.count() == 17 and stats.where("process = 'Kernel Start'").first()["hit_percent"] == 100.0
    text = R.to_markdown(R.boot_time_summary(totals, valid), stats, R.timing_pivot(totals, off, BDK.processes))
    assert "| Kernel Start | 5.000s |" in text and "| 1 | 15.000s |" in text


def test_documents(spark, tmp_path):
    lines = numbered(spark, ["U-Boot TPL", "Kernel panic", "x", "U-Boot TPL", "segfault", "Oops: y"])
    found = D.with_context(D.detect(lines), lines, 1, 1)
    doc = E.as_dict(E.documents(found, device="d"))
    assert doc["summary"] == {"total_anomalies": 3, "by_severity": {"critical": 3}, "affected_cycles": [1, 2]}
    span = doc["traces"][0]["spans"][0]
    assert doc["traces"][0]["traceId"] == __import__("hashlib").md5(b"cycle_1").hexdigest() and len(span["spanId"]) == 16 and span["startTimeUnixNano"] == 0
    assert span["events"][0]["attributes"] == {"log.context_before": "U-Boot TPL", "log.context_after": "x"}
    E.write_documents(E.documents(found), str(tmp_path / "d"))
    spans = E.exploded(E.read_documents(spark, str(tmp_path / "d")))
    assert spans.count() == 3 and Q.anomalies(spans, 2).first()["anomaly_count"] == 2
    assert "Kernel Panic" in E.cycle_report(doc, 1) and "No anomalies" in E.cycle_report(doc, 9)
    assert "Critical: 3" in E.summary_report(doc, datetime(2024, 1, 1))
    mined = M.templates(M.mine(lines))
    exp = X.experience(spark, platform="bdk", device="d", spans=spans, templates=mined, analysis="# h\nshort text")
    assert X.write(spark, str(tmp_path / "x"), exp) and not X.write(spark, str(tmp_path / "x"), exp)
    assert X.documents(spark, str(tmp_path / "x"), "bdk").count() == 1 and X.documents(spark, str(tmp_path / "x"), "prplos").count() == 0
    assert exp.first()["compact"].startswith("EXP|fmt=aaak-log-v1|plat=bdk|model=d|anom=3|sev=critical|cycles=1,2\nF|")
    base = spark.createDataFrame([("a->b", 1.0, 0.5, 3)], "pair string, mean double, stddev double, sample_count long")
    named = spark.createDataFrame([(1, "a", "A", False)], "order int, name string, pattern string, is_regex boolean")
    E.write_baseline(base, named, str(tmp_path / "b"))
    assert E.read_baseline(spark, str(tmp_path / "b"))[0].collect() == base.collect()
    with pytest.raises(RuntimeError):
        E.write_baseline(base.where("false"), named, str(tmp_path / "c"))


def test_templates(spark):
    rows = ["RPC: initializing A1 service", "RPC: initializing B service", "   ", "", "RPC: initializing C service", "other words here"]
    lines = log(spark, rows)
    mined = M.mine(lines)
    found = M.templates(mined)
    best = M.top(found, 1).first()
    assert best["template"] == "RPC initializing <*> service" and best["count"] == 3
    own = {r["line_no"]: r for r in M.parsed_lines(lines, mined, found).collect()}
    assert own[0]["params"] == [] and own[4]["params"] == ["C"] and own[0]["template_id"] == own[4]["template_id"] == 1
    seeds = found.select("file", "template_id", "template", "count").cache()
    again = M.templates(M.mine(log(spark, ["RPC: initializing D service", "brand new line of words"]), seeds=seeds), seeds)
    assert {(r["template"], r["count"]) for r in again.collect()} >= {("RPC initializing <*> service", 4), ("brand new line of words", 1)}
    summary = M.compact_templates(found, 1).first()["summary"]
    assert summary == 'TPLSET|fmt=aaak-log-v1|count=1\nTPL|RPC|hit=3|kw=rpc_initializing|"RPC initializing * service"'


def mined_plainly(lines, options):
    """Drain over one log as published: {line: (cluster, template)}, clusters numbered in each token count; the bound on clusters for each token count."""
    roots, out, made, live = {}, {}, {}, {}
    for at, line in lines:
        words = line
        for d in options.delimiters:
            words = words.replace(d, " ")
        words = words.split()
        n = len(words)
        leading = words[: options.depth - 3] if n > options.depth - 3 else words[:-1]
        node = roots.setdefault(n, {"children": {}, "clusters": []})
        for w in leading:
            node = node and (node["children"].get(w) or node["children"].get("<*>"))
        best, score = None, (-1, -1)
        for c in [c for c in node["clusters"] if c["id"] in live[n]] if node else []:
            same = sum(x == y and x != "<*>" for x, y in zip(c["words"], words)) / n if n else 1.0  # noqa: B905
            if (same, c["words"].count("<*>")) > score:
                best, score = c, (same, c["words"].count("<*>"))
        if best is not None and score[0] >= options.similarity:
            best["words"] = [x if x == y else "<*>" for x, y in zip(best["words"], words)]  # noqa: B905
            live[n][best["id"]] = live[n].pop(best["id"])
        else:
            best = {"id": made.get(n, 0), "words": list(words)}
            made[n] = best["id"] + 1
            node = roots[n]
            for w in leading:
                children = node["children"]
                if w not in children:
                    free = options.max_children - len(children) - ("<*>" not in children)
                    if any(ch.isdigit() for ch in w) or free < 1:
                        w = "<*>"
                    children.setdefault(w, {"children": {}, "clusters": []})
                node = children[w]
            node["clusters"].append(best)
            live.setdefault(n, {})[best["id"]] = best
            if len(live[n]) > options.max_clusters:
                del live[n][min(live[n], key=list(live[n]).index)]
        out[at] = (n, best["id"], " ".join(best["words"]))
    return out


@pytest.mark.parametrize("options", [MinerOptions(), MinerOptions(similarity=0.6, depth=6, max_clusters=40, max_children=5), MinerOptions(depth=3, delimiters=(":",))])
def test_templates_against_a_plain_miner(spark, options):
    import random

    texts = [t for (t,) in duckdb.connect().execute(f"select unnest(string_split(text, chr(10))) from '{SMALL}/documents.parquet' where text is not null order by doc_id").fetchall()]
    r = random.Random(7)
    words = ["link", "up", "down", "eth0", "eth1", "wlan", "9", "12ms", "error:", "state=ok", "a|b", "reset", "cpu"]
    rows = [t for t in texts[:1500] if t] + [" ".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(1500)]
    mined = M.mine(spark.createDataFrame([("f", i, t) for i, t in enumerate(rows)], "file string, line_no long, raw string"), options).collect()
    plain = mined_plainly([(i, re.sub(profiles.TIMESTAMP + r"\s*", "", t)) for i, t in enumerate(rows)], options)
    assert {m["line_no"]: (m["n_tokens"], m["cluster"], m["template_at_parse"]) for m in mined} == plain
    assert len({(n, c) for n, c, _ in plain.values()}) > 200 and any("<*>" in t for _, _, t in plain.values())


def test_compact_functions(spark):
    for text, want in (("wl0 up", "WFI"), ("zebra-x", "ZEB"), ("123", "UNK"), ("ARMTF RPC", "RPC")):
        assert one(spark, T.entity(F.col("x")), x=text) == want
    assert one(spark, T.keywords(F.col("x")), x="the boot _Fan_ error fan Speed x") == "fan_speed" and one(spark, T.keywords(F.col("x")), x="the") == "generic"
    assert one(spark, T.short_summary(F.col("x")), x="# h\n a \n\nb\nc\nd") == "a b c" and one(spark, T.short_summary(F.col("x")), x="# h") == "# h"
    assert one(spark, T.json_state(F.col("x")), x='{"status":"ready"}') == "READY" and T.prompt_regex("x\nroot@a:~# \n") == r"root@a:\~\#\s*$"


def test_retrieval(spark):
    docs = spark.createDataFrame([("d", "x" * 1000), ("e", "   "), ("g", "ab\U0001f600" * 3)], "source string, text string")
    got = V.chunk_chars(docs, 512, 64).collect()
    assert [(r["chunk_id"], len(r["text"])) for r in got if r["source"] == "d"] == [("d:0", 512), ("d:1", 512), ("d:2", 104)] and not [r for r in got if r["source"] == "e"]
    single = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    asked = spark.createDataFrame([(0, "beta gamma"), (1, "none")], "query_id long, text string")
    assert [(r["query_id"], r["score"]) for r in V.lexical(single, asked).collect()] == [(0, 0.5)]
    assert V.lexical(single.where("false"), asked).count() == 0
    import numpy as np

    sign = V.signs(8, 0)
    x = np.arange(24.0).reshape(3, 8)
    assert np.allclose(np.linalg.norm(V.rotate(x, sign), axis=1), np.linalg.norm(x, axis=1))
    codes, scale = V.quantise(np.zeros((1, 8)), 4)
    assert scale[0] == 1.0 and not codes.any()


def test_backends(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, v array<float>")
    for kind in ("exact", "quantised"):
        b = V.backend(v, 4, kind)
        b.save(str(tmp_path / kind))
        assert type(b).load(spark, str(tmp_path / kind)).search([0.0, 0.0, 1.0, 0.1], 2).first()["id"] == 2
    spark.createDataFrame([("quantised", 9, 4, 0)], "backend string, version int, bits int, seed int").write.mode("overwrite").json(str(tmp_path / "quantised/meta"))
    with pytest.raises(ValueError):
        V.QuantisedBackend.load(spark, str(tmp_path / "quantised"))


def test_tools_and_platforms(spark):
    lines = numbered(spark, ["U-Boot TPL", *(f"Row {i}" for i in range(250))])
    assert Q.context(lines, 1).count() == 200 and Q.context(lines, 1).first()["total_lines"] == 251
    assert Q.context(lines, 1, 5).count() == 100 and Q.context(lines, 1, 5, 8).count() == 3 and Q.context(lines, 7).count() == 0
    assert Q.search(lines, "ROW").count() == 50 and Q.search(lines, "row 24", 9).count() == 11
    box = Q.Toolbox()
    box.register("f", {}, lambda a: a + 1)
    answers = iter([[("1", "f", {"a": 1})], "done"])
    assert box.converse(lambda m, s: next(answers), []) == "done" and "error" in box.call("g", {})
    marks = [(p.name, p.detect) for p in profiles.registered()]
    assert P.detect_platform(log(spark, ["procd: - init -", "x"]), marks, default="bdk").first()["platform"] == "prplos"
    assert P.detect_platform(log(spark, ["x"]), marks, default="bdk").first()["platform"] == "bdk"
    assert profiles.get("prplos") is PRPLOS and len(PRPLOS.rules) == 8 and len(BDK.processes) == 17
    with pytest.raises(KeyError):
        profiles.get("none")


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[parser]\nanchors = ["X"]\n[analyzer]\ntimeout_sigma = 2\n')
    s = Settings.load(str(tmp_path / "c.toml"))
    assert s.parser.anchors == ("X",) and s.analyzer.timeout_sigma == 2 and s.retrieval.chunk_size == 512
    (tmp_path / "d.toml").write_text("[parser]\nodd = 1\n")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "d.toml"))


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and json.dumps(sorted(__spark_entry__.queries()))
