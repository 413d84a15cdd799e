"""Sessions over an analysed log: tools, prompt views, knowledge and experiences."""

import json

import pytest

from kilnlog import agent as A
from kilnlog.cli import main
from kilnlog.operators import export as E


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("agent")
    t = lambda m, s, x: f"[2024-03-01 10:{m:02d}:{s:06.3f}] {x}\n"
    log = root / "boot.log"
    log.write_text("".join(t(m, 0, "U-Boot TPL") + t(m, 2 + m, "Starting kernel") + t(m, 9, "RPC: initializing one service") + t(m, 10, "Kernel panic") for m in range(3)))
    (root / "watchdog.md").write_text("The watchdog resets the board when the kernel hangs.")
    (root / "radio.md").write_text("Radio calibration takes two seconds.")
    main(["analyze", str(log), "--output", str(root / "docs"), "--device-model", "d"], spark)
    main(["parse", str(log), "--output", str(root / "out")], spark)
    main(["train-baseline", str(log), "--output", str(root / "base")], spark)
    return root


def test_tools_and_prompt(spark, place):
    from argparse import Namespace

    from kilnlog.cli import _numbered
    from kilnlog.config import Settings

    lines = _numbered(spark, Namespace(platform="bdk", anchors=None), Settings(), str(place / "boot.log"))[1]
    s = A.Session(E.read_json(spark, str(place / "docs")), spark.read.parquet(str(place / "out/templates")), E.read_baseline(spark, str(place / "base"))[0], lines)
    assert s.cycles() == [1, 2, 3] and s.get_anomalies()["total"] == 3 and s.get_anomalies(2)["anomalies"][0]["cycle_id"] == 2 and s.get_anomalies(9)["total"] == 0
    assert s.get_cycle_context(1, 1, 3)["lines"][0].endswith("Starting kernel") and "error" in s.get_cycle_context(9)
    assert s.get_baseline()["mean_deltas"] == {"tpl_start->kernel_start": 3.0} and s.get_templates(1)["templates"][0]["count"] == 3
    assert s.search_logs("PANIC", 2)["total_matches"] == 1 and "error" in s.search_knowledge_base("x")
    lines_ = iter(["help", "cycles", "anomalies", "anomalies 2", "anomalies 9", "anomalies x", "report 1", "templates", "baseline", "odd", "", "quit", "cycles"])
    said = list(s.chat(lambda: next(lines_)))
    assert len(said) == 11 and said[1] == "1, 2, 3" and said[2] == "3 anomalies\ncritical: 3" and said[3].startswith("[critical]") and said[4] == "no anomalies in cycle 9" and said[5] == "x is no cycle"
    assert "Cycle 1" in said[6] and "templates" in said[7] and "tpl_start->kernel_start: 3.000s" in said[8] and "unknown" in said[9]


def test_model_and_experience(spark, place, tmp_path):
    seen = []

    def ask(messages, schemas):
        if messages[-1]["role"] == "user":
            assert "search_knowledge_base" in schemas
            return [("1", "search_knowledge_base", {"query": "watchdog resets", "top_k": 2}), ("2", "get_anomalies", {"cycle_id": 1}), ("3", "search_logs", {"odd": 1})]
        seen.extend(m["content"] for m in messages if m["role"] == "tool")
        return "The watchdog did it."

    a = ["agent-analyze", "--anomalies", str(place / "docs"), "--templates", str(place / "out/templates"), "--logfile", str(place / "boot.log"), "--platform", "bdk", "--docs", str(place / "watchdog.md"), str(place / "radio.md"), str(place / "radio.md"), "--store", str(tmp_path)]
    assert main(a, spark, ask) == "The watchdog did it."
    hits = json.loads(seen[0])["results"]
    assert [h["source_type"] for h in hits] == ["doc"] and "watchdog" in hits[0]["text"] and json.loads(seen[1])["total"] == 1 and "error" in seen[2]
    # the experience was stored and is found now; the same analysis again is nothing new
    k = A.build_knowledge(spark, f"{tmp_path}/index/bdk", platform="bdk")
    assert "experience" in {r["source_type"] for r in k.search("watchdog did it", 5).collect()}
    before = spark.read.parquet(f"{tmp_path}/experiences").count()
    main(a, spark, ask)
    assert before == spark.read.parquet(f"{tmp_path}/experiences").count() == 1
    assert A.build_knowledge(spark, str(tmp_path / "none")) is None


def test_the_model_s_message_goes_back(spark, place):
    from kilnlog.operators.tools import Toolbox

    box, seen = Toolbox(2), []
    box.register("add", {"type": "object"}, lambda a, b: a + b)

    def ask(messages, schemas):
        seen.append(messages)
        return f"round {len(seen)}", [(str(len(seen)), "add", {"a": 1, "b": 2})]

    assert box.converse(ask, [{"role": "user", "content": "go"}]) == "round 2"  # the last text after the last round
    call = {"id": "1", "type": "function", "function": {"name": "add", "arguments": '{"a": 1, "b": 2}'}}
    assert seen[1] == [{"role": "user", "content": "go"}, {"role": "assistant", "content": "round 1", "tool_calls": [call]}, {"role": "tool", "tool_call_id": "1", "content": 3}]
    assert box.converse(lambda m, s: "done", []) == "done" and Toolbox(1).converse(lambda m, s: [("1", "none", {})], []) == ""


def test_chat_client(spark, place):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    bodies = []

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            bodies.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            calls = [{"id": "c1", "type": "function", "function": {"name": "get_anomalies", "arguments": '{"cycle_id": 2}'}}]
            message = {"role": "assistant", "content": "The kernel panics."} if len(bodies) > 1 else {"role": "assistant", "content": None, "tool_calls": calls}
            reply = json.dumps({"choices": [{"message": message}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        text = main(["agent-analyze", "--anomalies", str(place / "docs"), "--with-model", "--model", "m", "--api-base", f"http://127.0.0.1:{server.server_port}/v1", "--api-key", "k"], spark)
    finally:
        server.shutdown()
    assert text == "The kernel panics." and len(bodies) == 2
    path, key, body = bodies[1]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["model"] == "m" and body["tool_choice"] == "auto"
    assert [m["role"] for m in body["messages"]] == ["system", "user", "assistant", "tool"] and json.loads(body["messages"][3]["content"])["total"] == 1


def test_backends_in_turn(spark, tmp_path):
    from kilnlog.operators import retrieval as V

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    assert isinstance(V.first_backend(v, 2), V.QuantisedBackend) and V.first_backend(v, 2, "none") is None
    assert V.first_backend(v.withColumn("v", v["id"]), 2) is None  # no vectors: neither can serve them
    V.ExactBackend(v).save(str(tmp_path / "exact"))
    assert isinstance(V.load_backend(spark, str(tmp_path)), V.ExactBackend) and V.load_backend(spark, str(tmp_path / "none")) is None
    V.QuantisedBackend.build(v, 2).save(str(tmp_path / "quantised"))
    assert isinstance(V.load_backend(spark, str(tmp_path)), V.QuantisedBackend)


def test_encoder_and_chunks_as_functions(spark):
    from pyspark.sql import functions as F

    from kilnlog.operators import retrieval as V

    keys = ["radio", "kernel"]
    encode = V.unit(lambda texts: [[float(3 * t.count(k)) for k in keys] for t in texts])
    got = spark.createDataFrame([("radio kernel",), ("none",), (None,)], "text string").select(encode("text").alias("v")).collect()
    assert [round(x, 4) for x in got[0]["v"]] == [0.7071, 0.7071] and list(got[1]["v"]) == list(got[2]["v"]) == [0.0, 0.0]
    V.register(spark)
    docs = spark.createDataFrame([("a", "x" * 30 + " " * 40 + "tail"), ("b", "  ")], "source string, text string")
    docs.createOrReplaceTempView("texts")
    rows = spark.sql("select source, c.* from texts, lateral chunk_text(source, text, 16, 4) c")
    own = V.chunk_chars(docs, 16, 4).select("source", "chunk_index", "chunk_id", "text")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, own.collect())) and own.where(F.col("source") == "b").count() == 0


def test_rules_without_model(spark, place):
    assert "Anomalies: 3" in main(["agent-analyze", "--anomalies", str(place / "docs")], spark)
    answers = iter(["cycles", "exit"])
    assert main(["agent-chat", "--anomalies", str(place / "docs")], spark, read=lambda: next(answers)) == "1, 2, 3"
    with pytest.raises(ValueError):
        A.Session(spark.createDataFrame([], "document string")).analyse()


def test_fused_knowledge(spark, place, tmp_path):
    from pyspark.sql import functions as F

    v = F.array(F.when(F.col("text").contains("Radio"), 1.0).otherwise(0.0), F.when(F.col("text").contains("watchdog"), 1.0).otherwise(0.0))
    for kind in ("exact", "quantised"):
        k = A.build_knowledge(spark, str(tmp_path / kind), documents=[str(place / "watchdog.md"), str(place / "radio.md")], backend=kind, encode=lambda df: df.withColumn("v", v.cast("array<float>")), encode_one=lambda t: [1.0, 0.1])
        rows = k.search("unheard of", 2).collect()
        assert len(rows) == 2 and "Radio" in rows[0]["text"]
