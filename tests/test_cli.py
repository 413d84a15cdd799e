"""The commands, from a log file to root-cause text."""

from dataclasses import replace

import pytest

from kilnlog import profiles
from kilnlog.analysis import Analysis
from kilnlog.cli import main
from kilnlog.config import Analysis as AnalysisSettings
from kilnlog.config import Settings
from kilnlog.operators import export as E
from kilnlog.operators import templates as M
from kilnlog.profiles import Rule
from kilnlog.sources import logs as S


def test_commands(spark, tmp_path):
    t = lambda m, s, x: f"[2024-03-01 10:{m:02d}:{s:06.3f}] {x}\n"
    log = tmp_path / "boot.log"
    log.write_text("".join(t(m, 0, "U-Boot TPL") + t(m, 2 + m, "Starting kernel") + t(m, 9, "RPC: initializing one service") + t(m, 10, "Kernel panic") for m in range(4)) + "acsd: up\n")
    run = lambda *a: main([*a], spark)
    counts = "Anomalies\nseverity  count\n--------  -----\ncritical      4"
    assert run("analyze", str(log), "--output", str(tmp_path / "docs"), "--device-model", "d") == counts
    assert "Kernel Panic" in run("rca", str(tmp_path / "docs")) and "Anomalies: 1" in run("rca", str(tmp_path / "docs"), "--cycle", "2")
    assert run("train-baseline", str(log), "--output", str(tmp_path / "base")) .splitlines()[-1].split() == ["tpl_start->kernel_start", "3.500s", "1.118s"]
    assert run("analyze", str(log), "--baseline", str(tmp_path / "base")) == counts
    assert "4 lines" in run("parse", str(log), "--output", str(tmp_path / "out")) and "Kernel panic" in run("train-templates", str(log))
    assert "| Kernel Start | 4.500s |" in run("report", str(log), "--skip-cycles", "3")
    state = M.read_state(spark, str(tmp_path / "out/state.json"), "saved")
    assert {r["template"]: r["count"] for r in state.collect()} == {r["template"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out/templates")).collect()}


def test_saved_milestones_and_sigma(spark, tmp_path):
    """A baseline brings the milestones that it was trained with; the settings' sigma holds for rules without one."""
    log = tmp_path / "a.log"
    log.write_text("".join(f"[2024-03-01 10:{m:02d}:00.000] U-Boot TPL\n[2024-03-01 10:{m:02d}:{s:02d}.000] mark\n" for m, s in enumerate((10, 11, 12, 10, 14))))
    base = spark.createDataFrame([("tpl_start->mark", 11.0, 1.0, 4)], "pair string, mean double, stddev double, sample_count long")
    E.write_baseline(base, spark.createDataFrame([(1, "tpl_start", "U-Boot TPL", False), (2, "mark", "mark", False)], "order int, name string, pattern string, is_regex boolean"), str(tmp_path / "base"))
    pairs, saved = E.read_baseline(spark, str(tmp_path / "base"))
    rule = Rule("slow", "Slow", "warning", kind="timeout", pair="tpl_start->mark")
    for sigma, n in ((3.5, 0), (2.5, 1), (0.5, 2)):
        analysis = Analysis(replace(profiles.get("bdk"), rules=(rule,)), Settings(analyzer=AnalysisSettings(timeout_sigma=sigma)), (), E.milestones(saved))
        lines = analysis.numbered(S.read_log(spark, str(log)))
        found = analysis.anomalies(lines, pairs).where("rule_id = 'slow'").collect()
        assert len(found) == n and all(r["metadata"]["sigma"] == sigma for r in found)


def test_cycles_without_a_time_are_reported_by_lines(spark, tmp_path):
    log = tmp_path / "b.log"
    log.write_text("".join(f"[2024-03-01 10:0{m}:00.000] U-Boot TPL\n[2024-03-01 10:0{m}:05.000] Starting kernel\n" for m in range(4)) + "U-Boot TPL again\nx\nStarting kernel\n")
    text = main(["report", str(log), "--platform", "bdk"], spark)
    assert "## Cycles without a time" in text and "2 lines" in text.split("## Cycles without a time")[1]


def test_documents_are_resolved(spark, tmp_path):
    (tmp_path / "a.md").write_text("a")
    (tmp_path / "b.md").write_text("b")
    a, b = str(tmp_path / "a.md"), str(tmp_path / "b.md")
    assert [p.split(":")[-1] for p in S.resolve(spark, [b, a, f"{tmp_path}/./b.md", b])] == [b, a]
    with pytest.raises(FileNotFoundError, match="none.md"):
        S.resolve(spark, [a, f"{tmp_path}/none.md"])
    meta = spark.createDataFrame([(a, "by path"), ("other", "no")], "source string, note string")
    assert S.read_documents(spark, a, meta).first()["note"] == "by path" and S.read_documents(spark, b, meta).first()["note"] is None
    before = S.fingerprint(spark, a)
    (tmp_path / "a.md").write_text("longer")
    assert before["size_bytes"] == 1 and S.fingerprint(spark, a) != before and S.fingerprint(spark, f"{tmp_path}/none") == {"path": "", "size_bytes": 0, "mtime_ms": 0}


def test_one_byte_encodings_are_read_by_lines(spark, tmp_path):
    (tmp_path / "l.log").write_bytes("é one\nü two\n".encode("latin-1"))
    (tmp_path / "w.log").write_bytes("é one\nü two\n".encode("utf-16"))
    for name, encoding in (("l", "ISO-8859-1"), ("w", "UTF-16")):
        assert [r["raw"] for r in S.read_log(spark, str(tmp_path / f"{name}.log"), encoding).orderBy("line_no").collect()] == ["é one", "ü two"]
