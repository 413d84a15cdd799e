"""Growing logs: templates kept between batches, prompts with deadlines, a tail."""

import random

import pytest
from pyspark.sql import functions as F

from kilnlog.operators import templates as M
from kilnlog.profiles import MinerOptions
from kilnlog.streaming import tail
from kilnlog.streaming.cycles import wait_for_prompt
from kilnlog.streaming.templates import stream_templates


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def ran(stream, path):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()


def test_streamed_templates_are_the_batch_ones(rocks, tmp_path):
    r = random.Random(2)
    words = ["up", "down", "link", "eth0", "eth1", "error", "9", "reset"]
    rows = [("ab"[i % 2], i, " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for i in range(300)]
    options = MinerOptions(max_clusters=9, max_children=4)
    df = rocks.createDataFrame(rows, "file string, seq long, raw string")
    for n in range(3):
        df.where(f"seq div 100 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ran(stream_templates(stream, options), tmp_path)
    got = {(x["file"], x["seq"]): (x["cluster"], x["template_at_parse"]) for x in rocks.read.parquet(str(tmp_path / "out")).collect()}
    want = {(x["file"], x["line_no"]): (x["cluster"], x["template_at_parse"]) for x in M.mine(df.withColumnRenamed("seq", "line_no"), options).collect()}
    assert got == want and len(got) == 300


def test_deadlines(rocks, tmp_path):
    t = lambda s: f"2024-03-01 10:00:{s:02d}"
    one = [("ok", t(0), "", True), ("ok", t(3), "booting", False), ("mute", t(0), "", True), ("slow", t(0), "", True), ("slow", t(2), "booting", False)]
    two = [("ok", t(7), "root@x:~# ", False), ("mute", t(8), "late", False), ("other", t(9), "x", False)]
    three = [("slow", t(30), "root@x:~# ", False), ("other", t(31), "x", False)]
    four = [("other", t(59), "x", False)]
    for n, rows in enumerate((one, two, three, four)):
        rocks.createDataFrame(rows, "file string, ts string, raw string, is_start boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    schema = "file string, ts timestamp, raw string, is_start boolean"
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ran(wait_for_prompt(stream, r"^root@[^:\n]+:.*# ?$", activity_s=5, ready_s=20), tmp_path)
    got = {x["file"]: (x["outcome"], x["seconds"]) for x in rocks.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"ok": ("ready", 7.0), "mute": ("no activity", 5.0), "slow": ("no prompt", 20.0)}


def test_tail_of_a_growing_file(rocks, tmp_path):
    tail.register(rocks)
    log = tmp_path / "console.log"
    log.write_bytes("één\nhalf".encode())
    read = lambda: rocks.readStream.format("log_tail").option("path", str(log)).option("limit", "2").load()
    step = lambda: read().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
    rows = lambda: sorted((x["seq"], x["raw"]) for x in rocks.read.schema(tail.SCHEMA).parquet(f"{tmp_path}/out").collect())

    def wait(want):
        q = step()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert rows() == want

    wait([(0, "één")])
    with log.open("ab") as f:
        f.write(b" a line\r\n\xff\nthree\n")
    wait([(0, "één"), (1, "half a line"), (2, "�"), (3, "three")])
