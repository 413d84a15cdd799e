"""Cycles and prompts over growing logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from kilnlog.functions.lines import has_any

OUT = "file string, seq long, raw string, line_no long, cycle_id long"


class CycleProcessor(StatefulProcessor):
    """Keeps the numbers of the lines and cycles of each stream so far; lines of a batch are taken in the order of seq.

    Input must be appended in order: a line that comes after later ones were written is numbered behind them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("at", StructType([StructField("lines", LongType()), StructField("cycle", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        lines, cycle = self.state.get() if self.state.exists() else (0, 0)
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        numbers = lines + pd.Series(range(len(pdf)), dtype="int64")
        ids = cycle + pdf["is_anchor"].astype("int64").cumsum()
        self.state.update((int(lines + len(pdf)), int(ids.iloc[-1])))
        yield pd.DataFrame({"file": key[0], "seq": pdf["seq"].to_numpy(), "raw": pdf["raw"].to_numpy(), "line_no": numbers.to_numpy(), "cycle_id": ids.to_numpy()})

    def close(self) -> None:
        pass


def stream_cycles(lines: DataFrame, anchors: Iterable[str]) -> DataFrame:
    """A stream (file, seq, raw, line_no, cycle_id) of a stream (file, seq, raw); needs the RocksDB state store."""
    marked = lines.withColumn("is_anchor", has_any(F.col("raw"), anchors))
    return marked.groupBy("file").transformWithStateInPandas(CycleProcessor(), OUT, "Append", "None")


class ReadyProcessor(StatefulProcessor):
    """Waits for a prompt after each start of a stream, with a deadline for any line and one for the prompt.

    Times are event times: a deadline has passed when the watermark has.
    """

    def __init__(self, pattern: str, activity_s: float, ready_s: float) -> None:
        self.pattern, self.activity_ms, self.ready_ms = pattern, int(activity_s * 1000), int(ready_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", StructType([StructField("began", LongType()), StructField("lines", LongType())]))

    def _rows(self, key, found: list[tuple[str, int, int]]) -> pd.DataFrame:
        """Of outcomes with the times of their start and end."""
        kinds = {"file": object, "outcome": object, "began_ms": "int64", "seconds": "float64"}
        return pd.DataFrame([(key[0], outcome, began, (at - began) / 1000) for outcome, began, at in found], columns=list(kinds)).astype(kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        import re

        prompt, found = re.compile(self.pattern, re.MULTILINE), []
        for at, raw, starts in pd.concat(list(rows)).sort_values("ms", kind="stable")[["ms", "raw", "is_start"]].itertuples(index=False):
            at = int(at)
            if starts:
                self._end()
                self.state.update((at, 0))
                self.handle.registerTimer(at + self.activity_ms)
                self.handle.registerTimer(at + self.ready_ms)
            elif self.state.exists():
                began, lines = self.state.get()
                if at >= began + self.ready_ms or (not lines and at >= began + self.activity_ms):
                    continue  # too late; the timer tells
                self.state.update((began, lines + 1))
                if prompt.search(raw or ""):
                    found.append(("ready", began, at))
                    self._end()
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        if self.state.exists():
            began, lines = self.state.get()
            outcome = "no prompt" if at == began + self.ready_ms else "no activity" if at == began + self.activity_ms and not lines else None
            if outcome:
                self._end()
                yield self._rows(key, [(outcome, began, at)])

    def _end(self) -> None:
        if self.state.exists():
            began, _ = self.state.get()
            for t in (began + self.activity_ms, began + self.ready_ms):
                self.handle.deleteTimer(t)
            self.state.clear()

    def close(self) -> None:
        pass


def wait_for_prompt(events: DataFrame, pattern: str, *, activity_s: float = 60.0, ready_s: float = 240.0, late: str = "0 seconds") -> DataFrame:
    """(file, outcome, began_ms, seconds) of each start in a stream (file, ts, raw, is_start): "ready" with the time that it took, "no activity" or "no prompt".

    ts is a timestamp; a start row begins the wait, other rows are lines of output.  late is how long rows may come out of order.
    """
    rows = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("file").transformWithStateInPandas(ReadyProcessor(pattern, activity_s, ready_s), "file string, outcome string, began_ms long, seconds double", "Append", "EventTime")


def prompts(lines: DataFrame, pattern: str) -> DataFrame:
    """The lines of a stream or table that a trigger pattern matches; lines, not byte offsets, mark how far was read."""
    return lines.where(F.col("raw").rlike(pattern))
