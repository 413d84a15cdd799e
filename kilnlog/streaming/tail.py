"""A growing text file as a stream of lines."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file string, seq long, raw string"


class TailReader(SimpleDataSourceStreamReader):
    """Offsets are bytes of the file and the lines before them; a line counts when its end is written.

    It runs on the driver, for logs that are written there, such as a console's; a file that got shorter is read from its beginning.
    """

    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def initialOffset(self) -> dict:
        return {"bytes": 0, "lines": 0}

    def _lines(self, start: dict, stop: int | None):
        at, n = start["bytes"], start["lines"]
        if not os.path.exists(self.path):
            return [], start
        if os.path.getsize(self.path) < at:
            at = 0
        out = []
        with open(self.path, "rb") as f:
            f.seek(at)
            while (stop is None and len(out) < self.limit) or (stop is not None and at < stop):
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                at += len(line)
                out.append((self.path, n, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                n += 1
        return out, {"bytes": at, "lines": n}

    def read(self, start: dict):
        rows, end = self._lines(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._lines(start, end["bytes"])[0])


class TailSource(DataSource):
    """Format log_tail, with the options path and limit, the most lines of a batch."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("limit", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
