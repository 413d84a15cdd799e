"""A platform's way through a log: numbering, milestones, detection, routing and timing, with one place for its settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog import profiles
from kilnlog.config import Settings
from kilnlog.functions.lines import channel, content, module
from kilnlog.operators import cycles as C
from kilnlog.operators import detect as D
from kilnlog.operators import platforms as P
from kilnlog.operators import report as R
from kilnlog.operators import templates as M
from kilnlog.sources import logs as S

DEFAULT_PLATFORM = "bdk"


@dataclass(frozen=True)
class Analysis:
    """What a profile and the settings say together; anchors and milestones given here come before the profile's."""

    profile: profiles.Profile
    settings: Settings = field(default_factory=Settings)
    anchors: tuple[str, ...] = ()
    milestones: tuple[profiles.Milestone, ...] = ()

    @classmethod
    def from_platform(cls, name: str, settings: Settings | None = None, **own) -> Analysis:
        return cls(profiles.get(name), settings or Settings(), **own)

    @classmethod
    def of_log(cls, lines: DataFrame, settings: Settings | None = None, **own) -> Analysis:
        """Of the platform whose marks the first lines of the log hold."""
        found = P.detect_platform(lines, [(p.name, p.detect) for p in profiles.registered()], default=DEFAULT_PLATFORM).groupBy("platform").agg(F.sum("score").alias("s")).orderBy(F.desc("s"), "platform").first()
        return cls.from_platform(found["platform"] if found else DEFAULT_PLATFORM, settings, **own)

    def numbered(self, lines: DataFrame) -> DataFrame:
        parser = self.settings.parser
        fallback = self.profile.fallback_anchors if parser.use_fallback_anchors else ()
        anchors = self.anchors or parser.anchors or self.profile.anchors
        return S.stored(C.in_cycle(C.with_cycle(lines, anchors, fallback=fallback, timestamp_pattern=self.profile.timestamp)), "lines")

    def cycles(self, numbered: DataFrame) -> DataFrame:
        return C.cycles(numbered, max_cycle_lines=self.settings.parser.max_cycle_lines)

    def channel(self) -> Column:
        """The channel of a line."""
        return channel(module(content(F.col("raw"))), self.profile.channels)

    def miner(self) -> profiles.MinerOptions:
        m = self.settings.miner
        return profiles.MinerOptions(m.similarity, m.depth, m.max_clusters, m.max_children, self.profile.miner.delimiters)

    def mined(self, lines: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
        return M.mine(lines, self.miner(), seeds)

    def hits(self, numbered: DataFrame) -> DataFrame:
        return D.milestone_hits(numbered, self.milestones or self.profile.milestones)

    def baseline(self, numbered: DataFrame) -> DataFrame:
        return D.train_baseline(D.milestone_deltas(self.hits(numbered)), self.cycles(numbered))

    def anomalies(self, numbered: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        """All anomalies with the lines around them."""
        hits, own = self.hits(numbered), self.settings.analyzer
        found = D.detect(numbered, (*profiles.BASE_RULES, *self.profile.rules), cycles=self.cycles(numbered), hits=hits, deltas=D.milestone_deltas(hits), baseline=baseline, sigma=own.timeout_sigma)
        return D.with_context(found, numbered, own.context_before, own.context_after)

    def timing(self, numbered: DataFrame, skip: int = 2) -> dict[str, DataFrame]:
        """summary, stats and pivot of the boot times, or of line numbers where the platform has no time; untimed: the line numbers of cycles without a time on a platform that has time."""
        cyc, first = self.cycles(numbered), R.first_lines(numbered, self.profile.processes)
        timed, value = self.profile.has_time, "offset" if self.profile.has_time else "line_offset"
        seconds = R.process_offsets(first, cyc)
        offsets = seconds if timed else R.process_line_offsets(first, cyc)
        totals = R.cycle_totals(cyc, seconds)
        valid = R.valid_cycles(totals, skip=skip, has_time=timed)
        pivot = lambda df, v: R.timing_pivot(totals, df, self.profile.processes, value=v)
        lines = R.process_line_offsets(first, cyc, has_time=True)
        untimed = R.timing_pivot(totals.join(lines.select(*D.KEY).distinct(), D.KEY, "left_semi"), lines, self.profile.processes, value="line_offset")
        return {"summary": R.boot_time_summary(totals, valid), "stats": R.process_stats(offsets, valid, self.profile.processes, value), "pivot": pivot(offsets, value), "untimed": untimed if timed else untimed.limit(0)}


def read(spark: SparkSession, path: str, settings: Settings, platform: str = "auto", anchors: tuple[str, ...] = ()) -> tuple[Analysis, DataFrame]:
    """The analysis for a log file, and its lines."""
    lines = S.read_log(spark, path, settings.parser.encoding)
    own = {"anchors": tuple(anchors)}
    return Analysis.of_log(lines, settings, **own) if platform == "auto" else Analysis.from_platform(platform, settings, **own), lines
