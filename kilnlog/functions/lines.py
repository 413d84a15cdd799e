"""Column functions on log lines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnlog.profiles import TIMESTAMP, Channel

MODULE = r"^([A-Za-z][A-Za-z0-9_-]*(?:\d+)?)\s*:"
#: What Python splits at: Java's Unicode white space and the four separators.
WHITE = r"(?U)[\s\x1c-\x1f]+"
SOLID = r"(?U)[^\s\x1c-\x1f]"


def timestamp(raw: Column, pattern: str | None = TIMESTAMP) -> Column:
    """The line's time without zone; null without a pattern, a match, or a valid date."""
    if not pattern:
        return F.lit(None).cast("timestamp_ntz")
    return F.try_to_timestamp(F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz")


def content(raw: Column) -> Column:
    return F.regexp_replace(raw, TIMESTAMP + r"\s*", "")


def module(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, MODULE, 1), F.lit(""))


def after_module(text: Column) -> Column:
    return F.regexp_replace(text, MODULE + r"\s*", "")


def has_any(raw: Column, marks: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (raw.contains(m) for m in marks), F.lit(False))


def matches(raw: Column, pattern: str, is_regex: bool = False) -> Column:
    return raw.rlike(pattern) if is_regex else raw.contains(pattern)


def channel(name: Column, channels: Iterable[Channel]) -> Column:
    """The first channel that has the module; other for none and for null."""
    out = None
    for c in channels:
        fits = name.rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in c.patterns) + r")\z") if c.is_regex else name.isin(*c.patterns)
        out = F.when(fits, c.name) if out is None else out.when(fits, c.name)
    return (F.lit("other") if out is None else out.otherwise("other")).alias("channel")


def words(text: Column) -> Column:
    """Lower-case tokens at white space."""
    return F.filter(F.split(F.lower(text), WHITE), lambda x: x != "")


def tokens(text: Column, delimiters: Iterable[str] = (":", "=", "|")) -> Column:
    for d in delimiters:
        text = F.replace(text, F.lit(d), F.lit(" "))
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))).cast("double") / F.lit(1000000.0)


def epoch_nanos(ts: Column) -> Column:
    return F.coalesce(F.unix_micros(ts.cast("timestamp")) * 1000, F.lit(0).cast("long"))
