"""Column functions for compact summaries, durations, prompts and JSON states."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnlog.functions.lines import WHITE

# Entity codes by keyword, and words that say nothing.
ENTITIES = {
    "wifi": "WFI", "wl0": "WFI", "wl1": "WFI", "wl2": "WFI", "acsd": "WFI", "hostapd": "WFI", "dhd": "DHD", "dhdpcie": "DHD", "rpc": "RPC", "armtf rpc": "RPC",
    "pcie": "PCI", "pci": "PCI", "bcm-pcie": "PCI", "kernel": "KRN", "smcos": "KRN", "sbf": "KRN", "printk": "KRN", "kfence": "KRN",
    "offload": "OFL", "dol0": "OFL", "dol1": "OFL", "dol2": "OFL", "fcache": "OFL", "network": "NET", "br0": "NET", "ipv6": "NET",
}
STOPWORDS = ("a", "an", "and", "boot", "by", "complete", "done", "error", "for", "from", "init", "initialized", "is", "log", "module", "not", "on", "service", "system", "the", "to", "with")
_TOKEN = r"([A-Za-z][A-Za-z0-9_-]*)"


def entity_map(own: dict[str, str] | None = None) -> dict[str, str]:
    extra = {" ".join(k.lower().split()): v.upper() for k, v in (own or {}).items() if k.strip() and v.strip()}
    return ENTITIES | extra


def entity(text: Column, codes: dict[str, str] | None = None) -> Column:
    """The code of the longest keyword in the text (of equal lengths the first listed), else three letters of its first word."""
    low, out = F.lower(text), None
    for key, code in sorted(entity_map(codes).items(), key=lambda kv: -len(kv[0])):
        out = F.when(low.contains(key), code) if out is None else out.when(low.contains(key), code)
    first = F.upper(F.regexp_replace(F.regexp_extract(text, _TOKEN, 1), "[^A-Za-z0-9]", ""))
    return out.otherwise(F.coalesce(F.nullif(F.substring(first, 1, 3), F.lit("")), F.lit("UNK")))


def keywords(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1)), lambda t: ~t.isin(*STOPWORDS))
    bare = F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("_-"))), lambda t: t != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(F.array_distinct(bare), 1, 2), "_"), F.lit("")), F.lit("generic"))


def quote(text: Column, limit: int = 72) -> Column:
    flat = F.btrim(F.regexp_replace(F.replace(text, F.lit("<*>"), F.lit("*")), WHITE, " "))
    return F.substring(F.replace(flat, F.lit('"'), F.lit("'")), 1, limit)


def clean(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit('"'), F.lit("'")))


def short_summary(text: Column) -> Column:
    """The first three lines that are neither blank nor headings, in 500 characters; the text's own start if there is none."""
    rows = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.filter(rows, lambda x: ~x.startswith("#"))
    return F.substring(F.when(F.size(body) > 0, F.array_join(F.slice(body, 1, 3), " ")).otherwise(F.trim(text)), 1, 500)


def duration_seconds(text: Column) -> Column:
    """Of 90, 10m or 1h30m the seconds; null if it is none of these or not above 0."""
    t = F.lower(F.trim(text))
    parts = F.aggregate(F.regexp_extract_all(t, F.lit(r"(\d+[smhd])"), F.lit(1)), F.lit(0).cast("long"), lambda a, p: a + p.substr(F.lit(1), F.length(p) - 1).try_cast("long") * F.element_at(F.create_map(*(F.lit(x) for x in ("s", 1, "m", 60, "h", 3600, "d", 86400))), F.right(p, F.lit(1))))
    out = F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(t.rlike(r"^(\d+[smhd])+$"), parts)
    return F.when(out > 0, out)


def json_state(text: Column, keys: tuple[str, ...] = ("state", "status", "phase")) -> Column:
    """The first of the keys that the JSON object has, in upper case."""
    return F.upper(F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in keys)))


def prompt_regex(screen: str) -> str | None:
    """A pattern for the prompt that a screen ends with; None if it has no text."""
    lines = [x.strip() for x in screen.splitlines() if x.strip()]
    return re.escape(lines[-1]) + r"\s*$" if lines else None
