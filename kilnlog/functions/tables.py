"""Tables for a console."""

from __future__ import annotations

from collections.abc import Iterable


def text_table(title: str, names: list[str], rows: Iterable[Iterable]) -> str:
    """Columns as wide as their longest cell; cells that are numbers stand at the right."""
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    width = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
    number = [bool(cells) and all(c.lstrip("-").replace(".", "", 1).rstrip("s%").isdigit() or c in ("", "N/A") for c in column) for column in zip(*cells, strict=True)] or [False] * len(names)
    line = lambda r: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, width, number, strict=True)).rstrip()
    return "\n".join([title, line(names), "  ".join("-" * w for w in width), *map(line, cells)])
