"""Settings of the command line, read from TOML; the defaults stand here."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Parsing:
    anchors: tuple[str, ...] = ()
    encoding: str = "utf-8"
    max_cycle_lines: int = 100_000
    use_fallback_anchors: bool = False


@dataclass(frozen=True)
class Mining:
    similarity: float = 0.4
    depth: int = 4
    max_clusters: int = 1024
    max_children: int = 100
    compact_summary: bool = False


@dataclass(frozen=True)
class Analysis:
    context_before: int = 50
    context_after: int = 50
    timeout_sigma: float = 3.0


@dataclass(frozen=True)
class Retrieval:
    docs: tuple[str, ...] = ()
    chunk_size: int = 512
    chunk_overlap: int = 64
    backend: str = "exact"
    bits: int = 4
    top_k: int = 5
    index: str = ""


@dataclass(frozen=True)
class Settings:
    parser: Parsing = field(default_factory=Parsing)
    miner: Mining = field(default_factory=Mining)
    analyzer: Analysis = field(default_factory=Analysis)
    retrieval: Retrieval = field(default_factory=Retrieval)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, "rb") as f:
            return _filled(cls, tomllib.load(f), "")


def _filled(kind, values: dict, at: str):
    known = {f.name: f for f in fields(kind)}
    if odd := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(at + k for k in odd))}")
    out = {}
    for k, v in values.items():
        default = known[k].default_factory() if callable(known[k].default_factory) else known[k].default
        if is_dataclass(default):
            out[k] = _filled(type(default), v, f"{k}.")
        else:
            v = tuple(v) if isinstance(default, tuple) else v
            if not isinstance(v, type(default)) and not (isinstance(default, float) and isinstance(v, int)):
                raise ValueError(f"{at}{k} is a {type(default).__name__}")
            out[k] = v
    return kind(**out)
