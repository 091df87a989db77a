"""Settings: defaults, and what a TOML file says instead."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Search:
    top_k: int = 12
    lexical_weight: float = 0.55
    dense_weight: float = 0.35
    freshness_weight: float = 0.10


@dataclass(frozen=True)
class Index:
    chunk_chars_cjk: int = 900
    chunk_chars_latin: int = 2400
    overlap_ratio: float = 0.12


@dataclass(frozen=True)
class Settings:
    search: Search = field(default_factory=Search)
    index: Index = field(default_factory=Index)


def load(path: str | None = None, variable: str = "DOCLOOM_SETTINGS") -> Settings:
    """A file that is named, by argument or by the environment, has to exist; unknown sections and keys are refused."""
    path = path or os.environ.get(variable)
    if path is None:
        return Settings()
    with open(path, "rb") as f:
        said = tomllib.load(f)
    made = {}
    for part in fields(Settings):
        kind, values = part.default_factory, said.pop(part.name, {})
        if unknown := set(values) - {x.name for x in fields(kind)}:
            raise ValueError(f"[{part.name}] has unknown keys: {', '.join(sorted(unknown))}")
        made[part.name] = kind(**values)
    if said:
        raise ValueError(f"unknown sections: {', '.join(sorted(said))}")
    return Settings(**made)
