"""Defaults of the calls, and how a call's own values take their place."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """One profile of defaults; none of them is written into a plan but as a literal."""

    search_limit: int = 30
    candidate_limit: int = 60
    rrf_k: int = 60
    budget: str = "mid"
    entity_limit: int = 100
    max_files: int = 5_000
    max_bytes: int = 10 << 30
    max_depth: int | None = None
    max_file_size: int | None = None
    exclude: tuple[str, ...] = ("**/.git/**", "**/node_modules/**", "**/.venv/**", "**/__pycache__/**", "**/.cache/**")
    embedding: str = "hashing16"
    route_top_k: int = 12

    @classmethod
    def load(cls, path: str | None = None, **values) -> Settings:
        """The defaults, overridden by a JSON file's fields and then by `values`; unknown fields are an error."""
        found = {}
        if path:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
        found |= values
        if unknown := set(found) - {f.name for f in dataclasses.fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def clamp(limit, default: int) -> int:
    """A limit of one at least; nothing, zero and what is no number give the default."""
    try:
        return max(1, int(limit or default))
    except (TypeError, ValueError):
        return default


def given(value, default, kind=int):
    """The call's value, else the default, as `kind`; none of both is none."""
    value = default if value is None else value
    return None if value is None else kind(value)
