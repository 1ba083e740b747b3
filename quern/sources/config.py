"""Settings from a TOML file; credentials come from the environment alone."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_chunk_size: int = 1000
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    vector_size: int = 300
    tfidf_weighting: bool = True
    use_preprocessing: bool = False
    top_k: int = 5
    bm25_candidates: int = 50
    online_top_k: int = 3
    model: str = ""

    def with_model(self, model: str) -> Settings:
        return replace(self, model=model)


def load(path: str) -> Settings:
    """The settings of all sections of the file; unknown names are left out, a chunk size of 0 is the default."""
    with open(path, "rb") as f:
        tree = tomllib.load(f)
    known = {f.name for f in fields(Settings)}
    found = {k: v for part in tree.values() if isinstance(part, dict) for k, v in part.items() if k in known}
    if not found.get("max_chunk_size", 1):
        del found["max_chunk_size"]
    return Settings(**found)


def api_key(name: str = "ANSWER_API_KEY") -> str | None:
    return os.environ.get(name)
