"""Configuration on the driver: source profiles and settings."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from folio.functions.paths import canonical

PREFIX = "FOLIO_"


@dataclass(frozen=True)
class SourceProfile:
    source_key: str
    include_patterns: tuple[str, ...]
    exclude_patterns: tuple[str, ...]

    def __post_init__(self):
        if not self.source_key.strip() or not self.include_patterns:
            raise ValueError("a profile has a key and includes something")
        for pattern in (*self.include_patterns, *self.exclude_patterns):
            if canonical(pattern) != pattern:
                raise ValueError("a pattern is a canonical path")


def load_profile(path: str) -> SourceProfile:
    """A profile from UTF-8 JSON with exactly its three keys, of exactly their types."""
    with open(path, "rb") as f:
        root = json.loads(f.read().decode("utf-8"))
    if type(root) is not dict or root.keys() != {x.name for x in fields(SourceProfile)} or type(root["source_key"]) is not str:
        raise ValueError("a profile holds a key and two lists of patterns")
    lists = [root["include_patterns"], root["exclude_patterns"]]
    if any(type(x) is not list or any(type(p) is not str for p in x) for x in lists):
        raise ValueError("patterns are lists of strings")
    return SourceProfile(root["source_key"], *map(tuple, lists))


@dataclass(frozen=True)
class Settings:
    """Search and embedding settings; each is read from ``FOLIO_`` and its name in capitals."""

    embedding_dimension: int = 1024
    embedding_batch: int = 32
    keyword_candidates: int = 50
    vector_candidates: int = 50
    rrf_k: int = 60
    rrf_keyword_weight: float = 1.0
    rrf_vector_weight: float = 1.0
    result_limit: int = 5
    max_result_limit: int = 20
    parent_context_max_tokens: int = 1200
    query_instruction: str = "{query}"

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (int, float)) and not (math.isfinite(value) and value > 0):
                raise ValueError(f"{f.name} is positive")
        if not self.embedding_batch <= 256 or not self.result_limit <= self.max_result_limit <= 20:
            raise ValueError("a batch has at most 256 texts, a result at most 20 items")
        if self.query_instruction.count("{query}") != 1:
            raise ValueError("the instruction holds {query} once")


def load_settings(environment: Mapping[str, str] = os.environ) -> Settings:
    """Settings from the environment; an unknown name with the prefix is an error."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    given = {}
    for name, text in environment.items():
        if name.startswith(PREFIX):
            key = name.removeprefix(PREFIX).lower()
            if key not in kinds:
                raise ValueError(f"{name} is no setting")
            given[key] = kinds[key](text)
    return Settings(**given)
