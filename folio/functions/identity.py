"""Content-addressed identities: canonical JSON and SHA-256, as plain functions and as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKER_VERSION = "parent-child-v1"


def canonical_json(value) -> bytes:
    """UTF-8 JSON with sorted keys, no spaces and literal non-ASCII."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def config_hash(value) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def content_hash(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def chunk_hash(**coordinates) -> str:
    """The identity of a chunk: parser, chunk configuration, heading path, lines, raw and search text."""
    names = {"parser_version", "chunk_config_hash", "heading_path", "line_start", "line_end", "raw_text", "search_text"}
    if coordinates.keys() != names:
        raise ValueError("a chunk has exactly seven coordinates")
    return config_hash(coordinates)


def canonical_json_column(**columns: Column) -> Column:
    """Canonical JSON of named columns; nulls are written. Control characters get lower-case escapes."""
    text = F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return text


def config_hash_column(**columns: Column) -> Column:
    return F.sha2(canonical_json_column(**columns), 256)


def content_hash_column(text: Column) -> Column:
    """Of a string's UTF-8 bytes or of binary."""
    return F.sha2(text.cast("binary"), 256)
