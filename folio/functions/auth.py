"""Tokens and query digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_hmac(rows: DataFrame, text: str, key: bytes, name: str = "query_hmac") -> DataFrame:
    """``rows`` with the HMAC-SHA256 of a string column's exact UTF-8 bytes; a null stays null."""
    short = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in short).hex()))  # noqa: E731  # fixed values: the pads of HMAC
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))
    return rows.withColumn(name, F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256)))


def token_parts(token: Column) -> tuple[Column, Column]:
    """The key id and the SHA-256 of the secret of a token ``<name>_<16 characters>.<secret>``; nulls for another shape."""
    shape = r"^[a-z]+_([A-Za-z0-9_-]{16})\.([A-Za-z0-9_-]{43})\z"
    fits = F.rlike(token, F.lit(shape))
    return F.when(fits, F.regexp_extract(token, shape, 1)), F.when(fits, F.unhex(F.sha2(F.regexp_extract(token, shape, 2), 256)))


def authenticated(requests: DataFrame, clients: DataFrame, now: str) -> DataFrame:
    """``requests`` (request_id, token) with the client_id, or null: unknown, disabled, revoked and expired look alike."""
    key_id, digest = token_parts(F.col("token"))
    asked = requests.select("request_id", key_id.alias("key_id"), digest.alias("asked_hash"))
    fit = (F.col("token_hash") == F.col("asked_hash")) & (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return asked.join(clients, "key_id", "left").select("request_id", F.when(fit, F.col("client_id")).alias("client_id"))
