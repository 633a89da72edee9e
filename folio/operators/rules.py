"""Integrity rules of the stored tables as queries that return what breaks them.

A CHECK passes on null, as in SQL; unique keys ignore rows with a null in the key; a foreign key with a null part passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import not_blank, sha_shape

# The sets that columns are limited to.
SCOPES, STATES, OWNERS = ("current", "historical"), ("confirmed", "draft", "unknown"), ("docs", "uiux")
RUNS, RELATIONS = ("building", "ready", "active", "previous", "failed"), ("supersedes", "potential_conflict")
CLIENTS, SEARCHES = ("active", "disabled", "revoked"), ("ok", "no_evidence")

c = F.col


def _object(name: str) -> Column:
    """A column that holds a JSON object as text."""
    return F.startswith(F.ltrim(c(name)), F.lit("{")) & F.get_json_object(name, "$").isNotNull()


def _array(name: str) -> Column:
    """A column that is an array, or holds one as JSON text."""
    return F.startswith(F.ltrim(c(name).cast("string")), F.lit("["))


def _not_negative(*names: str) -> dict[str, Callable[[], Column]]:
    return {f"{name}_not_negative": (lambda name=name: c(name) >= 0) for name in names}


def _lines() -> Column:
    return (c("line_start") >= 1) & (c("line_end") >= c("line_start"))


#: table: {rule: what holds}
CHECKS = {
    "source_profiles": {"key_not_blank": lambda: not_blank(c("source_key")), "include_is_array": lambda: _array("include_patterns"), "exclude_is_array": lambda: _array("exclude_patterns")},
    "index_configs": {"config_hash_shape": lambda: sha_shape(c("config_hash"))}
    | {f"{kind}_config_is_object": (lambda kind=kind: _object(f"{kind}_config")) for kind in ("parser", "chunk", "tokenizer", "embedding", "rrf")},
    "index_runs": {"commit_shape": lambda: sha_shape(c("commit_sha"), 40), "status": lambda: c("status").isin(*RUNS), "stats_is_object": lambda: _object("stats")},
    "document_contents": {
        "content_hash_shape": lambda: sha_shape(c("content_hash")),
        "size_not_negative": lambda: c("byte_size") >= 0,
        "size_matches": lambda: c("byte_size") == F.octet_length("content"),
    },
    "document_occurrences": {
        "path_not_blank": lambda: not_blank(c("source_path")),
        "version_scope": lambda: c("version_scope").isin(*SCOPES),
        "decision_state": lambda: c("decision_state").isin(*STATES),
        "owner_domain": lambda: c("owner_domain").isin(*OWNERS),
    },
    "document_parses": {"parser_not_blank": lambda: not_blank(c("parser_version")), "config_shape": lambda: sha_shape(c("chunk_config_hash"))},
    "sections": {"ordinal": lambda: c("ordinal") >= 0, "level": lambda: c("level").between(0, 6), "lines": _lines},
    "chunks": {"ordinal": lambda: c("ordinal") >= 0, "token_count": lambda: c("token_count") >= 0, "lines": _lines, "chunk_hash_shape": lambda: sha_shape(c("chunk_hash"))},
    "chunk_embeddings": {
        "dimension_positive": lambda: c("dimension") > 0,
        "dimension_matches": lambda: F.size("embedding") == c("dimension"),
        "model_not_blank": lambda: not_blank(c("model_name")),
        "revision_not_blank": lambda: not_blank(c("model_revision")),
        "config_hash_shape": lambda: sha_shape(c("embedding_config_hash")),
        "status": lambda: c("status") == "ready",
    },
    "document_relations": {
        "relation_type": lambda: c("relation_type").isin(*RELATIONS),
        "evidence_path_not_blank": lambda: not_blank(c("evidence_source_path")),
        "lines": lambda: (c("evidence_line_start") >= 1) & (c("evidence_line_end") >= c("evidence_line_start")),
    },
    "api_clients": {"name_not_blank": lambda: not_blank(c("name")), "key_length": lambda: F.length("key_id") == 16, "token_length": lambda: F.octet_length("token_hash") == 32, "status": lambda: c("status").isin(*CLIENTS)},
    "search_audit_events": {
        "hmac_length": lambda: F.octet_length("query_hmac") == 32,
        "result_count": lambda: c("result_count") >= 0,
        "status": lambda: c("status").isin(*SEARCHES),
        "request_not_blank": lambda: not_blank(c("request_id")),
        "filters_is_object": lambda: _object("filters"),
        "commit_shape": lambda: sha_shape(c("commit_sha"), 40),
    }
    | _not_negative("embedding_ms", "keyword_ms", "vector_ms", "rrf_ms", "total_ms"),
}
UNIQUE = {
    "source_profiles": (("source_key",),), "index_configs": (("config_hash",),), "document_contents": (("content_hash",),),
    "document_occurrences": (("run_id", "source_path"),), "document_parses": (("content_id", "parser_version", "chunk_config_hash"),),
    "sections": (("parse_id", "ordinal"),), "chunks": (("section_id", "ordinal"),), "chunk_embeddings": (("chunk_id", "embedding_config_hash"),),
    "api_clients": (("key_id",),), "client_source_grants": (("client_id", "source_profile_id"),),
}

#: The columns that a rule reads, by its name; those of a table's own come first.
READS = {
    "document_relations lines": "evidence_line_start evidence_line_end", "chunk_embeddings config_hash_shape": "embedding_config_hash", "lines": "line_start line_end",
    "key_not_blank": "source_key", "include_is_array": "include_patterns", "exclude_is_array": "exclude_patterns", "config_hash_shape": "config_hash", "commit_shape": "commit_sha",
    "stats_is_object": "stats", "content_hash_shape": "content_hash", "size_not_negative": "byte_size", "size_matches": "byte_size content", "path_not_blank": "source_path",
    "parser_not_blank": "parser_version", "config_shape": "chunk_config_hash", "chunk_hash_shape": "chunk_hash", "dimension_positive": "dimension", "dimension_matches": "embedding dimension",
    "model_not_blank": "model_name", "revision_not_blank": "model_revision", "evidence_path_not_blank": "evidence_source_path", "name_not_blank": "name", "key_length": "key_id",
    "token_length": "token_hash", "hmac_length": "query_hmac", "request_not_blank": "request_id", "filters_is_object": "filters",
}


def _reads(table: str, rule: str) -> set[str]:
    named = READS.get(f"{table} {rule}") or READS.get(rule) or rule.removesuffix("_not_negative").removesuffix("_is_object")
    return set(named.split())


#: What a row's columns name in another table. Two columns keep both ends within one run, parse or source.
REFERENCES = {
    "chunk_embeddings": [("chunk_id", "chunks", "id")],
    "chunks": [("section_id", "sections", "id")],
    "sections": [("parse_id", "document_parses", "id"), ("parse_id parent_section_id", "sections", "parse_id id")],
    "document_parses": [("content_id", "document_contents", "id")],
    "document_occurrences": [("content_id", "document_contents", "id"), ("run_id", "index_runs", "id")],
    "document_relations": [
        ("run_id", "index_runs", "id"), ("run_id from_occurrence_id", "document_occurrences", "run_id id"), ("run_id to_occurrence_id", "document_occurrences", "run_id id"),
        ("run_id evidence_source_path", "document_occurrences", "run_id source_path"),
    ],
    "index_runs": [("index_config_id", "index_configs", "id"), ("source_profile_id", "source_profiles", "id")],
    "source_profiles": [("id active_index_run_id", "index_runs", "source_profile_id id")],
    "client_source_grants": [("client_id", "api_clients", "id"), ("source_profile_id", "source_profiles", "id")],
    "search_audit_events": [("client_id", "api_clients", "id"), ("source_profile_id", "source_profiles", "id")],
}


def check_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every row for which a rule is false."""
    broken = F.array_compact(F.array(*(F.when(~holds, F.lit(name)) for name, holds in rules.items())))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def table_violations(name: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """All CHECK violations of one of the stored tables, and the keys, the primary one included, that are there more than once.

    Rules whose columns the given rows lack are left out.
    """
    there = {rule: holds() for rule, holds in CHECKS.get(name, {}).items() if _reads(name, rule) <= set(rows.columns)}
    out = check_violations(rows, key, there) if there else None
    for columns in ((key,), *(u for u in UNIQUE.get(name, ()) if set(u) <= set(rows.columns))):
        own = unique_violations(rows, columns, "unique_" + "_".join(columns))
        out = own if out is None else out.unionByName(own)
    return out


def unique_violations(rows: DataFrame, columns: tuple[str, ...], rule: str) -> DataFrame:
    whole = rows
    for column in columns:
        whole = whole.where(F.col(column).isNotNull())
    return whole.groupBy(*columns).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(x).cast("string") for x in columns)).alias("key"))


def foreign_violations(rows: DataFrame, key: str, columns: tuple[str, ...], target: DataFrame, target_columns: tuple[str, ...], rule: str) -> DataFrame:
    """Rows whose (possibly composite) reference names nothing."""
    whole = rows
    for column in columns:
        whole = whole.where(F.col(column).isNotNull())
    named = target.select(*(F.col(t).alias(x) for x, t in zip(columns, target_columns)))
    return whole.join(named, list(columns), "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def database_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key) of everything in the given tables that breaks a CHECK, a unique key or a reference among them."""
    from functools import reduce

    found = []
    for name, rows in tables.items():
        key = "id" if "id" in rows.columns else rows.columns[0]
        own = table_violations(name, rows, key)
        found += [own.select(F.lit(name).alias("table"), "rule", "key")] if own is not None else []
        for columns, target, names in REFERENCES.get(name, ()):
            if target in tables:
                broken = foreign_violations(rows, key, tuple(columns.split()), tables[target], tuple(names.split()), f"reference_{columns.replace(' ', '_')}")
                found.append(broken.select(F.lit(name).alias("table"), "rule", "key"))
    return reduce(DataFrame.unionByName, found)
