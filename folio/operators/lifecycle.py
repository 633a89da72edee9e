"""Reuse, activation, rollback and pruning, as pure functions from tables to tables.

Parquet has no transactions: an activation is one new table of run states, which its writer publishes with one pointer.
Until then readers see the old one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a change of configuration makes anew; the rest is reused.
REUSE_KEYS = {
    "contents": ("content_hash",),
    "parses": ("content_hash", "parser_version", "chunk_config_hash"),
    "embeddings": ("chunk_hash", "embedding_config_hash"),
}


def to_build(wanted: DataFrame, stored: DataFrame, kind: str) -> DataFrame:
    """The distinct reuse keys of ``wanted`` that ``stored`` lacks."""
    keys = list(REUSE_KEYS[kind])
    return wanted.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")


def activated(runs: DataFrame, ready: DataFrame) -> DataFrame:
    """Run states once each source's run of ``ready`` (source_key, run_id) is active: the active one before is previous.

    Only a run that is ready is activated; a source without one keeps its states.
    """
    fit = runs.where("status = 'ready'").join(ready, ["source_key", "run_id"], "left_semi").select("source_key", F.col("run_id").alias("new_id"))
    joined = runs.join(fit, "source_key", "left")
    status = (
        F.when(F.col("new_id").isNull(), F.col("status"))
        .when(F.col("run_id") == F.col("new_id"), "active")
        .when(F.col("status") == "active", "previous")
        .when(F.col("status") == "previous", "ready")
        .otherwise(F.col("status"))
    )
    return joined.select("source_key", "run_id", status.alias("status"), (F.col("new_id").isNotNull() & (F.col("status") == "previous")).alias("prunable"))


def rolled_back(runs: DataFrame) -> DataFrame:
    """Active and previous swapped for every source that has both; ``possible`` is false for the others."""
    has = runs.groupBy("source_key").agg((F.max((F.col("status") == "active").cast("int")) + F.max((F.col("status") == "previous").cast("int"))).alias("n"))
    swap = F.when(F.col("n") < 2, F.col("status")).when(F.col("status") == "active", "previous").when(F.col("status") == "previous", "active").otherwise(F.col("status"))
    return runs.join(has, "source_key").select("source_key", "run_id", swap.alias("status"), (F.col("n") == 2).alias("possible"))


def pruned(occurrences: DataFrame, runs: DataFrame) -> DataFrame:
    """The occurrences of runs that are active, previous or under way."""
    return occurrences.join(runs.where("status IN ('active', 'previous', 'building', 'ready')"), "run_id", "left_semi")


#: What keeps a row of each table: the table above it, the row's column, and the column there that must hold its value.
KEPT_BY = {
    "document_contents": ("document_occurrences", "id", "content_id"), "document_parses": ("document_contents", "content_id", "id"), "sections": ("document_parses", "parse_id", "id"),
    "chunks": ("sections", "section_id", "id"), "chunk_embeddings": ("chunks", "chunk_id", "id"),
}


def reachable(tables: dict[str, DataFrame], runs: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table: marked from the runs that are kept through occurrences, contents, parses, sections and
    chunks to embeddings. Contents that several runs share stay as long as one of them does; relations go with their run.

    Keys are made distinct before they are shuffled, so a content that most occurrences share isn't a hot key.
    """
    kept = {"document_occurrences": pruned(tables["document_occurrences"], runs)}
    for name, (above, column, names) in KEPT_BY.items():
        if name in tables and above in kept:
            marks = kept[above].select(F.col(names).alias(column)).distinct()
            kept[name] = tables[name].join(marks, column, "left_semi").select(*tables[name].columns)
    if "document_relations" in tables:
        kept["document_relations"] = pruned(tables["document_relations"], runs)
    return kept


def swept(tables: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """(table, id) of every row that no kept run reaches."""
    gone = [tables[name].select("id").join(rows.select("id"), "id", "left_anti").select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id")) for name, rows in kept.items()]
    return reduce(DataFrame.unionByName, gone)
