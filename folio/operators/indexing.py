"""A run of the index: from a snapshot's files to the stored tables, reusing what earlier runs made.

Contents, parses and embeddings are known by natural keys; ids are digests of these, so a run that is made again makes the
same rows. Only what ``stored`` lacks is parsed, chunked and embedded; under another embedding configuration the chunks
that are stored get new vectors, and nothing is parsed. One invalid document fails the run: its tables are
built but its status is ``failed``, and nothing that is active changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import vectors
from folio.functions.paths import selected, strictly_canonical
from folio.functions.text import physical_lines
from folio.operators import chunking, markdown, metadata, rules
from folio.session import stored as stored_table


@dataclass(frozen=True)
class Config:
    counter: chunking.TokenCounter
    embedder: Callable
    chunk_config_hash: str
    embedding_config_hash: str
    model: tuple[str, str, int]
    limits: chunking.Limits = chunking.Limits()
    include: list[str] = field(default_factory=lambda: ["**"])
    exclude: list[str] = field(default_factory=list)


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def build(files: DataFrame, run_id: str, config: Config, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables by name. ``files``: source_path and content (binary); ``stored``: document_parses, sections, chunks and
    chunk_embeddings so far.

    Rows of sections, chunks and embeddings are the new ones; occurrences are all of the run, one for each file: a path that
    stands twice breaks a rule and fails the run. Files are read once and documents parsed once, into
    tables in the shared folder.
    """
    stored = stored or {}
    chosen = files.where(selected(F.col("source_path"), config.include, config.exclude))
    keyed = chosen.select("source_path", F.sha2("content", 256).alias("content_hash"), "content", F.is_valid_utf8("content").alias("valid"))
    keyed = keyed.withColumns({"content_id": digest("content", F.col("content_hash")), "content": F.when(F.col("valid"), F.col("content").cast("string"))})
    keyed = stored_table(keyed, "files")  # several tables begin with them
    contents = keyed.groupBy("content_id", "content_hash").agg(F.first("content").alias("content")).select(
        F.col("content_id").alias("id"), "content_hash", "content", F.octet_length("content").cast("bigint").alias("byte_size")
    )
    heads = keyed.select("source_path", "content_id", F.slice(physical_lines(F.coalesce("content", F.lit(""))), 1, metadata.TOP_LINES).alias("first_lines"))
    occurrences = metadata.extracted(heads, "content_id").select(
        digest("occurrence", run_id, F.col("source_path")).alias("id"), F.lit(run_id).alias("run_id"), "content_id", "source_path",
        "version_scope", "document_date", "document_version", "decision_state", "owner_domain",
    )
    parses = contents.select(F.col("id").alias("content_id"), F.lit(markdown.PARSER_VERSION).alias("parser_version"), F.lit(config.chunk_config_hash).alias("chunk_config_hash"))
    every = parses.select(digest("parse", F.col("content_id"), F.col("parser_version"), F.col("chunk_config_hash")).alias("parse_id"))
    if "document_parses" in stored:
        parses = parses.join(stored["document_parses"], ["content_id", "parser_version", "chunk_config_hash"], "left_anti")
    parses = parses.select(digest("parse", F.col("content_id"), F.col("parser_version"), F.col("chunk_config_hash")).alias("id"), "content_id", "parser_version", "chunk_config_hash")
    texts = parses.join(contents.select(F.col("id").alias("content_id"), "content"), "content_id").select(F.col("id").alias("parse_id"), "content")
    section_id = lambda ordinal: digest("section", F.col("parse_id"), F.col(ordinal))
    parsed = stored_table(chunking.chunked_sections(texts, config.counter, config.chunk_config_hash, config.limits, "content", key="parse_id"), "parsed")
    sections = parsed.select(
        section_id("ordinal").alias("id"), "parse_id", F.when(F.col("parent_ordinal").isNotNull(), section_id("parent_ordinal")).alias("parent_section_id"),
        "ordinal", "level", "heading", "heading_path", "body", "line_start", "line_end",
    )
    chunks = parsed.select(section_id("ordinal").alias("section_id"), F.explode("chunks").alias("c")).select(
        digest("chunk", F.col("section_id"), F.col("c.ordinal")).alias("id"), "section_id", "c.ordinal", "c.raw_text", "c.search_text", "c.token_count", "c.line_start", "c.line_end", "c.chunk_hash"
    )
    wanted = chunks.select("id", "search_text")
    if "sections" in stored and "chunks" in stored:  # chunks of this run's parses that were made before
        own = stored["sections"].join(every, "parse_id", "left_semi").select(F.col("id").alias("section_id"))
        wanted = wanted.unionByName(stored["chunks"].join(own, "section_id", "left_semi").select("id", "search_text"))
    if "chunk_embeddings" in stored:
        done = stored["chunk_embeddings"].where(F.col("embedding_config_hash") == config.embedding_config_hash).select(F.col("chunk_id").alias("id"))
        wanted = wanted.join(done, "id", "left_anti")
    name, revision, dimension = config.model
    embeddings = vectors.embedded(wanted, "id", "search_text", config.embedder).select(
        digest("embedding", F.col("id"), config.embedding_config_hash).alias("id"), F.col("id").alias("chunk_id"), F.lit(config.embedding_config_hash).alias("embedding_config_hash"),
        F.lit(name).alias("model_name"), F.lit(revision).alias("model_revision"), F.lit(dimension).alias("dimension"), "embedding", F.lit("ready").alias("status"),
    )
    return {
        "document_contents": contents, "document_occurrences": occurrences, "document_parses": parses, "sections": sections, "chunks": chunks, "chunk_embeddings": embeddings,
    }


def status(tables: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """``ready``, or ``failed`` with what is wrong: broken rules, documents that aren't UTF-8, unsafe paths, owners unknown."""
    own = {k: v for k, v in tables.items() if k != "index_runs"}
    broken = rules.database_violations(own)
    undecoded = own["document_contents"].where("content IS NULL").select(F.lit("document_contents").alias("table"), F.lit("utf8").alias("rule"), F.col("id").alias("key"))
    odd = own["document_occurrences"].where(F.col("owner_domain").isNull() | ~strictly_canonical(F.col("source_path"))).select(
        F.lit("document_occurrences").alias("table"), F.lit("path").alias("rule"), F.col("source_path").alias("key")
    )
    found = broken.unionByName(undecoded).unionByName(odd)
    return ("failed" if found.limit(1).count() else "ready"), found
