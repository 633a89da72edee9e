"""Queries that put operators together: the search service, range joins, index tables and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.identity import content_hash_column
from folio.functions import vectors
from folio.functions.text import trigram_text
from folio.operators import chunking, indexing, keyword_index, markdown, search
from folio.plans import corpus, retrieval, structure
from folio.session import stored, table

CLIENTS = ("c2", "c5")  # one that may see something, one that is disabled
EMBEDDER = ("driver-table", "1", retrieval.DIMENSION)  # of the vectors that queries have
AUDIT_KEY = b"folio-audit"
BY = ("client_id",)


def _guarded(spark: SparkSession, rows: DataFrame) -> None:
    """Refuses to search if the active run's vectors aren't of the queries' embedder."""
    made = rows.where("embedding IS NOT NULL").select(F.size("embedding").alias("dimension")).distinct()
    config = F.to_json(F.struct(F.lit(EMBEDDER[0]).alias("model"), F.lit(EMBEDDER[1]).alias("revision"), "dimension"))
    configs = made.select(F.col("dimension").alias("id"), config.alias("embedding_config"))
    runs = made.select(F.col("dimension").alias("run_id"), F.col("dimension").alias("index_config_id"))
    for active in search.active_descriptors(made.select(F.col("dimension").alias("active_run_id")), runs, configs):
        search.check_descriptor(active, EMBEDDER)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client gets for every benchmark item: nothing that it may not see is scored, equal contents are one item.

    All clients are searched in one plan: who may see what is decided once and stored, and each row is scored once for those
    who may see it.
    """
    rows, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    _guarded(spark, rows)
    asked = items.select("item_id", "text", F.explode(F.array(*map(F.lit, CLIENTS))).alias("client_id"))
    seen = stored(retrieval.authorized_candidates(spark, sf_dir).where(F.col("client_id").isin(*CLIENTS)).select("client_id", F.col("doc_id").alias("row_id")), "seen")
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"))
    contents = corpus.occurrences(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "source_path", content_hash_column(F.coalesce("text", F.lit(""))).alias("content_hash"), lines.alias("n_lines"))
    places = stored(contents.join(seen, "row_id"), "places")  # a row for each document that a client may see
    queries = asked.join(rows, F.col("item_id") == F.col("vec_id")).select("client_id", "item_id", "embedding")
    fused = search.fused(
        keyword_index.top(retrieval.stored_index(spark, sf_dir), asked, "item_id", "text", search.TOP, seen, BY),
        search.vector_top(rows, "vec_id", "embedding", queries, "item_id", "embedding", search.TOP, seen, BY), by=BY,
    )
    matches = fused.join(places.select("client_id", "row_id", "content_hash"), ["client_id", "row_id"]).select("client_id", "query_id", "content_hash", "row_id", F.round("rrf", 9).alias("rrf"))
    found = stored(search.evidence(matches, "content_hash", search.RESULTS, BY), "found")
    origins = places.join(found.select("client_id", "content_hash").distinct(), ["client_id", "content_hash"], "left_semi").groupBy("client_id", "content_hash").agg(
        F.count(F.lit(1)).alias("n_origins"), F.min("source_path").alias("first_origin"), F.max("n_lines").alias("n_lines")
    )
    named = places.select("client_id", F.concat(F.lit("d/"), "row_id").alias("source_path"), "content_hash")
    conflicts = search.closure(found, named, retrieval.document_relations(spark, sf_dir))
    whole = found.join(origins, ["client_id", "content_hash"]).join(conflicts, ["client_id", "content_hash"], "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    return search.served(whole, asked.select("client_id", F.col("item_id").alias("query_id"), F.col("text").alias("query")), BY)


def search_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("client_id", "query_id", "place", "content_hash", "score", "n_matches", "matches", "n_origins", "first_origin", "n_lines", "n_conflicts", "conflicts", "status")


def search_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.audited(_answers(spark, sf_dir), AUDIT_KEY, ("client_id", "query_id"), "query", "content_hash")
    return found.select("client_id", "query_id", F.lower(F.hex("query_hmac")).alias("query_hmac"), F.array_join("returned_ids", ",").alias("returned"), "result_count", "status")


def block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that a match's lines touch: a range join within each document."""
    docs = corpus.markdown_documents(spark, sf_dir)
    found = markdown.sections(docs).select("doc_id", "ordinal", "line_start", "line_end")
    matches = docs.select("doc_id", (F.lit(4) + F.col("doc_id") % 3).cast("int").alias("first"), (F.lit(5) + F.col("doc_id") % 5).cast("int").alias("last"))
    return found.join(matches, (found.doc_id == matches.doc_id) & (found.line_start <= matches["last"]) & (found.line_end >= matches["first"])).select(found.doc_id, "ordinal", "first", "last")


def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings of every trigram, summed up: in how many documents it stands, and the first and last of them."""
    rows = keyword_index.live(retrieval.stored_index(spark, sf_dir)).select("row_id", F.explode("grams").alias("code"))
    found = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n_docs"), F.min("row_id").alias("first_doc"), F.max("row_id").alias("last_doc"))
    return found.select(trigram_text(F.col("code")).alias("gram"), "n_docs", "first_doc", "last_doc")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counters per source, as the JSON object that the run stores."""
    rows = corpus.occurrences(spark, sf_dir).select("source", content_hash_column(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.col("lang"))
    found = rows.groupBy("source").agg(F.count_distinct("h").alias("contents"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.sum("size").alias("total_bytes"))
    return found.select("source", F.to_json(F.struct("contents", "documents", "english", "total_bytes")).alias("stats"))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over all documents as Markdown files: every occurrence with its content and what was made of that."""
    files = corpus.occurrences(spark, sf_dir).select("doc_id", "source_path").join(corpus.rich_documents(spark, sf_dir), "doc_id")
    config = indexing.Config(
        chunking.CharacterTokens(), lambda: vectors.hash_embedder(16), structure.CHUNK_CONFIG, "e" * 64, ("hash", "1", 16), include=corpus.INCLUDE, exclude=corpus.EXCLUDE
    )
    built = indexing.build(files.select("source_path", F.encode("text", "UTF-8").alias("content")), "run-1", config)
    per_section = built["chunks"].join(built["chunk_embeddings"].select(F.col("chunk_id").alias("id"), "dimension"), "id").groupBy("section_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
    per_parse = built["sections"].join(per_section, F.col("id") == F.col("section_id"), "left").groupBy("parse_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    per_content = built["document_parses"].join(per_parse, F.col("id") == F.col("parse_id")).select("content_id", "n_sections", "n_chunks", "n_tokens")
    return built["document_occurrences"].join(per_content, "content_id").select("source_path", "content_id", "version_scope", "decision_state", "n_sections", "n_chunks", "n_tokens")


QUERIES = {"index_build": index_build, "search_service": search_service, "search_audit": search_audit, "block_overlap": block_overlap, "trigram_index": trigram_index, "run_stats": run_stats}

_SEEN = "seen AS (SELECT DISTINCT doc_id FROM ({auth}) WHERE client_id = 'c2'), sd AS (SELECT d.* FROM documents d SEMI JOIN seen USING (doc_id)), se AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM sd))"
_ANSWERS = f"""
{_SEEN.format(auth=retrieval.ORACLES["authorized_candidates"])}, {retrieval._RRF.replace("FROM q, embeddings", "FROM q, se").replace("AS g FROM documents", "AS g FROM sd")},
c AS (SELECT doc_id, {corpus.PATH} AS source_path, sha256(coalesce(text, '')) AS content_hash, {retrieval._COUNT_LINES} AS n_lines FROM sd),
o AS (SELECT content_hash, count(*) AS n_origins, min(source_path) AS first_origin, CAST(max(n_lines) AS INTEGER) AS n_lines FROM c GROUP BY 1),
rel AS ({retrieval.RELATION}), side AS (SELECT from_source_path AS here, to_source_path AS other, evidence_line_start AS a, evidence_line_end AS b FROM rel WHERE relation_type = 'potential_conflict'
  UNION ALL SELECT to_source_path, from_source_path, evidence_line_start, evidence_line_end FROM rel WHERE relation_type = 'potential_conflict'),
hop AS (SELECT DISTINCT c.content_hash, other, a, b FROM c JOIN side ON here = 'd/' || c.doc_id WHERE other IN (SELECT 'd/' || doc_id FROM c)),
conf AS (SELECT content_hash, count(*) AS n_conflicts, string_agg(other || ':' || a || '-' || b, ',' ORDER BY other, a, b) FILTER (WHERE k <= {search.MOST_CONFLICTS}) AS conflicts
  FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY other, a, b) AS k FROM hop) GROUP BY 1),
items AS (SELECT query_id, content_hash, max(rrf) AS score, count(*) AS n_matches, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY rrf DESC, row_id) AS matches FROM rr JOIN c ON c.doc_id = rr.row_id GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_hash) AS INTEGER) AS place FROM items),
answers AS (SELECT 'c2' AS client_id, b.item_id AS query_id, place, content_hash, score, n_matches, matches, n_origins, first_origin, n_lines, n_conflicts, conflicts, CASE WHEN place IS NULL THEN 'no_evidence' ELSE 'ok' END AS status, text AS query
  FROM benchmark b LEFT JOIN (SELECT p.*, n_origins, first_origin, n_lines, coalesce(n_conflicts, 0) AS n_conflicts, conflicts FROM p JOIN o USING (content_hash) LEFT JOIN conf USING (content_hash) WHERE place <= 5) f ON f.query_id = b.item_id
  UNION ALL SELECT 'c5', item_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no_evidence', text FROM benchmark)"""
_PAD = lambda x: "".join(f"\\x{b ^ x:02X}" for b in AUDIT_KEY.ljust(64, b"\0"))
ORACLES = {
    "index_build": f"""
WITH {structure._RICH_CHUNKS}, d AS (SELECT doc_id, count(*) AS n_chunks, sum(length(search_text)) AS n_tokens FROM x GROUP BY 1),
f AS (SELECT doc_id, {corpus.PATH} AS source_path, sha256({corpus.rich(", 'g'")}) AS h FROM documents),
e AS (SELECT *, regexp_replace(split_part(source_path, '/', -1), '[.][^.]*$', '') AS stem FROM f WHERE ({structure._ANY(corpus.INCLUDE)}) AND NOT ({structure._ANY(corpus.EXCLUDE)})),
g AS (SELECT *, regexp_matches(stem, '확정기록|결정서') AND NOT regexp_matches(stem, '미확정|불확정|확정 전') AS confirmed, regexp_matches(stem, '초안|제안안|가설|진행메모') AS draft FROM e)
SELECT source_path, sha256('content' || chr(31) || h) AS content_id, CASE WHEN list_contains(string_split(source_path, '/'), 'versions') THEN 'historical' ELSE 'current' END AS version_scope,
  CASE WHEN confirmed = draft THEN 'unknown' WHEN confirmed THEN 'confirmed' ELSE 'draft' END AS decision_state, CAST(4 AS BIGINT) AS n_sections, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(n_tokens AS BIGINT) AS n_tokens
FROM g JOIN d USING (doc_id)""",
    "search_service": f"WITH {_ANSWERS} SELECT * EXCLUDE (query) FROM answers",
    "search_audit": f"""
WITH {_ANSWERS} SELECT client_id, query_id, sha256('{_PAD(0x5C)}'::BLOB || unhex(sha256('{_PAD(0x36)}'::BLOB || encode(query)))) AS query_hmac,
  coalesce(string_agg(content_hash, ',' ORDER BY place), '') AS returned, CAST(count(place) AS INTEGER) AS result_count, max(status) AS status FROM answers GROUP BY client_id, query_id, query""",
    "block_overlap": f"""
SELECT s.doc_id, s.ordinal, CAST(4 + s.doc_id % 3 AS INTEGER) AS first, CAST(5 + s.doc_id % 5 AS INTEGER) AS last FROM ({structure.ORACLES["heading_sections"]}) s
WHERE s.line_start <= 5 + s.doc_id % 5 AND s.line_end >= 4 + s.doc_id % 3""",
    "trigram_index": f"""
WITH g AS (SELECT doc_id, unnest({retrieval._GRAMS.format(t="text")}) AS gram FROM documents)
SELECT gram, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM g GROUP BY 1""",
    "run_stats": """
SELECT source, '{"contents":' || count(DISTINCT sha256(coalesce(text, ''))) || ',"documents":' || count(*) || ',"english":' || count(*) FILTER (lang = 'en') || ',"total_bytes":' || sum(strlen(coalesce(text, ''))) || '}' AS stats
FROM documents GROUP BY 1""",
}
