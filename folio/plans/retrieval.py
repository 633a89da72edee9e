"""Queries of search, evidence, relations, lifecycle, integrity rules and evaluation."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import vectors
from folio.functions.identity import content_hash_column
from folio.operators import evaluation, keyword_index, lifecycle, metadata, relations, rules, search
from folio.plans import corpus
from folio.session import shared_folder, table
from folio.sources.commits import Conflict, Files, Log, Snapshot

DIMENSION = 64


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest vectors of every benchmark item's vector (the one of its id)."""
    rows = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "benchmark").join(rows, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    found = search.vector_top(rows, "vec_id", "embedding", queries, "item_id", "embedding")
    return found.select("query_id", F.col("row_id").alias("vec_id"), F.round("score", 6).alias("cosine"), "rank")


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    error = vectors.vector_error(F.col("embedding"), DIMENSION)
    return rows.select("vec_id", F.coalesce(error, F.lit("ok")).alias("state"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def stored_index(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The keyword index over the documents: made by the session's first search, and brought up to date when files changed."""
    docs = table(spark, sf_dir, "documents")
    log = Log(spark, f"{shared_folder(spark)}/folio-keywords-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode(), usedforsecurity=False).hexdigest()[:16]}")
    files, mark = Files(spark), {"files": []}
    for path in sorted(docs.inputFiles()):
        mark["files"].append([path, *files.size_and_time(path)])
    now = log.latest()
    if now.version and now.note.get("files") == mark["files"]:
        return now
    try:
        return keyword_index.refresh(log, docs, "doc_id", "text", mark)
    except Conflict:  # another search of the session was first
        return log.latest()


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword_index.top(stored_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("query_id", F.col("row_id").alias("doc_id"), F.round("score", 6).alias("similarity"), "rank")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, rows = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    queries = items.join(rows, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    keyword = keyword_index.top(stored_index(spark, sf_dir), items, "item_id", "text")
    return search.fused(keyword, search.vector_top(rows, "vec_id", "embedding", queries, "item_id", "embedding"))


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select(
        "query_id", "row_id", F.coalesce("kw_rank", F.lit(0)).alias("kw_rank"), F.coalesce("vec_rank", F.lit(0)).alias("vec_rank"), F.round("rrf", 9).alias("rrf")
    )


def evidence_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of eight as one parent."""
    matches = _hybrid(spark, sf_dir).select("query_id", (F.col("row_id") / 8).cast("bigint").alias("parent_id"), "row_id", F.round("rrf", 9).alias("rrf"))
    return search.evidence(matches, "parent_id", 20).select("query_id", "parent_id", "score", "n_matches", "matches", "place")


#: client, version scope, prefixes of paths, decision states
REQUESTED = [("c1", "current", ["docs/research/"], []), ("c2", "all", [], ["confirmed", "unknown"]), ("c3", "all", [], []), ("c5", "all", [], [])]


def authorized_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three clients may search: sources are granted by the client's key, runs follow documents' ids."""
    occurrences = corpus.occurrences(spark, sf_dir)
    meta = metadata.expressions(F.col("source_path"), F.col("first_lines"))
    occurrences = occurrences.select(
        "doc_id", F.concat(F.lit("run-"), "source").alias("run_id"), "source_path", content_hash_column(F.coalesce("text", F.lit(""))).alias("content_id"),
        meta["version_scope"].alias("version_scope"), meta["decision_state"].alias("decision_state"),
    )
    sources = table(spark, sf_dir, "documents").select("source").distinct().where("source IS NOT NULL")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    profiles = sources.select(F.col("source").alias("source_key"), F.when(number % 4 != 3, F.concat(F.lit("run-"), "source")).alias("active_run_id"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("client_id"), "c_custkey")
    clients = people.select(
        "client_id", F.when(F.col("c_custkey") % 5 == 0, "disabled").otherwise("active").alias("status"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"),
    )
    requests = spark.createDataFrame(REQUESTED, search.REQUESTS)
    grants = people.join(F.broadcast(requests), "client_id", "left_semi").join(sources, F.pmod(F.col("c_custkey"), F.lit(4)) == number % 4).select("client_id", F.col("source").alias("source_key"))
    return search.permitted(occurrences.select("doc_id", "content_id"), occurrences, profiles, grants, clients, requests, "2024-01-01").select("client_id", "doc_id")


def duplicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir).withColumn("content_hash", content_hash_column(F.coalesce("text", F.lit(""))))
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_paths"), F.min("source_path").alias("first_path"), F.max("source_path").alias("last_path"))


RELATION = (
    "SELECT CAST(doc_id AS INTEGER) AS position, 'd/' || doc_id AS from_source_path, 'd/' || (CASE WHEN doc_id % 19 = 0 THEN doc_id WHEN doc_id % 23 = 0 THEN -1 ELSE doc_id + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END END) AS to_source_path,"
    " CASE WHEN doc_id % 29 = 0 THEN 'follows' WHEN doc_id % 4 < 2 THEN 'potential_conflict' ELSE 'supersedes' END AS relation_type, 'd/' || doc_id AS evidence_source_path,"
    " CAST(1 + doc_id % 3 AS INTEGER) AS evidence_line_start, CAST(1 + doc_id % 5 AS INTEGER) AS evidence_line_end FROM documents"
)


def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RELATION.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    own = document_relations(spark, sf_dir)
    lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"))
    return own, docs.select(F.concat(F.lit("d/"), "doc_id").alias("source_path"), lines.alias("n_lines"))


def relation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.violations(*_relations(spark, sf_dir))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = _relations(spark, sf_dir)
    return relations.exposed(own).select("position", "from_source_path", "to_source_path")


def canonical_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir)
    meta = metadata.expressions(F.col("source_path"), F.col("first_lines"))
    return search.precedence(rows.select("source_path", content_hash_column(F.coalesce("text", F.lit(""))).alias("content_hash"), *(c.alias(n) for n, c in meta.items())))


def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second snapshot, in which some texts changed, has to build anew of each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = docs
    second = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    keyed = lambda d: d.select(content_hash_column(F.col("text")).alias("content_hash"), F.lit("p1").alias("parser_version"), F.lit("c1").alias("chunk_config_hash"))
    contents = lifecycle.to_build(keyed(second), keyed(first), "contents").select(F.lit("contents").alias("kind"), "content_hash")
    parses = lifecycle.to_build(keyed(second).withColumn("chunk_config_hash", F.lit("c2")), keyed(first), "parses").select(F.lit("parses").alias("kind"), "content_hash")
    chunked = lambda d, model: d.select(content_hash_column(F.substring("text", 1, 400)).alias("chunk_hash"), F.lit(model).alias("embedding_config_hash"))
    vectors_of = lambda kind, model: lifecycle.to_build(chunked(second, model), chunked(first, "e1"), "embeddings").select(F.lit(kind).alias("kind"), F.col("chunk_hash").alias("content_hash"))
    return contents.unionByName(parses).unionByName(vectors_of("embeddings", "e1")).unionByName(vectors_of("embeddings_of_a_new_model", "e2"))


RUNS = (
    "SELECT 's' || o_custkey AS source_key, 'r' || o_orderkey AS run_id, CASE o_rank WHEN 1 THEN 'ready' WHEN 2 THEN 'active' WHEN 3 THEN 'previous' ELSE 'failed' END AS status"
    " FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS o_rank FROM orders) AS ranked"
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def activation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    ready = runs.where("status = 'ready' AND source_key NOT LIKE '%3'").select("source_key", "run_id")
    return lifecycle.activated(runs, ready)


def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.rolled_back(_runs(spark, sf_dir))


AUDITS = (
    "SELECT event_id AS id, CASE WHEN event_id % 101 = 0 THEN ' ' ELSE 'r' || event_id END AS request_id, CASE WHEN event_id % 103 = 0 THEN '[1]' ELSE chr(123) || chr(34) || 'scope' || chr(34) || ':1' || chr(125) END AS filters,"
    " CASE WHEN event_id % 107 = 0 THEN 'abc' ELSE repeat('a', 40) END AS commit_sha, CAST(event_id % 7 AS INTEGER) - CASE WHEN event_id % 109 = 0 THEN 9 ELSE 0 END AS result_count,"
    " CASE event_id % 113 WHEN 0 THEN 'failed' WHEN 1 THEN 'no_evidence' ELSE 'ok' END AS status, value * CASE WHEN event_id % 127 = 0 THEN -1 ELSE 1 END AS embedding_ms, value AS keyword_ms,"
    " CASE WHEN event_id % 131 = 0 THEN NULL ELSE value END AS vector_ms, value AS rrf_ms, value * CASE WHEN event_id % 137 = 0 THEN -1 ELSE 1 END AS total_ms FROM events"
)


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 31 == 0, F.lit("XYZ")).otherwise(content_hash_column(F.coalesce("text", F.lit("")))).alias("content_hash"),
        F.coalesce("text", F.lit("")).alias("content"), (F.octet_length(F.coalesce("text", F.lit(""))) + (F.col("doc_id") % 37 == 0).cast("int")).alias("byte_size"),
    )
    found = rules.table_violations("document_contents", content)
    events = spark.sql(AUDITS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    found = found.unionByName(rules.table_violations("search_audit_events", events))
    labels = table(spark, sf_dir, "labels")
    return found.unionByName(rules.foreign_violations(docs, "doc_id", ("doc_id",), labels, ("doc_id",), "label"))


def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and content of a tree against an archive in which some files have moved and others changed."""
    rows = corpus.occurrences(spark, sf_dir).select("doc_id", "source_path", content_hash_column(F.coalesce("text", F.lit(""))).alias("hash"))
    tree = rows.select("source_path", F.col("hash").alias("tree_hash"))
    moved = F.when(F.col("doc_id") % 41 == 0, F.concat("source_path", F.lit(".moved"))).otherwise(F.col("source_path"))
    archive = rows.select(moved.alias("source_path"), F.when(F.col("doc_id") % 47 == 0, F.lit("changed")).otherwise(F.col("hash")).alias("archive_hash"))
    state = F.when(F.col("archive_hash").isNull(), "missing").when(F.col("tree_hash").isNull(), "extra").when(F.col("archive_hash") != F.col("tree_hash"), "changed")
    return tree.join(archive, "source_path", "full_outer").select("source_path", state.alias("state")).where("state IS NOT NULL")


def _ranked_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    queries = items.join(rows, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    ranked = search.vector_top(rows, "vec_id", "embedding", queries, "item_id", "embedding")
    ranked = ranked.join(rows.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 97).alias("content")), "row_id")
    asked = items.join(rows, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("label").alias("wanted"))
    grade = F.greatest(F.lit(0), F.lit(3) - F.abs(F.col("label") - F.col("wanted")) - (F.col("vec_id") % 3).cast("int"))
    near = F.explode(F.sequence(F.col("wanted") - 2, F.col("wanted") + 2))
    gold = rows.select("vec_id", "label").join(evaluation.small(asked.withColumn("label", near)), "label").select("query_id", F.col("vec_id").alias("row_id"), grade.cast("int").alias("relevance"))
    return ranked, gold.where("relevance > 0")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.query_metrics(*_ranked_gold(spark, sf_dir))
    return found.select("query_id", *(F.round(m, 6).alias(m) for m in evaluation.GATES))


def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.gates(evaluation.query_metrics(*_ranked_gold(spark, sf_dir)))
    return found.select("metric", F.round("value", 6).alias("value"), F.col("bound").cast("double").alias("bound"), "passed")


def audit_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    found = evaluation.latency(events, [(F.col("user_id") % 10).alias("client")], F.col("value"), F.col("event_type") == "error")
    return found.select("client", "n", *(F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "error_rate")))


def deterministic_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", lambda: vectors.hash_embedder(DIMENSION))
    signs = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    largest = F.array_position(F.transform("embedding", lambda x: F.abs(x)), F.array_max(F.transform("embedding", lambda x: F.abs(x)))).cast("int")
    return made.select("doc_id", F.coalesce(vectors.vector_error(F.col("embedding"), DIMENSION), F.lit("ok")).alias("state"), signs.alias("signs"), largest.alias("largest"))


QUERIES = {
    "vector_topk": vector_topk, "vector_validation": vector_validation, "keyword_topk": keyword_topk, "rrf_hybrid": rrf_hybrid, "evidence_grouping": evidence_grouping,
    "authorized_candidates": authorized_candidates, "duplicate_evidence": duplicate_evidence, "relation_validation": relation_validation, "conflict_pairs": conflict_pairs,
    "canonical_precedence": canonical_precedence, "incremental_reuse": incremental_reuse, "activation_state": activation_state, "rollback_state": rollback_state,
    "rule_violations": rule_violations, "provenance_check": provenance_check, "retrieval_metrics": retrieval_metrics, "metric_gates": metric_gates,
    "audit_latency": audit_latency, "deterministic_embed": deterministic_embed,
}

_OCC = f"SELECT doc_id, {corpus.PATH} AS source_path, [{corpus.LINE_1}, {corpus.LINE_2}, {corpus.LINE_3}] AS first_lines, text, source, lang, sha256(coalesce(text, '')) AS content_hash FROM documents"
_VEC = """
q AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
vs AS (SELECT item_id AS query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM q, embeddings),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 50)"""
_GRAMS = """list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]+')),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
_KEY = f"""
dg AS (SELECT doc_id, {_GRAMS.format(t="text")} AS g FROM documents), qg AS (SELECT item_id, {_GRAMS.format(t="text")} AS g FROM benchmark),
de AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM dg), qe AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM qg),
sh AS (SELECT item_id, doc_id, count(*) AS k FROM de JOIN qe USING (gram) GROUP BY ALL),
ks AS (SELECT qg.item_id AS query_id, dg.doc_id, coalesce(CAST(k AS DOUBLE) / nullif(len(dg.g) + len(qg.g) - coalesce(k, 0), 0), 0) AS score FROM qg CROSS JOIN dg LEFT JOIN sh ON sh.item_id = qg.item_id AND sh.doc_id = dg.doc_id),
kt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ks QUALIFY rank <= 50)"""
_RRF = f"""{_VEC}, {_KEY}, rr AS (
SELECT coalesce(kt.query_id, vt.query_id) AS query_id, coalesce(doc_id, vec_id) AS row_id, coalesce(kt.rank, 0) AS kw_rank, coalesce(vt.rank, 0) AS vec_rank,
  round(coalesce(1.0::DOUBLE / (60 + kt.rank), 0) + coalesce(1.0::DOUBLE / (60 + vt.rank), 0), 9) AS rrf
FROM kt FULL JOIN vt ON kt.query_id = vt.query_id AND kt.doc_id = vt.vec_id)"""
_META_SQL = """
m AS (SELECT doc_id, source_path, content_hash, owner_domain, decision_state, version_scope, document_date FROM ({meta}) x JOIN ({occ}) o USING (doc_id))"""
_METRICS = f"""
WITH {_VEC}, asked AS (SELECT item_id AS query_id, label AS wanted FROM benchmark JOIN embeddings ON item_id = vec_id),
gold AS (SELECT query_id, vec_id, greatest(0, 3 - abs(label - wanted) - vec_id % 3) AS rel FROM asked, embeddings WHERE abs(label - wanted) <= 2 AND greatest(0, 3 - abs(label - wanted) - vec_id % 3) > 0),
judged AS (SELECT vt.query_id, vt.rank, vt.vec_id % 97 AS content, coalesce(rel, 0) AS rel FROM vt LEFT JOIN gold ON gold.query_id = vt.query_id AND gold.vec_id = vt.vec_id WHERE vt.rank <= 10),
ideal AS (SELECT query_id, sum((pow(2.0, rel) - 1) / log2(place + 1)) AS ideal FROM (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, vec_id) AS place FROM gold) WHERE place <= 10 GROUP BY 1),
needed AS (SELECT query_id, count(*) FILTER (rel >= 2) AS relevant, count(*) FILTER (rel = 3) AS required FROM gold GROUP BY 1),
found AS (SELECT query_id, count(*) FILTER (rel >= 2 AND rank <= 5) AS in_5, count(*) FILTER (rel >= 2) AS in_10, count(*) FILTER (rel = 3) AS required_10, sum((pow(2.0, rel) - 1) / log2(rank + 1)) AS dcg,
  min(CASE WHEN rel = 3 THEN rank END) AS first, count(*) AS shown, count(*) - count(DISTINCT content) AS repeated FROM judged GROUP BY 1),
mm AS (SELECT query_id, CASE WHEN relevant > 0 THEN coalesce(in_5, 0) / relevant::DOUBLE ELSE 0 END AS recall_5, CASE WHEN relevant > 0 THEN coalesce(in_10, 0) / relevant::DOUBLE ELSE 0 END AS recall_10,
  CAST(coalesce(required_10, 0) = required AS DOUBLE) AS all_required_10, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg_10, coalesce(1.0::DOUBLE / first, 0) AS mrr_10,
  CASE WHEN shown > 0 THEN in_10 / shown::DOUBLE ELSE 0 END AS precision_10, CASE WHEN shown > 0 THEN repeated / shown::DOUBLE ELSE 0 END AS duplicate_ratio_10
FROM needed LEFT JOIN found USING (query_id) LEFT JOIN ideal USING (query_id))"""
_COUNT_LINES = r"len(regexp_extract_all(coalesce(text, ''), '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+'))"


def _oracles() -> dict[str, str]:
    from folio.plans.structure import ORACLES as structure

    names = list(evaluation.GATES)
    meta = structure["metadata_extract"]
    return {
        "vector_topk": f"WITH {_VEC} SELECT query_id, vec_id, round(score, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM vt",
        "vector_validation": """
SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-5 THEN 'norm' ELSE 'ok' END AS state,
  round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""",
        "keyword_topk": f"WITH {_KEY} SELECT query_id, doc_id, round(score, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM kt",
        "rrf_hybrid": f"WITH {_RRF} SELECT query_id, row_id, CAST(kw_rank AS INTEGER) AS kw_rank, CAST(vec_rank AS INTEGER) AS vec_rank, rrf FROM rr",
        "evidence_grouping": f"""
WITH {_RRF}, items AS (SELECT query_id, row_id // 8 AS parent_id, max(rrf) AS score, count(*) AS n_matches, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY rrf DESC, row_id) AS matches FROM rr GROUP BY 1, 2)
SELECT query_id, parent_id, score, n_matches, matches, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INTEGER) AS place FROM items QUALIFY place <= 20""",
        "authorized_candidates": f"""
WITH meta AS ({meta}), o AS (SELECT x.*, version_scope, decision_state, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS number FROM ({_OCC}) x JOIN meta USING (doc_id)),
w AS (SELECT 'c1' AS client_id, 1 AS k, 'current' AS scope, 'docs/research/' AS prefix, ['confirmed', 'draft', 'unknown'] AS states UNION ALL SELECT 'c2', 2, 'all', '', ['confirmed', 'unknown']
  UNION ALL SELECT 'c3', 3, 'all', '', ['confirmed', 'draft', 'unknown'] UNION ALL SELECT 'c5', 5, 'all', '', ['confirmed', 'draft', 'unknown'])
SELECT w.client_id, o.doc_id FROM w, o WHERE EXISTS (SELECT 1 FROM customer c, o p WHERE c.c_custkey = w.k AND c.c_custkey % 5 <> 0 AND c.c_custkey % 3 <> 0 AND p.content_hash = o.content_hash
  AND p.number % 4 <> 3 AND p.number % 4 = c.c_custkey % 4 AND (w.scope = 'all' OR p.version_scope = w.scope) AND starts_with(p.source_path, w.prefix) AND list_contains(w.states, p.decision_state))""",
        "duplicate_evidence": f"SELECT content_hash, count(*) AS n_paths, min(source_path) AS first_path, max(source_path) AS last_path FROM ({_OCC}) GROUP BY 1",
        "relation_validation": f"""
WITH r AS ({RELATION}), f AS (SELECT 'd/' || doc_id AS p, {_COUNT_LINES} AS n FROM documents), j AS (
  SELECT r.*, a.p AS fp, b.p AS tp, e.p AS ep, e.n AS n FROM r LEFT JOIN f a ON a.p = from_source_path LEFT JOIN f b ON b.p = to_source_path LEFT JOIN f e ON e.p = evidence_source_path)
SELECT position, 'type' AS rule FROM j WHERE relation_type NOT IN ('supersedes', 'potential_conflict')
UNION ALL SELECT position, 'lines' FROM j WHERE evidence_line_end < evidence_line_start
UNION ALL SELECT position, 'self' FROM j WHERE from_source_path = to_source_path
UNION ALL SELECT position, 'missing' FROM j WHERE fp IS NULL OR tp IS NULL OR ep IS NULL
UNION ALL SELECT position, 'past_end' FROM j WHERE evidence_line_end > n
UNION ALL SELECT position, 'conflict_twice' FROM (SELECT position, row_number() OVER (PARTITION BY least(from_source_path, to_source_path), greatest(from_source_path, to_source_path) ORDER BY position) AS k FROM r WHERE relation_type = 'potential_conflict') WHERE k > 1""",
        "conflict_pairs": f"""WITH r AS ({RELATION}) SELECT position, from_source_path, to_source_path FROM r WHERE relation_type = 'potential_conflict'
UNION ALL SELECT position, to_source_path, from_source_path FROM r WHERE relation_type = 'potential_conflict'""",
        "canonical_precedence": f"""
WITH meta AS ({meta}), m AS (SELECT o.source_path, o.content_hash, meta.* EXCLUDE (doc_id) FROM ({_OCC}) o JOIN meta USING (doc_id)), k AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY CASE owner_domain WHEN 'docs' THEN 0 WHEN 'uiux' THEN 1 ELSE 2 END, CASE decision_state WHEN 'confirmed' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END,
    CASE version_scope WHEN 'current' THEN 0 ELSE 1 END, coalesce(document_date, '0001-01-01') DESC, source_path) AS place, count(*) OVER (PARTITION BY content_hash) AS n FROM m)
SELECT k.source_path, k.content_hash, k.n AS n_occurrences, b.source_path AS canonical_path, b.source_path = k.source_path AS canonical FROM k JOIN k b ON b.content_hash = k.content_hash AND b.place = 1""",
        "deterministic_embed": f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 4) AS INTEGER) % {DIMENSION} AS dim, CASE WHEN substr(md5(word), 5, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM w),
n AS (SELECT doc_id, dim, sum(sign) AS n FROM h GROUP BY 1, 2),
v AS (SELECT d.doc_id, list(coalesce(n, 0) ORDER BY i) AS v FROM documents d CROSS JOIN range({DIMENSION}) r(i) LEFT JOIN n ON n.doc_id = d.doc_id AND n.dim = i GROUP BY 1),
f AS (SELECT doc_id, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN list_prepend(1, v[2:]) ELSE v END AS v FROM v)
SELECT doc_id, 'ok' AS state, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END), '') AS signs,
  CAST(list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))) AS INTEGER) AS largest FROM f""",
        "incremental_reuse": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS (SELECT DISTINCT sha256(text) AS h FROM d),
b AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END) AS h FROM d),
ca AS (SELECT DISTINCT sha256(substr(text, 1, 400)) AS h FROM d), cb AS (SELECT DISTINCT sha256(substr(CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END, 1, 400)) AS h FROM d)
SELECT 'contents' AS kind, h AS content_hash FROM b WHERE h NOT IN (SELECT h FROM a) UNION ALL SELECT 'parses', h FROM b
UNION ALL SELECT 'embeddings', h FROM cb WHERE h NOT IN (SELECT h FROM ca) UNION ALL SELECT 'embeddings_of_a_new_model', h FROM cb""",
        "activation_state": f"""
WITH r AS ({RUNS}), n AS (SELECT source_key, run_id AS new_id FROM r WHERE status = 'ready' AND source_key NOT LIKE '%3')
SELECT r.source_key, r.run_id, CASE WHEN new_id IS NULL THEN status WHEN r.run_id = new_id THEN 'active' WHEN status = 'active' THEN 'previous' WHEN status = 'previous' THEN 'ready' ELSE status END AS status,
  new_id IS NOT NULL AND status = 'previous' AS prunable FROM r LEFT JOIN n USING (source_key)""",
        "rollback_state": f"""
WITH r AS ({RUNS}), h AS (SELECT source_key, count(DISTINCT status) FILTER (status IN ('active', 'previous')) = 2 AS possible FROM r GROUP BY 1)
SELECT source_key, run_id, CASE WHEN NOT possible THEN status WHEN status = 'active' THEN 'previous' WHEN status = 'previous' THEN 'active' ELSE status END AS status, possible FROM r JOIN h USING (source_key)""",
        "rule_violations": """
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'XYZ' ELSE sha256(coalesce(text, '')) END AS h FROM documents)
SELECT 'content_hash_shape' AS rule, CAST(doc_id AS VARCHAR) AS key FROM c WHERE h = 'XYZ' UNION ALL SELECT 'size_matches', CAST(doc_id AS VARCHAR) FROM c WHERE doc_id % 37 = 0
UNION ALL SELECT 'unique_content_hash', h FROM c GROUP BY h HAVING count(*) > 1
UNION ALL SELECT 'label', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT rule, CAST(id AS VARCHAR) FROM ("""
        + " UNION ALL ".join(
            f"SELECT id, '{rule}' AS rule FROM ({AUDITS}) WHERE {broken}"
            for rule, broken in {
                "request_not_blank": "trim(request_id) = ''", "filters_is_object": "NOT starts_with(filters, '{')", "commit_shape": "NOT regexp_full_match(commit_sha, '[0-9a-f]{40}')",
                "result_count": "result_count < 0", "status": "status NOT IN ('ok', 'no_evidence')", **{f"{m}_ms_not_negative": f"{m}_ms < 0" for m in ("embedding", "keyword", "vector", "rrf", "total")},
            }.items()
        )
        + ")",
        "provenance_check": f"""
WITH o AS ({_OCC}), t AS (SELECT source_path AS p, content_hash AS h FROM o), a AS (SELECT CASE WHEN doc_id % 41 = 0 THEN source_path || '.moved' ELSE source_path END AS p, CASE WHEN doc_id % 47 = 0 THEN 'changed' ELSE content_hash END AS h FROM o)
SELECT coalesce(t.p, a.p) AS source_path, CASE WHEN a.p IS NULL THEN 'missing' WHEN t.p IS NULL THEN 'extra' ELSE 'changed' END AS state FROM t FULL JOIN a ON t.p = a.p WHERE a.p IS NULL OR t.p IS NULL OR a.h <> t.h""",
        "retrieval_metrics": f"{_METRICS} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in names)} FROM mm",
        "metric_gates": _METRICS + " UNION ALL ".join(
            f" SELECT '{m}' AS metric, round(avg({m}), 6) AS value, CAST({bound} AS DOUBLE) AS bound, avg({m}) {'>=' if side == 'least' else '<='} {bound} AS passed FROM mm" for m, (side, bound) in evaluation.GATES.items()
        ),
        "audit_latency": """
SELECT user_id % 10 AS client, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1""",
    }


ORACLES = _oracles()
