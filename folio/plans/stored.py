"""Queries over stored tables: commits of all tables at once, pruning by reachability, and what stored sections parse to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.identity import content_hash_column
from folio.operators import chunking, lifecycle, markdown
from folio.plans import corpus, structure
from folio.session import shared_folder, stored, table
from folio.sources.commits import Log

CHANGED = 10  # one text in so many is another one in the second run


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index tables after two runs over the documents: the first one's texts, and the second's, of which some changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("first"))
    second = F.when(F.col("doc_id") % CHANGED == 0, F.concat("first", F.lit(" v2"))).otherwise(F.col("first"))
    texts = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("r1").alias("run_id"), F.col("first").alias("text")), F.struct(F.lit("r2").alias("run_id"), second.alias("text")))).alias("t")).select("doc_id", "t.*")
    every = stored(texts.select("doc_id", "run_id", content_hash_column(F.col("text")).alias("content_id"), F.size(chunking.character_windows(F.col("text"))).alias("n")), "two-runs")
    contents = every.groupBy("content_id").agg(F.first("n").alias("n"))
    sections = contents.select(F.concat(F.lit("s-"), "content_id").alias("id"), F.concat(F.lit("p-"), "content_id").alias("parse_id"), "n")
    chunks = sections.where("n > 0").select(F.col("id").alias("section_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal")).withColumn("id", F.concat("section_id", F.lit("-"), "ordinal"))
    return {
        "document_occurrences": every.select(F.concat("run_id", F.lit("-"), "doc_id").alias("id"), "run_id", "content_id"),
        "document_contents": contents.select(F.col("content_id").alias("id")),
        "document_parses": contents.select(F.concat(F.lit("p-"), "content_id").alias("id"), "content_id"),
        "sections": sections.drop("n"),
        "chunks": chunks,
        "chunk_embeddings": chunks.select(F.concat(F.lit("e-"), "id").alias("id"), F.col("id").alias("chunk_id")),
    }


def _runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r1", "failed"), ("r2", "active")], "run_id string, status string")


def prune_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that goes once the first run has failed: what it shares with the second stays."""
    tables = _tables(spark, sf_dir)
    return lifecycle.swept(tables, lifecycle.reachable(tables, _runs(spark)))


def committed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table has at each version: one commit with both runs, and one of what pruning keeps."""
    tables = _tables(spark, sf_dir)
    log = Log(spark, f"{shared_folder(spark)}/folio-commits-{uuid.uuid4().hex}")
    lease = log.acquire("source", "prune", 3_600)
    first = log.publish(tables, lease=lease)
    lasting = {name: first.read(name) for name in tables}
    log.publish(lifecycle.reachable(lasting, _runs(spark)), first, lease)
    out = None
    for version in log.versions():
        held = log.at(version)
        for name in tables:
            own = held.read(name).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).select(F.lit(version).alias("version"), F.lit(name).alias("table"), "n", "least")
            out = own if out is None else out.unionByName(own)
    log.release(lease)
    return out


def reparse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sections in which some bodies, lines and blocks have been changed, parsed again."""
    found = stored(markdown.sections(corpus.rich_documents(spark, sf_dir)), "sections")
    at = lambda every, ordinal: (F.col("doc_id") % every == 0) & (F.col("ordinal") == ordinal)
    kinds = F.transform("blocks", lambda b: b.withField("kind", F.when(at(31, 1) & (b["kind"] == "bullet_list"), "paragraph").otherwise(b["kind"])))
    planted = found.withColumns({
        "body": F.when(at(29, 1), F.concat("body", F.lit("y"))).otherwise(F.col("body")),
        "line_end": F.when(at(37, 2), F.col("line_end") + 1).otherwise(F.col("line_end")), "blocks": kinds,
    })
    return markdown.reparse_faults(planted)


# --- documents of many paragraphs, and of tables longer than a chunk ---

PARAGRAPH, CELL = 149, 100  # letters of a text to a paragraph and to a row
_LETTERS = r"regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9À-ɏ ]', ''{g})"
LONG = (
    "'# P' || chr(10) || regexp_replace({x}, '(.{{1,149}})', 'w{one}' || chr(10) || chr(10){g}) || '# Q' || chr(10) || '| h | x |' || chr(10) || '|---|---|' || chr(10)"
    " || regexp_replace({x}, '(.{{1,100}})', '| w{one} | x |' || chr(10){g})"
)


def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each document as paragraphs with a blank line behind each, and again as the rows of one table."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(LONG.format(x=_LETTERS.format(g=""), one="$1", g="")).alias("text"))


def chunker_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(long_documents(spark, sf_dir), chunking.CharacterTokens(), structure.CHUNK_CONFIG)
    return found.select("doc_id", "section_ordinal", "ordinal", "token_count", "line_start", "line_end", content_hash_column(F.col("raw_text")).alias("raw_hash"))


def chunker_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the tokens of a public vocabulary; ``over`` counts those above the limits by the library's own count."""
    import public_tokenizers

    counter = chunking.VocabularyTokens(public_tokenizers.path("byte_bpe_50k.json"))
    found = chunking.chunks(corpus.rich_documents(spark, sf_dir), counter, structure.CHUNK_CONFIG)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.count_if(F.col("token_count") > chunking.Limits.atomic).alias("over"))


QUERIES = {
    "prune_reachability": prune_reachability, "committed_tables": committed_tables, "reparse_check": reparse_check, "chunker_long": chunker_long, "chunker_vocabulary": chunker_vocabulary,
}

_TWO = f"""
d AS (SELECT doc_id, coalesce(text, '') AS a, CASE WHEN doc_id % {CHANGED} = 0 THEN coalesce(text, '') || ' v2' ELSE coalesce(text, '') END AS b FROM documents),
occ AS (SELECT 'r1-' || doc_id AS id, 'r1' AS run_id, a AS text FROM d UNION ALL SELECT 'r2-' || doc_id, 'r2', b FROM d),
con AS (SELECT sha256(text) AS h, any_value(text) AS text, bool_or(run_id = 'r2') AS stays FROM occ GROUP BY text),
win AS (SELECT 's-' || h || '-' || unnest(range(CASE WHEN regexp_matches(text, '\\S') THEN CAST(1 + greatest(0, ceil((length(text) - 600) / 336.0)) AS INTEGER) ELSE 0 END)) AS id, stays FROM con),
every AS (SELECT 'document_occurrences' AS "table", id, run_id = 'r2' AS stays FROM occ UNION ALL SELECT 'document_contents', h, stays FROM con UNION ALL SELECT 'document_parses', 'p-' || h, stays FROM con
  UNION ALL SELECT 'sections', 's-' || h, stays FROM con UNION ALL SELECT 'chunks', id, stays FROM win UNION ALL SELECT 'chunk_embeddings', 'e-' || id, stays FROM win)"""
_X = _LETTERS.format(g=", 'g'")
ORACLES = {
    "prune_reachability": f"""WITH {_TWO} SELECT "table", id FROM every WHERE NOT stays""",
    "committed_tables": f"""
WITH {_TWO} SELECT CAST(1 AS INTEGER) AS version, "table", count(*) AS n, min(id) AS least FROM every GROUP BY 2 UNION ALL SELECT 2, "table", count(*), min(id) FROM every WHERE stays GROUP BY 2""",
    "reparse_check": """
SELECT doc_id, CAST(1 AS INTEGER) AS ordinal, 'body' AS fault FROM documents WHERE doc_id % 29 = 0
UNION ALL SELECT doc_id, 1, 'tree' FROM documents WHERE doc_id % 31 = 0 AND doc_id % 29 <> 0
UNION ALL SELECT doc_id, 2, 'lines' FROM documents WHERE doc_id % 37 = 0""",
    "chunker_long": f"""
WITH x AS (SELECT doc_id, {_X} AS x FROM documents), n AS (SELECT doc_id, x, length(x) AS n, CAST(ceil(length(x) / {PARAGRAPH}.0) AS INTEGER) AS k, CAST(ceil(length(x) / {CELL}.0) AS INTEGER) AS r FROM x WHERE length(x) > 0),
body AS (SELECT *, n + 3 * k AS whole, (n - 1) % {PARAGRAPH} + 2 AS last FROM n),
-- two paragraphs of 150 fit 400 with the title's 2 characters; a third one if it is the last and short enough
runs AS (SELECT *, CASE WHEN 2 + whole <= 600 THEN 1 WHEN k % 2 = 1 AND 2 + 304 + last + 1 <= 400 THEN k // 2 ELSE (k + 1) // 2 END AS m FROM body),
p AS (SELECT doc_id, x, k, whole, m, unnest(range(m)) AS i FROM runs),
q AS (SELECT *, 2 * i AS lo, CASE WHEN i = m - 1 THEN k ELSE 2 * i + 2 END AS hi FROM p),
pc AS (SELECT doc_id, 0 AS section_ordinal, i AS ordinal, lo + 1 AS lo, hi, CASE WHEN m = 1 AND 2 + whole <= 600 THEN 1 ELSE 0 END AS tail,
  list_aggregate(list_transform(range(lo, hi), lambda j: 'w' || substr(x, j * {PARAGRAPH} + 1, {PARAGRAPH}) || chr(10) || chr(10)), 'string_agg', '') AS raw FROM q),
ps AS (SELECT doc_id, section_ordinal, ordinal, CASE WHEN tail = 1 THEN raw ELSE raw[:-2] END AS raw, 2 * lo AS line_start, 2 * hi + tail AS line_end FROM pc),
-- a row has ten characters beside its cell's, the header two lines of 10: seven rows to a chunk of 800, and a short last one
t AS (SELECT *, CASE WHEN r <= 7 THEN 1 WHEN r > 8 AND r % 7 = 1 AND (n - 1) % {CELL} + 1 <= 18 THEN r // 7 ELSE CAST(ceil(r / 7.0) AS INTEGER) END AS m FROM n),
u AS (SELECT doc_id, x, k, r, m, unnest(range(m)) AS i FROM t),
v AS (SELECT *, 7 * i AS lo, CASE WHEN i = m - 1 THEN r ELSE 7 * i + 7 END AS hi FROM u),
ts AS (SELECT doc_id, 1 AS section_ordinal, i AS ordinal, CASE WHEN i = 0 THEN '| h | x |' || chr(10) || '|---|---|' || chr(10) ELSE '' END
    || list_aggregate(list_transform(range(lo, hi), lambda j: '| w' || substr(x, j * {CELL} + 1, {CELL}) || ' | x |' || chr(10)), 'string_agg', '') AS raw,
  2 * k + 3 + CASE WHEN i = 0 THEN 0 ELSE 2 + lo END AS line_start, 2 * k + 4 + hi AS line_end FROM v),
e AS (SELECT doc_id, 0 AS section_ordinal, 0 AS ordinal, '| h | x |' || chr(10) || '|---|---|' || chr(10) AS raw, 3 AS line_start, 4 AS line_end FROM x WHERE length(x) = 0)
SELECT doc_id, CAST(section_ordinal AS INTEGER) AS section_ordinal, CAST(ordinal AS INTEGER) AS ordinal, CAST(2 + length(raw) AS INTEGER) AS token_count, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end,
  sha256(raw) AS raw_hash FROM (SELECT * FROM ps UNION ALL SELECT * FROM ts UNION ALL SELECT doc_id, 1, ordinal, raw, line_start, line_end FROM e)""",
}
