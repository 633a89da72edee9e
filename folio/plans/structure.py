"""Queries of sources, text structure, metadata, chunks and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.identity import config_hash_column, content_hash_column
from folio.functions.paths import canonical_path, compiled, path_error, selected
from folio.functions.text import cut, let, physical_lines, pieces, running
from folio.operators import chunking, markdown, metadata
from folio.plans import corpus
from folio.session import table


def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir)
    return rows.select("doc_id", "source_path", selected(F.col("source_path"), corpus.INCLUDE, corpus.EXCLUDE).alias("selected"))


RAW_PATH = "CASE page_id % 6 WHEN 0 THEN substr(url, 9) WHEN 1 THEN './' || substr(url, 9) || '//x/./y' WHEN 2 THEN substr(url, 8) WHEN 3 THEN 'a/../' || url WHEN 4 THEN replace(url, '/', chr(92)) ELSE '.' END"


def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select("page_id", F.expr(RAW_PATH).alias("raw_path"))
    return raw.select("page_id", "raw_path", path_error(F.col("raw_path")).alias("error"), canonical_path(F.col("raw_path")).alias("canonical"))


def content_dedup_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir).select("doc_id", "source_path", content_hash_column(F.coalesce("text", F.lit(""))).alias("content_hash"))
    origins = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_origins"), F.min("doc_id").alias("first_doc_id"))
    return rows.join(origins, "content_hash").select("doc_id", "source_path", "content_hash", "n_origins", "first_doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(physical_lines(F.col("text"))).alias("at", "line"))
    return rows.select("doc_id", (F.col("at") + 1).alias("line_number"), "line")


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections(corpus.markdown_documents(spark, sf_dir))
    return found.select(
        "doc_id", "ordinal", F.coalesce("parent_ordinal", F.lit(-1)).alias("parent_ordinal"), "level", "heading", F.array_join("heading_path", " / ").alias("path"), "line_start", "line_end", content_hash_column(F.col("body")).alias("body_hash")
    )


def block_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections(corpus.markdown_documents(spark, sf_dir))
    top = F.filter("blocks", lambda b: b["parent_block_id"].isNull())
    return found.select(
        "doc_id", "ordinal", F.array_join(F.transform(top, lambda b: b["kind"]), ",").alias("kinds"), F.size("blocks").alias("n_blocks"),
        (F.array_join(F.transform(top, lambda b: b["raw_text"]), "") == F.col("body")).alias("covered"),
    )


def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir)
    found = metadata.expressions(F.col("source_path"), F.col("first_lines"))
    return rows.select("doc_id", *((c.cast("string") if n == "document_date" else c).alias(n) for n, c in found.items()))


def metadata_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.occurrences(spark, sf_dir)
    return metadata.extracted(rows, "doc_id").select(
        "doc_id", F.col("document_date").cast("string").alias("document_date"), "document_version", "version_scope", "decision_state", "owner_domain"
    )


CHUNK_CONFIG = chunking.config_identity(chunking.Limits(), "characters", "1", "folio", "1")


STEP = chunking.Limits.target - chunking.Limits.overlap


def _windows(spark: SparkSession, sf_dir: str, context: bool = False) -> DataFrame:
    """The windows of each document, cut from its pieces of ``STEP`` characters, so no row carries more than its window
    (and its context): a document costs in proportion to its length."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    most = chunking.Limits.parent

    def around(w, parts, n):
        start = F.when(n <= most, F.lit(0)).otherwise(F.least(F.greatest(F.lit(0), w["start"] + w["length"] - most), w["start"]))
        return F.struct(start.alias("start"), cut(parts, STEP, start, F.least(n - start, F.lit(most)), most).alias("text"))

    def window(w, i, parts, known):
        raw = cut(parts, STEP, w["start"], w["length"], chunking.Limits.soft)
        more = [around(w, parts, known).alias("context")] if context else [F.get(known, i).alias("lines_before")]
        return F.struct(w["start"].alias("start"), w["length"].alias("token_count"), raw.alias("raw_text"), *more)

    each = lambda parts, known: F.transform(chunking.character_windows(F.col("text")), lambda w, i: window(w, i, parts, known))
    known = lambda parts: F.length("text") if context else running(F.transform(parts, newlines))
    made = let(pieces(F.col("text"), STEP), lambda parts: let(known(parts), lambda x: each(parts, x)))
    rows = docs.select("doc_id", "source", F.posexplode(made).alias("ordinal", "w")).select("doc_id", "source", "ordinal", "w.*")
    return rows.withColumn("lines_within", newlines(F.col("raw_text")) - F.endswith("raw_text", F.lit("\n")).cast("int"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("doc_id", "ordinal", "start", "token_count", "raw_text")


def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windows(spark, sf_dir)
    columns = {
        "parser_version": F.lit(markdown.PARSER_VERSION), "chunk_config_hash": F.lit(CHUNK_CONFIG), "heading_path": F.array(F.col("source")),
        "line_start": 1 + F.col("lines_before"), "line_end": 1 + F.col("lines_before") + F.col("lines_within"),
        "raw_text": F.col("raw_text"), "search_text": F.concat(F.col("source"), F.lit("\n"), F.col("raw_text")),
    }
    return rows.select("doc_id", "ordinal", columns["line_start"].alias("line_start"), columns["line_end"].alias("line_end"), config_hash_column(**columns).alias("chunk_hash"))


def parent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each window of a one-paragraph document whose tokens are characters."""
    rows = _windows(spark, sf_dir, True)
    return rows.select("doc_id", "ordinal", F.col("context.start").alias("context_start"), F.length("context.text").alias("context_tokens"), content_hash_column(F.col("context.text")).alias("context_hash"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("tokens"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_tokens"))


def scanner_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(markdown.sections(corpus.rich_documents(spark, sf_dir)))


def chunker_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(corpus.rich_documents(spark, sf_dir), chunking.CharacterTokens(), CHUNK_CONFIG)
    return found.select(*(c for c in found.columns if c != "warnings"), F.size("warnings").alias("n_warnings"))


QUERIES = {
    "profile_filter": profile_filter, "canonical_path": canonical_paths, "content_dedup_origins": content_dedup_origins, "physical_lines": lines,
    "heading_sections": heading_sections, "block_cover": block_cover, "metadata_extract": metadata_extract, "metadata_general": metadata_general,
    "chunk_windows": chunk_windows, "chunk_hashes": chunk_hashes, "parent_context": parent_contexts, "token_stats": token_stats,
    "md_scanner_general": scanner_general, "chunker_general": chunker_general,
}

_OCC = f"SELECT doc_id, {corpus.PATH} AS source_path, [{corpus.LINE_1}, {corpus.LINE_2}, {corpus.LINE_3}] AS first_lines, text, source, lang FROM documents"
_ANY = lambda patterns: " OR ".join(f"regexp_matches('/' || source_path, '{compiled(p)}')" for p in patterns)
_MD = f"SELECT doc_id, {corpus.MARKDOWN} AS text, source, lang, 'x ' || {corpus.FLAT} AS flat FROM documents"
_VALUE = lambda key: f"nullif(list_filter(list_transform(first_lines, lambda x: CASE WHEN starts_with(x, '{key}:') THEN trim(substr(x, {len(key) + 2})) END), lambda x: x IS NOT NULL), [])[1]"
_META = rf"""
WITH o AS ({_OCC}), s AS (
  SELECT *, regexp_replace(split_part(source_path, '/', -1), '\.[^.]*$', '') AS stem,
         {_VALUE("작성일")} AS d, {_VALUE("버전")} AS v, {_VALUE("상태")} AS st FROM o
), f AS (
  SELECT *, regexp_extract(stem, '^(\d{{4}}-\d{{2}}-\d{{2}})($|[-_])', 1) AS fd,
         regexp_extract(coalesce(v, ''), '^v([0-9]+(\.[0-9]+)*)$', 1) AS v1, regexp_extract(stem, '(^|[-_])v([0-9]+(\.[0-9]+)*)($|[-_])', 2) AS v2,
         (regexp_matches(stem, '확정기록|결정서') AND NOT regexp_matches(stem, '미확정|불확정|확정 전')) OR coalesce(st IN ('확정', '[확정]'), false) AS confirmed,
         regexp_matches(stem, '초안|제안안|가설|진행메모') AS draft FROM s
)
SELECT doc_id, CAST(coalesce(try_cast(d AS DATE), try_cast(nullif(fd, '') AS DATE)) AS VARCHAR) AS document_date,
       CASE WHEN v1 <> '' THEN v1 WHEN v2 <> '' THEN v2 END AS document_version,
       CASE WHEN list_contains(string_split(source_path, '/'), 'versions') THEN 'historical' ELSE 'current' END AS version_scope,
       CASE WHEN confirmed = draft THEN 'unknown' WHEN confirmed THEN 'confirmed' ELSE 'draft' END AS decision_state,
       CASE WHEN split_part(source_path, '/', 1) IN ('docs', 'uiux') THEN split_part(source_path, '/', 1) END AS owner_domain
FROM f"""
_WIN = """
WITH n AS (SELECT doc_id, source, text, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S')),
k AS (SELECT *, CAST(greatest(0, ceil((n - 600) / 336.0)) AS INTEGER) AS last FROM n),
w AS (SELECT doc_id, source, text, n, last, unnest(range(0, last + 1)) AS i FROM k),
c AS (SELECT doc_id, source, text, n, CAST(i AS INTEGER) AS ordinal, CAST(i * 336 AS INTEGER) AS start, CAST(CASE WHEN i = last THEN n - i * 336 ELSE 400 END AS INTEGER) AS token_count FROM w)
"""
_LINE = lambda end: f"CAST(1 + length(substr(text, 1, {end})) - length(replace(substr(text, 1, {end}), chr(10), '')) AS INTEGER)"
_N = "chr(10)"
#: The sections of the rich documents (heading, path, body), and the pieces that stand in them.
_RICH = f"""
p AS (SELECT doc_id, {", ".join(f"{corpus.part(k, ", 'g'")} AS p{k}" for k in range(8))}, 'w' || {corpus.FLAT} AS flat FROM documents),
k AS (SELECT *, '- ' || p2 || {_N} AS i1, '- ' || p3 || {_N} AS i2, '> ' || p4 || {_N} AS q, '```' || {_N} || '# ' || p6 || {_N} || '```' || {_N} AS code,
  '| ' || p7 || ' | b |' || {_N} AS r1, '| 1 | ' || p0 || ' |' || {_N} AS r2, '1. ' || p3 || {_N} AS o1, '2. ' || p4 || {_N} AS o2 FROM p),
t AS (SELECT *, r1 || '|---|---|' || {_N} || r2 AS tab, i1 || i2 || {_N} AS list FROM k)"""
#: ordinal, block_id, parent_block_id, depth, kind, raw_text, line_start, line_end of every block.
_BLOCKS = [
    (0, 0, "NULL", 0, "paragraph", f"flat || {_N}", 2, 2), (0, 1, "NULL", 0, "blank", _N, 3, 3),
    (1, 0, "NULL", 0, "bullet_list", "list", 5, 7), (1, 1, 0, 1, "list_item", "i1", 5, 5), (1, 2, 1, 2, "paragraph", "i1", 5, 5), (1, 3, 0, 1, "list_item", f"i2 || {_N}", 6, 7),
    (1, 4, 3, 2, "paragraph", "i2", 6, 6), (1, 5, "NULL", 0, "blockquote", "q", 8, 8), (1, 6, 5, 1, "paragraph", "q", 8, 8), (1, 7, "NULL", 0, "blank", _N, 9, 9),
    (2, 0, "NULL", 0, "fenced_code", "code", 11, 13), (2, 1, "NULL", 0, "blank", _N, 14, 14), (2, 2, "NULL", 0, "table", "tab", 15, 17), (2, 3, 2, 1, "table_row", "r1", 15, 15),
    (2, 4, 2, 1, "table_row", "r2", 17, 17), (2, 5, "NULL", 0, "blank", _N, 18, 18),
    (3, 0, "NULL", 0, "ordered_list", "o1 || o2", 20, 21), (3, 1, 0, 1, "list_item", "o1", 20, 20), (3, 2, 1, 2, "paragraph", "o1", 20, 20), (3, 3, 0, 1, "list_item", "o2", 21, 21), (3, 4, 3, 2, "paragraph", "o2", 21, 21),
]
_RICH_CHUNKS = f"""
{_RICH}, s AS (
  SELECT doc_id, 1 AS section_ordinal, 5 AS a, 9 AS b, [p0, p1] AS path, list || q || {_N} AS body FROM t
  UNION ALL SELECT doc_id, 2, 11, 18, [p0, p1, p5], code || {_N} || tab || {_N} FROM t
  UNION ALL SELECT doc_id, 3, 20, 21, [p0, p2], o1 || o2 FROM t
  UNION ALL SELECT doc_id, 0, 2, 3, [p0], flat || {_N} || {_N} FROM t WHERE length(p0) + length(flat) + 3 <= 600
), n AS (SELECT doc_id, p0, flat || {_N} AS para, length(flat) + 1 AS n, length(p0) + 1 AS own, 336 - length(p0) - 1 AS step FROM t WHERE length(p0) + length(flat) + 3 > 600),
l AS (SELECT *, CAST(greatest(0, ceil((n - 600 + own) / step::DOUBLE)) AS INTEGER) AS last FROM n), w AS (SELECT *, unnest(range(0, last + 1)) AS i FROM l),
c AS (
  SELECT doc_id, section_ordinal, 0 AS ordinal, body AS raw_text, a AS line_start, b AS line_end, path FROM s
  UNION ALL SELECT doc_id, 0, i, substr(para, i * step + 1, CASE WHEN i = last THEN n ELSE 400 - own END), 2, 2, [p0] FROM w
), x AS (SELECT doc_id, CAST(section_ordinal AS INTEGER) AS section_ordinal, CAST(ordinal AS INTEGER) AS ordinal, raw_text, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, path,
  array_to_string(path, {_N}) || {_N} || raw_text AS search_text FROM c)"""
ORACLES = {
    "md_scanner_general": f"""
WITH {_RICH}, b AS (SELECT doc_id, unnest([{", ".join("struct_pack(" + ", ".join(f"{n} := {v}" for n, v in zip(("ordinal", "block_id", "up", "depth", "kind", "raw_text", "line_start", "line_end"), (*map(str, b[:4]), f"'{b[4]}'", *map(str, b[5:])))) + ")" for b in _BLOCKS)}]) AS b FROM t)
SELECT doc_id, CAST(b.ordinal AS INTEGER) AS ordinal, CAST(b.block_id AS INTEGER) AS block_id, CAST(b.up AS INTEGER) AS parent_block_id, CAST(b.depth AS INTEGER) AS depth, b.kind AS kind, b.raw_text AS raw_text,
  CAST(b.line_start AS INTEGER) AS line_start, CAST(b.line_end AS INTEGER) AS line_end FROM b""",
    "chunker_general": f"""
WITH {_RICH_CHUNKS} SELECT doc_id, section_ordinal, ordinal, raw_text, search_text, CAST(length(search_text) AS INTEGER) AS token_count, line_start, line_end,
  sha256(CAST(to_json({{'chunk_config_hash': '{CHUNK_CONFIG}', 'heading_path': path, 'line_end': line_end, 'line_start': line_start, 'parser_version': '{markdown.PARSER_VERSION}', 'raw_text': raw_text, 'search_text': search_text}}) AS VARCHAR)) AS chunk_hash,
  CAST(0 AS INTEGER) AS n_warnings FROM x""",
    "profile_filter": f"WITH o AS ({_OCC}) SELECT doc_id, source_path, ({_ANY(corpus.INCLUDE)}) AND NOT ({_ANY(corpus.EXCLUDE)}) AS selected FROM o",
    "canonical_path": f"""
WITH r AS (SELECT page_id, {RAW_PATH} AS raw_path FROM pages), s AS (
  SELECT *, list_filter(string_split(raw_path, '/'), lambda x: x <> '' AND x <> '.') AS kept,
         CASE WHEN raw_path = '' THEN 'empty' WHEN contains(raw_path, chr(92)) THEN 'backslash' WHEN starts_with(raw_path, '/') THEN 'absolute'
              WHEN list_contains(string_split(raw_path, '/'), '..') THEN 'parent' END AS e FROM r
)
SELECT page_id, raw_path, coalesce(e, CASE WHEN len(kept) = 0 THEN 'empty' END) AS error,
       CASE WHEN e IS NULL AND len(kept) > 0 THEN array_to_string(kept, '/') END AS canonical FROM s""",
    "content_dedup_origins": f"""
WITH o AS (SELECT *, sha256(coalesce(text, '')) AS content_hash FROM ({_OCC}))
SELECT doc_id, source_path, content_hash, count(*) OVER (PARTITION BY content_hash) AS n_origins, min(doc_id) OVER (PARTITION BY content_hash) AS first_doc_id FROM o""",
    "physical_lines": r"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+') AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS line_number, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)""",
    "heading_sections": f"""
WITH m AS ({_MD}), l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM m),
e AS (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM l),
f AS (SELECT doc_id, lines, i, lines[i] AS line, sum(CASE WHEN lines[i] = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM e),
h AS (SELECT doc_id, lines, i, length(regexp_extract(line, '^#+')) AS level, trim(regexp_extract(line, '^#+ (.*)$', 1)) AS heading FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}} ')
      UNION ALL SELECT doc_id, lines, 0, 0, NULL FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, lead(i, 1, len(lines)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS last FROM h),
p AS (SELECT o.*, (SELECT max(q.ordinal) FROM o q WHERE q.doc_id = o.doc_id AND q.ordinal < o.ordinal AND q.level < o.level AND q.level > 0) AS parent FROM o)
SELECT p.doc_id, CAST(p.ordinal AS INTEGER) AS ordinal, CAST(coalesce(p.parent, -1) AS INTEGER) AS parent_ordinal, CAST(p.level AS INTEGER) AS level, p.heading,
       CASE WHEN p.level = 0 THEN '' WHEN q.heading IS NULL THEN p.heading ELSE q.heading || ' / ' || p.heading END AS path,
       CAST(greatest(p.i, 1) AS INTEGER) AS line_start, CAST(p.last AS INTEGER) AS line_end,
       sha256(list_aggregate(list_transform(p.lines[p.i + 1 : p.last], lambda x: x || chr(10)), 'string_agg', '')) AS body_hash
FROM p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.ordinal = p.parent""",
    "block_cover": """
SELECT doc_id, CAST(o AS INTEGER) AS ordinal,
       CASE o WHEN 0 THEN 'paragraph' WHEN 1 THEN 'paragraph,blank' WHEN 3 THEN 'paragraph'
              ELSE CASE doc_id % 3 WHEN 0 THEN 'fenced_code,blank' WHEN 1 THEN 'table,blank' ELSE 'bullet_list' END END AS kinds,
       CAST(CASE o WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END END AS INTEGER) AS n_blocks, true AS covered
FROM documents, (SELECT unnest([0, 1, 2, 3]) AS o)""",
    "metadata_extract": _META,
    "metadata_general": _META,
    "chunk_windows": f"{_WIN} SELECT doc_id, ordinal, start, token_count, substr(text, start + 1, token_count) AS raw_text FROM c",
    "chunk_hashes": f"""{_WIN}, r AS (SELECT *, substr(text, start + 1, token_count) AS raw_text, {_LINE("start")} AS line_start, {_LINE("start + token_count - 1")} AS line_end FROM c)
SELECT doc_id, ordinal, line_start, line_end, sha256(CAST(to_json({{'chunk_config_hash': '{CHUNK_CONFIG}', 'heading_path': [source], 'line_end': line_end, 'line_start': line_start,
  'parser_version': '{markdown.PARSER_VERSION}', 'raw_text': raw_text, 'search_text': source || chr(10) || raw_text}}) AS VARCHAR)) AS chunk_hash FROM r""",
    "parent_context": f"""{_WIN}, x AS (SELECT *, CASE WHEN n <= 1200 THEN 0 ELSE least(greatest(0, start + token_count - 1200), start) END AS s FROM c),
y AS (SELECT *, CASE WHEN n <= 1200 THEN n ELSE least(n - s, 1200) END AS t FROM x)
SELECT doc_id, ordinal, CAST(s AS INTEGER) AS context_start, CAST(t AS INTEGER) AS context_tokens, sha256(substr(text, s + 1, t)) AS context_hash FROM y""",
    "token_stats": "SELECT lang, source, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS tokens, max(length(coalesce(text, ''))) AS longest, round(avg(length(coalesce(text, ''))), 6) AS mean_tokens FROM documents GROUP BY ALL",
}
