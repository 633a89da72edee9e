"""Fixture tables derived from the driver's tables by expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import table

STEM = (
    "CASE doc_id % 6 WHEN 0 THEN '2024-0' || (1 + doc_id % 9) || '-15-note-' || doc_id"
    " WHEN 1 THEN 'spec-v' || (doc_id % 4) || '.' || (doc_id % 3) || '-' || doc_id"
    " WHEN 2 THEN '확정기록-' || doc_id WHEN 3 THEN '초안-' || doc_id WHEN 4 THEN '미확정-결정서-' || doc_id ELSE 'doc-' || doc_id END"
)
PATH = (
    "CASE WHEN doc_id % 11 = 0 THEN 'uiux/' WHEN doc_id % 13 = 0 THEN 'docs/raw/' ELSE 'docs/research/' END || source || '/'"
    f" || CASE WHEN doc_id % 7 = 0 THEN 'versions/' ELSE '' END || {STEM} || CASE WHEN doc_id % 17 = 0 THEN '.png' ELSE '.md' END"
)
LINE_1 = "CASE WHEN doc_id % 2 = 0 THEN 'intro' WHEN doc_id % 3 = 0 THEN '작성일: 2024-02-30' ELSE '작성일: 2024-0' || (1 + doc_id % 9) || '-1' || (doc_id % 9) END"
LINE_2 = "CASE WHEN doc_id % 3 = 0 THEN '버전: v' || (doc_id % 5) || '.1' WHEN doc_id % 3 = 1 THEN '버전: draft' ELSE 'note' END"
LINE_3 = "CASE WHEN doc_id % 4 = 0 THEN '상태: [확정]' ELSE '상태: 검토' END"
#: One line of text, so that a document's own lines can't open blocks.
FLAT = "replace(coalesce(text, ''), chr(10), ' ')"
MARKDOWN = (
    f"'preamble ' || doc_id || chr(10) || '# ' || source || chr(10) || 'x ' || {FLAT} || chr(10) || chr(10) || '### ' || lang || chr(10)"
    " || CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) WHEN doc_id % 3 = 1 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10)"
    " ELSE '- one' || chr(10) || '- two' || chr(10) END || chr(10) || '## tail' || chr(10) || 'end' || chr(10)"
)


def part(k: int, all_of: str = "") -> str:
    """Some letters and digits of a document's own text; ``all_of`` is what an engine needs to replace every match."""
    return f"('w' || trim(regexp_replace(substr(coalesce(text, ''), {1 + 60 * k}, 60), '[^a-zA-Z0-9À-ɏ ]', ''{all_of})))"


def rich(all_of: str = "") -> str:
    """A document's own text in titles, a paragraph, lists, a quote, a fence and a table."""
    p = [part(k, all_of) for k in range(8)]
    parts = [
        "# ", p[0], "\n", f"'w' || {FLAT}", "\n\n## ", p[1], "\n- ", p[2], "\n- ", p[3], "\n\n> ", p[4], "\n\n### ", p[5], "\n```\n# ", p[6], "\n```\n\n| ", p[7],
        " | b |\n|---|---|\n| 1 | ", p[0], " |\n\n## ", p[2], "\n1. ", p[3], "\n2. ", p[4], "\n",
    ]
    literal = lambda x: " || ".join(" || chr(10) || ".join(f"'{y}'" for y in x.split("\n")).split(" || "))
    return " || ".join(x if i % 2 else literal(x) for i, x in enumerate(parts))


INCLUDE = ["docs/research/**/*.md", "docs/planning/**/*.md", "uiux/**/*.md"]
EXCLUDE = ["docs/raw/**", "**/src1/**", "**/[s]rc?/versions/**"]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_path, first_lines, text, source, lang of every document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(PATH).alias("source_path"), F.expr(f"array({LINE_1}, {LINE_2}, {LINE_3})").alias("first_lines"), "text", "source", "lang"
    )


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))


def rich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(rich()).alias("text"))
