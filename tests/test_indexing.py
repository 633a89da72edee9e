from pyspark.sql import functions as F

from folio.functions import vectors
from folio.operators import chunking, indexing, rules, search

FILES = [
    ("docs/research/a.md", "# A\nbody\n\n## B\n" + "x" * 900 + "\n"), ("docs/research/copy.md", "# A\nbody\n\n## B\n" + "x" * 900 + "\n"),
    ("docs/research/2024-01-02-확정기록.md", "버전: v1.2\n"), ("docs/raw/b.md", "# skipped\n"), ("docs/blank.md", ""),
]


def config(target=400):
    limits = chunking.Limits(target=target)
    return indexing.Config(
        chunking.CharacterTokens(), lambda: vectors.hash_embedder(8), chunking.config_identity(limits, "characters", "1", "folio", "1"), "e" * 64, ("hash", "1", 8), limits,
        ["docs/**/*.md"], ["docs/raw/**"],
    )


def table(spark, files):
    return spark.createDataFrame([(p, bytearray(c.encode() if isinstance(c, str) else c)) for p, c in files], "source_path string, content binary")


def test_a_run_makes_valid_tables_and_reuses_them(spark):
    first = {k: v.cache() for k, v in indexing.build(table(spark, FILES), "run-1", config()).items()}
    assert {k: v.count() for k, v in first.items() if k in ("document_contents", "document_occurrences", "document_parses", "sections")} == {
        "document_contents": 3, "document_occurrences": 4, "document_parses": 3, "sections": 3
    }
    state, found = indexing.status(first)
    assert state == "ready", found.collect()
    assert first["chunks"].count() == first["chunk_embeddings"].count() > 3
    meta = {r.source_path: (r.document_version, r.decision_state) for r in first["document_occurrences"].collect()}
    assert meta["docs/research/2024-01-02-확정기록.md"] == ("1.2", "confirmed")
    second = indexing.build(table(spark, [*FILES[1:], ("docs/new.md", "# New\ntext\n")]), "run-2", config(), first)
    assert second["document_parses"].count() == 1 and second["document_occurrences"].count() == 4
    assert {r.search_text for r in second["chunks"].collect()} == {"New\ntext\n"}
    again = indexing.build(table(spark, FILES), "run-3", config(), first)
    assert again["chunks"].count() == again["chunk_embeddings"].count() == 0
    other = indexing.build(table(spark, FILES), "run-4", config(300), first)
    assert other["document_parses"].count() == 3
    model = indexing.Config(**{**config().__dict__, "embedding_config_hash": "f" * 64, "model": ("hash", "2", 8)})
    moved = indexing.build(table(spark, FILES), "run-5", model, first)
    assert moved["document_parses"].count() == moved["chunks"].count() == 0
    assert {r.chunk_id for r in moved["chunk_embeddings"].collect()} == {r.id for r in first["chunks"].collect()}
    assert {(r.embedding_config_hash, r.model_revision) for r in moved["chunk_embeddings"].collect()} == {("f" * 64, "2")}
    fewer = indexing.build(table(spark, FILES[2:]), "run-6", model, first)
    assert 0 < fewer["chunk_embeddings"].count() < first["chunks"].count()
    for cached in first.values():
        cached.unpersist()


def test_one_bad_document_fails_the_run(spark):
    bad = indexing.build(table(spark, [("docs/a.md", b"\xff"), ("other/b.md", "x")]), "run", config())
    state, found = indexing.status(bad)
    assert state == "failed" and {r.rule for r in found.collect()} >= {"utf8"}


def test_a_path_that_stands_twice_is_two_occurrences_and_fails(spark):
    twice = indexing.build(table(spark, [("docs/a.md", "# A\n"), ("docs/a.md", "# B\n"), ("docs/b.md", "# B\n")]), "run", config())
    assert twice["document_occurrences"].count() == 3
    state, found = indexing.status(twice)
    assert state == "failed" and "unique_run_id_source_path" in {r.rule for r in found.collect()}


def test_references_across_tables(spark):
    parses = spark.createDataFrame([("p1",), ("p2",)], "id string").selectExpr("id", "'c' AS content_id", "'v' AS parser_version", f"'{'a' * 64}' AS chunk_config_hash")
    sections = spark.createDataFrame([("s1", "p1", None), ("s2", "p2", "s1"), ("s3", "p3", None)], "id string, parse_id string, parent_section_id string").selectExpr(
        "*", "CAST(row_number() OVER (ORDER BY id) AS INT) AS ordinal", "1 AS level", "1 AS line_start", "1 AS line_end"
    )
    got = sorted((r.table, r.rule, r.key) for r in rules.database_violations({"document_parses": parses, "sections": sections}).collect())
    assert ("sections", "reference_parse_id", "s3") in got and ("sections", "reference_parse_id_parent_section_id", "s2") in got
    assert ("document_parses", "unique_content_id_parser_version_chunk_config_hash", f"c|v|{'a' * 64}") in got and len(got) == 3


def test_descriptor_guard():
    import pytest

    search.check_descriptor(("m", "r", 8), ("m", "r", 8))
    with pytest.raises(ValueError):
        search.check_descriptor(("m", "r", 8), ("m", "r", 9))


def test_precedence_and_evidence(spark):
    matches = spark.createDataFrame([(1, 7, i, 1.0 / (i + 1)) for i in range(5)] + [(1, 8, 9, 0.9)], "query_id int, p int, row_id bigint, rrf double")
    got = [(r.p, r.score, r.n_matches, r.matches) for r in search.evidence(matches, "p").orderBy("place").collect()]
    assert got == [(7, 1.0, 5, "0,1,2,3,4"), (8, 0.9, 1, "9")]
    assert search.evidence(matches.limit(0), "p").select(F.col("p")).count() == 0


def test_table_functions_equal_the_operators(spark):
    from folio.operators import functions, markdown

    docs = spark.createDataFrame([(str(i), f"# A {i}\n" + "w " * 700 + "\n\n## B\n- x\n- y\n") for i in range(7)] + [("n", None), ("e", " ")], "name string, text string")
    docs.createOrReplaceTempView("folio_test_docs")
    functions.register(spark, chunking.CharacterTokens(), "c")
    rows = lambda df: sorted(map(repr, df.collect()))
    for partition in ("", " PARTITION BY name"):
        found = spark.sql(f"SELECT * FROM folio_chunks(TABLE(SELECT name, text FROM folio_test_docs){partition})")
        want = chunking.chunks(docs, chunking.CharacterTokens(), "c", key="name")
        assert found.schema == want.schema and rows(found) == rows(want)
    found = spark.sql("SELECT name, ordinal, heading, n_blocks FROM folio_sections(TABLE(SELECT name, text FROM folio_test_docs)) WHERE level = 2")
    assert rows(found) == rows(markdown.sections(docs, key="name").where("level = 2").select("name", "ordinal", "heading", F.size("blocks").alias("n_blocks")))
    import pytest

    with pytest.raises(Exception, match="a key and a text"):
        spark.sql("SELECT * FROM folio_chunks(TABLE(SELECT name FROM folio_test_docs))").collect()
