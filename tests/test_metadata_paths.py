import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from folio.functions import paths, text
from folio.operators import metadata, relations

CASES = [
    ("uiux/screens/결정서-메뉴.md", ["버전: v3", "작성일: 2031-11-05"], (date(2031, 11, 5), "3", "current", "confirmed", "uiux")),
    ("docs/plan/2030-10-09_budget.md", ["작성일: 2030-08-07", "작성일: 2030-08-08"], (date(2030, 8, 7), None, "current", "unknown", "docs")),
    ("docs/2030-10-09-budget.md", ["작성일: tomorrow"], (date(2030, 10, 9), None, "current", "unknown", "docs")),
    ("docs/2030-13-09-budget.md", ["작성일: 2030-06-31"], (None, None, "current", "unknown", "docs")),
    ("docs/table.md", ["| 키 | 값 | 비고 |", "|---|---|---|", "| 버전 | v7.0.1 | x |", "| 신뢰도 | 확정 | y |"], (None, "7.0.1", "current", "confirmed", "docs")),
    ("docs/versions/menu_v12.md", ["버전: twelve"], (None, "12", "historical", "unknown", "docs")),
    ("docs/menuv12.md", ["버전: V12"], (None, None, "current", "unknown", "docs")),
    ("docs/menu.md", ["버전: v١.٢"], (None, "١.٢", "current", "unknown", "docs")),
    ("docs/초안-x.md", ["# 제목"], (None, None, "current", "draft", "docs")),
    ("docs/초안-x.md", ["상태: 확정"], (None, None, "current", "unknown", "docs")),
    ("docs/x.md", ["# 가설 하나"], (None, None, "current", "draft", "docs")),
    ("docs/x.md", ["```", "상태: 확정", "```"], (None, None, "current", "unknown", "docs")),
]


@pytest.mark.parametrize("path, lines, expected", CASES)
def test_extract(path, lines, expected):
    assert metadata.extract(path, lines) == expected


def test_expressions_equal_the_scanner_on_plain_lines(spark):
    plain = [(p, x) for p, x, _ in CASES if not any(y.startswith(("|", "#", "`")) for y in x)]
    rows = spark.createDataFrame(plain, "source_path string, first_lines array<string>")
    found = metadata.expressions(F.col("source_path"), F.col("first_lines"))
    got = rows.select("source_path", "first_lines", *(c.alias(n) for n, c in found.items())).collect()
    assert [tuple(r)[2:] for r in got] == [metadata.extract(p, x) for p, x in plain]


def test_only_forty_lines_are_read():
    assert metadata.extract("docs/a.md", [""] * 39 + ["작성일: 2024-02-29"])[0] == date(2024, 2, 29)
    assert metadata.extract("docs/a.md", [""] * 40 + ["작성일: 2024-02-29"])[0] is None
    with pytest.raises(ValueError):
        metadata.extract("other/a.md", [])


PATHS = {
    "notes/garden/beds.md": True, "notes/garden/2030/spring.md": True, "./notes//garden/beds.md": True, "plans/a/b/c.md": True, "plans/top.md": True, "notes/attic/beds.md": False,
    "plans/a/SECRET.md": False, "plans/.cache/b.md": False, "plans/map.svg": False, "notes/garden/beds.md\n": False, "plans/../notes/garden/beds.md": False,
}


def test_profiles_select_paths(spark):
    include, exclude = ["notes/**/*.md", "plans/**/*.md"], ["notes/attic/**", "**/SECRET.md", "**/.cache/**"]
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert {r.p: r.s for r in rows.select("p", paths.selected(F.col("p"), include, exclude).alias("s")).collect()} == PATHS


@pytest.mark.parametrize("pattern, path, fits", [("u/[sp]pec?.md", "u/spec1.md", True), ("u/[sp]pec?.md", "u/spec.md", False), ("[!a]/x", "b/x", True), ("[!a]/x", "a/x", False), ("**", "a/b", True), ("a/**/b", "a/b", True), ("a*b", "a/b", False)])
def test_patterns(spark, pattern, path, fits):
    assert spark.range(1).select(paths.selected(F.lit(path), [pattern], [])).first()[0] is fits


def test_physical_lines_and_blank(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\nlast",), ("a b\u0085c\vd\fe",), ("",), ("\x1c　 ",)], "t string")
    got = rows.select(text.physical_lines(F.col("t")).alias("l"), text.not_blank(F.col("t")).alias("n")).collect()
    assert [(r.l, r.n) for r in got] == [(["a\r\n", "b\r", "c\n", "last"], True), (["a b\u0085c\vd\fe"], True), ([], False), (["\x1c　 "], False)]


ENTRY = {"from_source_path": "d/new.md", "to_source_path": "d/old.md", "relation_type": "supersedes", "evidence_source_path": "d/e.md", "evidence_line_start": 1, "evidence_line_end": 1}


def test_sidecar_format():
    good = json.dumps({"relations": [ENTRY]}).encode()
    assert relations.parse_sidecar(good) == [ENTRY]
    bad = [
        b'{"relations": [], "relations": []}', b"[]", b'{"relations": {}}', b"\xff", json.dumps({"relations": [ENTRY | {"x": 1}]}).encode(),
        json.dumps({"relations": [ENTRY | {"evidence_line_start": True}]}).encode(), json.dumps({"relations": [ENTRY | {"to_source_path": "../x"}]}).encode(),
    ]
    for payload in bad:
        with pytest.raises(ValueError):
            relations.parse_sidecar(payload)


def test_relation_rules(spark):
    conflict = ENTRY | {"relation_type": "potential_conflict"}
    flipped = conflict | {"from_source_path": "d/old.md", "to_source_path": "d/new.md"}
    cases = [ENTRY, ENTRY, conflict, flipped, ENTRY | {"to_source_path": "d/new.md"}, ENTRY | {"relation_type": "x"}, ENTRY | {"to_source_path": "d/none.md"}, ENTRY | {"evidence_line_end": 9}, ENTRY | {"evidence_source_path": "d/bin"}]
    rows = spark.createDataFrame([(i, *(e[k] for k in relations.FIELDS)) for i, e in enumerate(cases)], relations.SCHEMA)
    files = spark.createDataFrame([("d/new.md", 3), ("d/old.md", 3), ("d/e.md", 2), ("d/bin", None)], "source_path string, n_lines int")
    got = sorted((r.position, r.rule) for r in relations.violations(rows, files).collect())
    assert got == [(1, "repeat"), (3, "conflict_twice"), (4, "self"), (5, "type"), (6, "missing"), (7, "past_end"), (8, "encoding")]
    assert relations.exposed(rows).count() == 4
