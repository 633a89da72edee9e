import numpy as np
import pytest

from folio.operators import search


def nearest(rows, queries, k):
    out = []
    for q, v in queries:
        v = np.array(v, float)
        scored = []
        for i, r in rows:
            if r is None or len(r) != len(v) or any(x is None or not np.isfinite(x) for x in r) or not any(r):
                continue
            r = np.array(r, float)
            scored.append((-round(float(r @ v / np.linalg.norm(r) / np.linalg.norm(v)), 9), i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def top(spark, rows, queries, k, **more):
    frames = spark.createDataFrame(rows, "id long, v array<float>"), spark.createDataFrame(queries, "q long, w array<float>")
    return sorted((r.query_id, r.row_id, round(r.score, 9), r["rank"]) for r in search.vector_top(frames[0], "id", "v", frames[1], "q", "w", k, **more).collect())


def test_vectors_without_direction_and_of_other_dimensions(spark):
    bad = [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [], None]
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.5, 0.5], [1.0, 0.0, 0.0], [0.0, 0.0, 3.0], *bad])]
    queries = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [1.0]), *[(10 + i, v) for i, v in enumerate(bad)]]
    assert top(spark, rows, queries, 5) == nearest(rows, queries[:3], 5)
    assert top(spark, rows, [], 5) == [] and top(spark, [], queries, 5) == []


def test_best_equal_brute_force_with_ties(spark, monkeypatch):
    """Small whole numbers make many ties; blocks of queries and cuts of what a task holds change nothing."""
    made = np.random.default_rng(4)
    rows = [(i, [float(x) for x in made.integers(-2, 3, 4)]) for i in range(500)]
    queries = [(q, [float(x) for x in made.integers(-2, 3, 4)]) for q in range(20)]
    queries = [(q, v) for q, v in queries if any(v)]
    want = nearest(rows, queries, 6)
    got = top(spark, rows, queries, 6)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] or {(a, c, d) for a, _, c, d in got} == {(a, c, d) for a, _, c, d in want}
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    assert top(spark, rows, queries, 6) == got


def test_groups_see_their_own_rows(spark):
    rows = [(i, [1.0, float(i)]) for i in range(10)]
    allowed = spark.createDataFrame([("x", i) for i in range(0, 10, 2)] + [("y", 3)], "who string, row_id long")
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    queries = spark.createDataFrame([(w, 1, [0.0, 1.0]) for w in "xyz"], "who string, q long, w array<float>")
    found = search.vector_top(vectors, "id", "v", queries, "q", "w", 3, allowed, ("who",)).collect()
    assert sorted((r.who, r["rank"], r.row_id) for r in found) == [("x", 1, 8), ("x", 2, 6), ("x", 3, 4), ("y", 1, 3)]


def test_best_keeps_the_first_of_ties():
    best = search._Best(2, 2)
    best.limit = 3
    for ids, scores in (([5, 4], [[1.0, 0.5], [1.0, 0.5]]), ([1, 9], [[1.0, 0.4], [2.0, 0.5]]), ([0], [[1.0, 0.5]])):
        best.add(np.array(ids), np.arange(2), np.array(scores))
    batch = best.batch().to_pydict()
    assert list(zip(batch["at"], batch["row_id"])) == [(0, 9), (0, 0), (1, 0), (1, 4)]


def test_active_descriptors(spark):
    profiles = spark.createDataFrame([("r1",), (None,)], "active_run_id string")
    runs = spark.createDataFrame([("r1", "c1"), ("r2", "c2")], "run_id string, index_config_id string")
    configs = spark.createDataFrame([("c1", '{"model":"m","revision":"1","dimension":3}'), ("c2", '{"model":"n","revision":"1","dimension":4}')], "id string, embedding_config string")
    (active,) = search.active_descriptors(profiles, runs, configs)
    search.check_descriptor(active, ("m", "1", 3))
    with pytest.raises(ValueError):
        search.check_descriptor(active, ("n", "1", 4))


def test_closure_is_one_hop_among_what_is_seen(spark):
    places = spark.createDataFrame([("x", "a", "h1"), ("x", "b", "h2"), ("x", "a2", "h1"), ("y", "a", "h1")], "client_id string, source_path string, content_hash string")
    edges = spark.createDataFrame([("a", "b", "potential_conflict", 2, 3), ("c", "a", "potential_conflict", 1, 1), ("a2", "b", "potential_conflict", 5, 6), ("b", "a", "supersedes", 1, 1)], "from_source_path string, to_source_path string, relation_type string, evidence_line_start int, evidence_line_end int")
    found = spark.createDataFrame([("x", "h1"), ("x", "h2"), ("y", "h1")], "client_id string, content_hash string")
    got = sorted(tuple(r) for r in search.closure(found, places, edges).collect())
    assert got == [("x", "h1", 2, "b:2-3,b:5-6"), ("x", "h2", 2, "a:2-3,a2:5-6")]
