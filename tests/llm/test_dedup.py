import hashlib
import re
from collections import defaultdict

import pytest

from folio.llm import components, exact_dedup, near_dup, shingles
from tests.duck import same


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), (doc_id is not None, doc_id), doc_id))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: x[:2])[2]
        best = min(x[:2] for x in own)
        first = True
        for x in sorted(own, key=lambda x: x[:2]):
            out.append((x[2], keep, len(own), x[:2] == best and first, hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    return sorted(map(repr, out))


@pytest.mark.parametrize("shares", [512, 3])
def test_exact_copies(odd, odd_rows, nothing, monkeypatch, shares):
    monkeypatch.setattr(exact_dedup, "SHARES", shares)  # few shares make hot groups of small ones
    got = exact_dedup.content_sort(odd).collect()
    assert sorted(repr(tuple(r)) for r in got) == exact_brute([r[:2] for r in odd_rows])
    assert exact_dedup.content_sort(nothing).count() == 0


def test_exact_query_equals_its_sql(spark, small):
    same(exact_dedup.op9_exact_dedup(spark, small), exact_dedup.ORACLE, small)


def test_exact_stage(spark, odd, small):
    kept = exact_dedup.stage(spark, odd, small)
    assert kept.columns == odd.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in odd.collect()})


def test_exact_stage_of_rows_that_share_an_id(spark, small):
    rows = [
        (5, "a b", "s", "x"), (5, "a   b", "t", "y"), (7, "ab", "u", "z"), (5, "c", "v", "w"), (8, "d ", "v", "w"), (8, "d", "v", "w"), (9, "d", "v", "w"),
        (None, "e", "v", "w"), (None, "e ", "q", "w"), (1, "e", "v", "w"), (None, None, "v", "w"), (None, " ", "r", "w"), (4, "f", "1", "2"), (4, "f", "1", "2"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __sha string, __id string").repartition(3)
    kept = exact_dedup.stage(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (rows[i] for i in (1, 3, 4, 8, 11, 12))))


def test_a_hot_text_without_ids_is_dealt(spark):
    docs = spark.createDataFrame([(None, "same text")] * 10_000 + [(i, f"text {i}") for i in range(200)], "doc_id bigint, text string").repartition(4)
    got = exact_dedup.content_sort(docs).where("doc_id IS NULL").groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(10_000, False, 9_999), (10_000, True, 1)]


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(repr((i, len(s), None if i is None else i if not s else least[root(k)])) for k, (i, s) in enumerate(sets))


def test_near_copies(odd, odd_rows, nothing):
    got = near_dup.near_duplicates(odd).collect()
    assert sorted(repr(tuple(r)) for r in got) == near_brute([r[:2] for r in odd_rows])
    assert near_dup.near_duplicates(nothing).count() == 0


def test_near_query_equals_its_sql(spark, small):
    same(near_dup.op10_near_dup(spark, small), near_dup.ORACLE, small)


def test_a_group_around_the_threshold_in_many_blocks(spark, monkeypatch):
    """Many variants of one text, about half of which link, with a passage that all share, in tiles dealt over blocks."""
    import random

    for name, value in (("BLOCK", 16), ("MEMBERS", 9), ("RANGE", 64), ("NEXT", 2), ("PIVOTS", 3), ("FLUSH", 200)):
        monkeypatch.setattr(near_dup, name, value)
    pick = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(60)] = f"x{pick.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([f"y{i}-{k}" for k in range(12)] + base[:30])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(repr(tuple(r)) for r in near_dup.near_duplicates(docs).collect()) == near_brute(rows)


def test_a_large_group_of_short_variants(spark):
    """Under the constants as they are: thousands of variants of one short text, most of which link with few others."""
    import random

    pick = random.Random(8)
    base = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join([*base, *(f"x{pick.randrange(40)}" for _ in range(pick.randint(0, 3)))])) for i in range(3_000)]
    rows += [(i, " ".join(["a" if pick.random() < 0.1 else w for w in base])) for i in range(3_000, 4_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    least = {}
    for i, text in rows:
        least.setdefault(frozenset(shingle_set(text)), i)
    one = near_brute([(i, text) for i, text in rows if least[frozenset(shingle_set(text))] == i])
    of = {eval(r)[0]: eval(r)[1:] for r in one}
    expected = sorted((i, *of[least[frozenset(shingle_set(text))]]) for i, text in rows)
    assert sorted(map(tuple, near_dup.near_duplicates(docs).collect())) == expected


def test_blocks_of_large_components_never_meet_themselves(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 4)
    rows = [(1, c, 50, 0, 0, True) for c in range(30)] + [(2, c, 50, 0, 0, True) for c in range(3)]
    open_ = spark.createDataFrame(rows, "key bigint, cls bigint, size int, at int, band int, home boolean")
    roots = spark.createDataFrame([(c, 0) for c in range(21)], "node bigint, root bigint")
    got = near_dup.dealt(open_, roots).collect()
    assert {r.key for r in got} == {1}  # the other tile holds one component
    pairs = {}
    for r in got:
        pairs.setdefault((r.lo, r.hi), []).append(r)
    met = set()
    for (lo, hi), own in pairs.items():
        met |= {frozenset((x.cls, y.cls)) for x in own for y in own if x.cls != y.cls and (lo == hi or x.block != y.block)}
    assert {frozenset((x, y)) for x in range(30) for y in range(30) if x < y and y > 20} <= met
    assert not {p for p in met if max(p) <= 20}


def test_pairs_meet_at_home_in_either_band():
    import numpy as np

    size = np.arange(1, 3_000)
    assert (near_dup.band(size) == (np.floor(np.log2(size)) // near_dup.BAND_BITS)).all()
    for s in range(1, 600):
        for t in range(s, s * 5 // 4 + 1):
            a, b = near_dup.band(np.array([s, t])).tolist()
            assert a == b or (b == a + 1 and near_dup.visits(np.array([s]))[0])


def test_long_texts_are_read_in_steps(monkeypatch):
    import numpy as np

    text = (" ".join(f"wört{i % 700}" for i in range(20_000)) + " " * 5_000 + "x" * 9_000 + " end of it").encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = [x.copy() for x in shingles.shingles(data, at)]
    monkeypatch.setattr(shingles, "LONG", 1_000)
    assert all((x == y).all() for x, y in zip(whole, shingles.shingles(data, at)))


def test_near_stage(spark, odd, odd_rows, small):
    kept = near_dup.stage(spark, odd, small)
    assert kept.columns == odd.columns
    goes = {(eval(r)[0], eval(r)[1]) for r in near_brute([r[:2] for r in odd_rows]) if eval(r)[0] != eval(r)[2]}
    expected = [r[:2] for r in odd_rows if r[0] is None or (r[0], len(shingle_set(r[1]))) not in goes]
    assert sorted(map(repr, (tuple(r)[:2] for r in kept.collect()))) == sorted(map(repr, expected))


def test_near_stage_tells_texts_of_one_id_apart(spark, small):
    one, other = "a text of some words that come again here", "quite another text of as many words as that"
    rows = [(1, one, 7, "x"), (5, one, 7, "y"), (5, other, 8, "z"), (6, other, 8, None), (None, one, 9, "n"), (9, None, None, "e"), (9, None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, cls int, cls_ string")
    kept = near_dup.stage(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (rows[i] for i in (0, 2, 4, 5, 6))))


def test_components(spark):
    import random

    pick = random.Random(6)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)] + [(600, k) for k in range(601, 700)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
