import random
import re
import zlib
from collections import Counter

import pytest

from folio.llm import spelling
from tests.duck import same


def apart(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows) -> list[str]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            at = h % len(low)
            counts[low[:at] + low[at + 1 :] if h % 97 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, ()) if apart(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(repr((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None)) for w, n in words.items())


def found(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_odd_rows(spark, odd, odd_rows):
    assert found(spelling.variants(odd)) == brute([(r[0], r[1]) for r in odd_rows])


def test_nothing(nothing):
    assert spelling.variants(nothing).collect() == []


@pytest.mark.parametrize("letters,most", [("ab", 9), ("abcd", 6), ("aéÿz", 7)])
def test_random_words(spark, letters, most):
    """Few letters: many repeated bigrams, ties and near words of every kind."""
    pick = random.Random(len(letters) + most)
    word = lambda: "".join(pick.choice(letters) for _ in range(pick.randint(4, most)))
    rows = [(i, " ".join(w for w in (word() for _ in range(60)) for _ in range(pick.choice((1, 1, 3, 7))))) for i in range(40)]
    want = brute(rows)
    assert len(want) > 50
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_long_words_and_chains(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    chain = ["abcdefgh"[:i] + "x" * (8 - i) for i in range(9)]  # each differs by one code point from the next
    text = " ".join([long] * 9 + [long[:15_000] + long[15_001:]] * 3 + ["y" + long] * 4 + [w for i, w in enumerate(chain) for _ in range(3 << i)])
    rows = [(5, text), (6, "Ünïcode ÜNÏCODE ünïcode ×÷×÷× ×÷×÷× ×÷×÷×")]
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_equals_its_sql(spark, small):
    same(spelling.op11_spelling(spark, small), spelling.ORACLE, small)
