import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " norm string, hash bigint, score double, cls bigint, keep_id string, part int, key string"
)


def _rows() -> list[tuple]:
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefghiéß") for _ in range(pick.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(30)
    words = base.split()
    texts = [
        None, "", " \t\n", "one", "two words", base, base, base.replace(" ", "\n"), base + " ", passage, prose(20) + " " + passage, prose(25) + " " + passage,
        " ".join(words[:-2] + ["other", "end"]), " ".join([*words[:60], "x", *words[60:]]), prose(40_000), "a" * 60_000, " " * 3_000 + "x", "!" * 500,
        "mail a.b@c.example.com and b [at] d (dot) org, card 4111 1111 1111 1111, ip 10.0.0.1, call +1 (988) 555-2485", "<|endoftext|> x <|endoftext|>", "ok\x00nul",
        "Ünïcode 漢字 😀 \u200b ﬁ ½", "TWO words", "\x1c\x85　",
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 2}", len(t or ""), "n", i, 0.5, i, "k", 1, "key") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id", "en", "s", 5, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_rows():
    return _rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and further columns with likely names."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
