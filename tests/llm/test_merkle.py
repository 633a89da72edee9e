import hashlib
import zlib

import pytest

from folio.llm import merkle
from pyspark.sql import functions as F
from tests.duck import same


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and of each leaf what stands before and after it in its run, level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [k // 8 for k in at]
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def fold(hashed: str, path) -> str:
    for before, after in path:
        hashed = sha(before + hashed + after)
    return hashed


def brute(rows) -> list[str]:
    """Of (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row, leaf(row)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for each in by_lang.values():
        each.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    below = [tree([h for _, h in by_lang[lang]]) for lang in langs]
    root, above = tree([r for r, _ in below])
    out = []
    for lang, (subroot, paths), over in zip(langs, below, above):
        for (row, hashed), path in zip(by_lang[lang], paths):
            path, start = path + over, hashed
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                start = leaf((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4])))
            end = fold(start, path)
            out.append(repr((row[0], hashed, subroot, root, sha("".join(a + b for a, b in path)), end, end == root)))
    return sorted(out)


def found(spark, docs, tmp_path, name) -> list[str]:
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted(repr(tuple(r)) for r in merkle.op12_merkle(spark, f"{tmp_path}/{name}").collect())


def test_odd_rows(spark, odd, odd_rows, tmp_path):
    want = brute([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows])
    assert found(spark, odd, tmp_path, "odd") == want


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64, 65, 1], [513, 1, 7, 63] + [1] * 70], ids=str)
def test_sizes_of_trees(spark, sizes, tmp_path):
    """Lone leaves, full runs, short last runs of one, and as many trees as take three levels themselves."""
    rows, lang = [], 0
    for n in sizes:
        name = None if lang == 0 else f"l{lang}é" if lang % 2 else f"L{lang}"
        rows += [(i * 7 % 1009, None if i % 11 == 0 else f"s{i}", name, None if i % 5 == 0 else i, None if i % 13 == 0 else f"Text Ä {i}") for i in range(n)]
        lang += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(spark, docs, tmp_path, "docs") == brute(rows)


def test_rows_alike_are_spread(spark, tmp_path):
    """Rows that are alike in all fields are leaves of their own."""
    rows = [(4, "s", "en", 1, "Same")] * 300 + [(5, "s", "en", 1, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert found(spark, docs, tmp_path, "alike") == brute(rows)


def test_nothing(spark, nothing, tmp_path):
    assert found(spark, nothing, tmp_path, "none") == []


def test_store_and_root(spark, odd, tmp_path):
    one = merkle.Manifest.build(odd, f"{tmp_path}/a")
    assert one.root() == merkle.Manifest.build(odd.repartition(7), f"{tmp_path}/b").root()
    changed = odd.withColumn("text", F.when(F.col("doc_id") == 3, "ONE").otherwise(F.col("text")))
    assert one.root() != merkle.Manifest.build(changed, f"{tmp_path}/c").root()
    stored = spark.read.parquet(f"{tmp_path}/a/trees")
    assert {r["level"] for r in stored.select("level").distinct().collect()} == {0, 1}
    assert stored.where("level = 0").select(F.sum(F.size("nodes"))).head()[0] == odd.count()


def test_equals_its_sql(spark, small):
    same(merkle.op12_merkle(spark, small), merkle.ORACLE, small)
