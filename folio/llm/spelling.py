"""Spelling variants of words, grouped around the form that most texts use.

Method: rare-first q-gram prefix filter. The bigrams of all words are ordered by how often they occur, those of a word by that
order and then by position, and only the three rarest of each word are joined. Two words that differ by one code point share
one of them: such an edit leaves at most two bigrams of either word without a partner, and partners keep their order, so the
first pair of partners is among the first three of both words. Its positions differ by at most one.

The join's key also holds what any such pair has in common: the shorter word's length, and one of the halves that this length
cuts off the words' ends, since one edit can't lie in both. Words of a frequent bigram thus meet in small groups instead of
all with all; keys are hashed, and what meets is verified by the edit distance.

Counts are summed in the tasks before they are shuffled. Chains of forms at least double their counts from word to word, so
following them by doubling takes six rounds at most.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the hash that decides on
deletions; repeated rows count as often as they come; of two near words of one count the first by code points is the form;
words of any length are compared whole; an empty table has no words; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, released, scratch, text_rows, written

#: What a run of letters is, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LATIN, ACCENTED = ord("a"), 0xC0
LETTERS = 26 + 64  # of a to z, and of the accented range
SHORTEST, FEWEST = 5, 3
DROPS = 97
RAREST = 3


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each run of letters, as the word that it counts for: lower-cased, and with a code point less in one of 97."""
    runs = text_rows(docs).select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("low"))
    hashed = low.select("low", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "low")).alias("h"))
    at = (F.col("h") % F.char_length("low")).cast("int")
    less = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.char_length("low")))
    return hashed.select(F.when(F.col("h") % DROPS == 0, less).otherwise(F.col("low")).alias("word"))


def words(docs: DataFrame) -> DataFrame:
    """word and n: how often each word of five code points or more occurs, where that is three times or more."""
    kept = occurrences(docs).where(F.char_length("word") >= SHORTEST)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST)


def bigrams(word: Column) -> Column:
    """The word's bigrams in order, each as a number below the square of the number of letters."""
    code = lambda c: F.when(F.ascii(c) >= ACCENTED, F.ascii(c) - ACCENTED + 26).otherwise(F.ascii(c) - LATIN)
    codes = F.transform(F.split(word, ""), code)
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * LETTERS + b)


def rarity(coded: DataFrame) -> Column:
    """The rank of each bigram, the rarest first, as an array by the bigram's number."""
    seen = coded.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each pair of letters: 8,100 at most
    ranks = [0] * LETTERS**2
    for rank, (gram, _) in enumerate(sorted(seen, key=lambda row: (row["n"], row["gram"]))):
        ranks[gram] = rank
    return F.from_json(F.lit(json.dumps(ranks)), "array<int>")


def prefixes(counted: DataFrame) -> DataFrame:
    """The rows to join: each word's three rarest bigrams with the lengths and halves that a near word can have in common."""
    coded = counted.select("word", bigrams(F.col("word")).alias("grams"))
    ranks = rarity(coded)
    placed = F.array_sort(F.transform("grams", lambda gram, at: F.struct(F.get(ranks, gram).alias("rank"), at.alias("at"))))
    one = coded.select("word", F.char_length("word").alias("size"), F.explode(F.slice(placed, 1, RAREST)).alias("gram"))
    each = one.select("word", "size", F.col("gram.rank").alias("rank"), F.col("gram.at").alias("at"), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("short"))
    head = F.floor(F.col("short") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), head).alias("half")),
        F.struct(F.lit(1).alias("side"), F.substring("word", head - F.col("short"), F.col("short") - head).alias("half")),
    )
    cut = each.select("word", "size", "short", "rank", "at", F.explode(halves).alias("cut"))
    return cut.select("word", "size", "short", "at", F.xxhash64("rank", "short", "cut.side", "cut.half").alias("key"))


def near_pairs(counted: DataFrame) -> DataFrame:
    """a and b: each two words that differ by exactly one inserted, deleted or replaced code point, once."""
    rows = written(prefixes(counted), "prefixes")
    a = rows.where("size = short").select("key", F.col("word").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"))
    b = rows.select("key", F.col("word").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"))
    longer = (F.col("b_size") == F.col("a_size") + 1) | ((F.col("b_size") == F.col("a_size")) & (F.col("a") < F.col("b")))
    met = a.join(b, "key").where(longer & (F.abs(F.col("a_at") - F.col("b_at")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word and root: where the chain of each word of ``forms`` (word, form) ends."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps that have been made
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        later = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if later.where("moved").isEmpty():
            return later.select("word", "root")
        now = later.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts of ``docs``."""
    with scratch(docs.sparkSession):
        counted = released(written(words(docs), "words"))
        pairs = written(near_pairs(counted), "near")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        told = both.join(counted.select(F.col("word").alias("b"), "n"), "b").select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n").alias("near_n"))
        best = told.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
        enough = -F.col("best.less") >= 2 * F.col("n")
        judged = counted.join(best, "word", "left").select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
        judged = released(written(judged, "forms"))
        last = followed(judged.where("form IS NOT NULL"))
        roots = released(written(last, "last-forms"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS n FROM runs GROUP BY 1, 2
), told AS (
  SELECT low, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || low AS said FROM low
), hashed AS (
  SELECT low, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(strlen(said)), lambda i: CAST('0x' || substr(hex(said), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM told, crc
), counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN low[:h % length(low)] || low[h % length(low) + 2:] ELSE low END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1
), words AS (
  SELECT word, n FROM counted WHERE length(word) >= 5 AND n >= 3
), lesser AS (
  SELECT word, word AS key FROM words
  UNION
  SELECT word, word[:i] || word[i + 2:] AS key FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM lesser x JOIN lesser y USING (key) WHERE x.word <> y.word
), near AS (
  SELECT a, b, n AS b_n FROM pairs JOIN words ON b = word
  WHERE length(a) <> length(b)
     OR len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) = 1
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY b_n DESC, encode(b)) AS near, max(b_n) AS near_n FROM near GROUP BY a
), forms AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE steps_of AS (
    SELECT word, word AS at FROM forms
    UNION ALL
    SELECT s.word, f.form AS at FROM steps_of s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
  )
  SELECT s.word, s.at AS root FROM steps_of s JOIN forms f ON f.word = s.at WHERE f.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN chain USING (word)
"""
