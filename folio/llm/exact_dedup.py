"""Exact deduplication by content sort.

Method: rows are range-partitioned by sampled splitters over the normalised text's first bytes, its hash and a salt, an
external sort puts equal texts next to each other, and the window operator compares each row's whole normalised text
with its neighbour's to find where a group ends. Splitters carry at most ``PREFIX`` characters of text, so sampling costs
the driver the same whatever the texts' lengths.

Hot groups: texts of which there are more than a share of all rows are dealt over several ranges by a salt (a hash of the
row's place, so that rows without ids, or with one id, are dealt too), in pieces of about that share. A share is a quarter of what a shuffle partition gets, and at most one part in ``SHARES``, so there are
at most as many such texts as shares, twice as many pieces, and only the pieces' leaders meet in a second, small
comparison. Only DataFrame functions run here.

Defined results: of equal texts the row with the most code points in the text as it stands stays, then the one with the
smallest doc_id; a null text counts as empty; empty texts are equal to each other and to texts of white space only;
repeated rows are rows of their own, of which one stays; a null doc_id sorts before others; very long texts are hashed and
compared whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import documents, released, scratch, text_rows, written

PREFIX = 32
SHARES = 512
BROADCAST = 1 << 20  # ids of rows that go, beyond which the join shuffles


def normalised(text):
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_sort(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    rows = text_rows(docs).select("doc_id", "text", normalised(F.col("text")).alias("norm"))
    rows = rows.select(
        "doc_id", "text", F.substring("norm", 1, PREFIX).alias("head"), F.xxhash64("norm").alias("hash"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spot"),
    )
    shares = max(SHARES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(1, docs.count() // shares)
    hot = (
        rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
        .select("hash", F.ceil(F.col("n") / share).alias("pieces"))
    )  # each has more than a share of all rows: as many rows as shares at most
    dealt = rows.join(F.broadcast(hot), "hash", "left").select(
        "doc_id", "text", "head", "hash", F.col("pieces").isNotNull().alias("hot"),
        F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.col("spot"), F.col("pieces"))).cast("int").alias("salt"),
    )
    ranged = dealt.repartitionByRange("head", "hash", "salt").withColumns(
        {"norm": normalised(F.col("text")), "chars": F.coalesce(F.char_length("text"), F.lit(0))}
    ).drop("text")
    piece = Window.partitionBy("head", "hash", "salt", "norm")
    first = piece.orderBy(F.desc("chars"), F.asc("doc_id"))
    local = ranged.select(
        "doc_id", "hash", "salt", "hot", "norm", "chars",
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("lead_id"),
        F.count(F.lit(1)).over(piece).alias("lead_n"),
    ).select(
        "doc_id", "hash", "salt", "hot", "place", "lead_id", "lead_n", "chars",
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("hot") & (F.col("place") == 1), F.col("norm")).alias("lead_text"),
    )
    local = written(local, "content-sort")
    alike = Window.partitionBy("lead_text")
    best = alike.orderBy(F.desc("chars"), F.asc("doc_id"))
    leaders = local.where("lead_text IS NOT NULL").select(
        "hash", "salt", F.col("text_sha256").alias("sha"),
        F.first("doc_id").over(best).alias("all_id"),
        F.sum("lead_n").over(alike).alias("all_n"),
        (F.row_number().over(best) == 1).alias("all_first"),
    )  # a row for each piece of a hot text: twice the shares at most, but for texts of one hash
    whole = local.join(
        F.broadcast(leaders),
        local.hot & (local.hash == leaders.hash) & (local.salt == leaders.salt) & (local.text_sha256 == leaders.sha),
        "left",
    )
    return whole.select(
        "doc_id",
        F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("lead_n")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | F.coalesce(F.col("all_first"), F.lit(False)))).alias("kept"),
        "text_sha256",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, one of each text, with all their columns.

    A doc_id whose rows all go is left out by its id. Only rows without an id, and rows that share an id of which some go,
    have their texts hashed again: of those that have the id and the text of the one that stays, the longest is taken, and
    of these the first by text; which of rows alike in both is taken isn't defined.
    """
    with scratch(spark):
        sorted_ = released(written(content_sort(docs).select("doc_id", "kept", "text_sha256"), "exact-kept"))
    each = sorted_.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(~F.col("kept")).alias("some"), F.min(~F.col("kept")).alias("all"))
    gone = written(each.where("some").select("doc_id", "all"), "exact-gone")
    named = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    stay = docs.where("doc_id IS NOT NULL").join(named, "doc_id", "left_anti").select(*docs.columns)
    mixed, nameless = gone.where("NOT all"), sorted_.where("doc_id IS NULL")
    if mixed.isEmpty() and nameless.isEmpty():
        return stay
    own = docs.where("doc_id IS NULL").unionByName(docs.join(mixed, "doc_id", "left_semi").select(*docs.columns))
    row = own.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        "row", F.sha2(normalised(F.col("row.text")), 256).alias("sha"),
        F.struct((-F.coalesce(F.char_length("row.text"), F.lit(0))).alias("chars"), F.col("row.text").alias("text")).alias("order"),
    )
    kept = sorted_.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("sha"))
    kept = kept.join(mixed, kept["keep_id"] == mixed["doc_id"], "left_semi").unionByName(kept.where("keep_id IS NULL"))
    among = row.join(kept, (row["sha"] == kept["sha"]) & row["row.doc_id"].eqNullSafe(kept["keep_id"]), "left_semi")
    one = among.groupBy("sha").agg(F.min_by("row", "order").alias("row"))
    return stay.unionByName(one.select("row.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS place
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
