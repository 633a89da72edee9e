"""A Merkle manifest of a table of documents: one digest that all rows hash up to, and a proof for each row.

Method: an external-memory node store. Leaves are hashed where they are read; then only digests move. They are sorted by tree
and id over range partitions, their coordinates (tree, position) follow from their places in the sorted runs, and each level
of all trees is written as one Parquet table below the store: a row is a run of eight nodes with the digest above them. A
level reads the one before it once, from start to end, and its own rows are an eighth. The subroots of the trees are the
leaves of one more tree, stored alike.

Proofs go down again: a level's runs are merged with the paths of the nodes above by coordinate, so that what moves is one
path for each run of eight, and a row's path is folded where its run was read. No tree, level or path is ever in one task:
runs are keyed by (tree, position).

Defined results: a null field is written as ``-``, an empty one as ``0:``; a null lang is a tree of its own and comes first;
rows of one doc_id are ordered by their digests, rows alike in all fields are leaves of their own; a null doc_id sorts first
and is never tampered with; very long texts are hashed whole; an empty table has no leaves and gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import crc_mod, documents, own_path, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
#: The letters that tampering lower-cases, and the share of rows that are tampered with.
UPPER, LOWER, TAMPERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 3

Steps = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*(field(f) for f in fields))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and, of rows that are tampered with, the leaf of the tampered row; no texts."""
    rows = docs.select(*FIELDS, F.coalesce(crc_mod(F.col("doc_id"), TAMPERED) == 0, F.lit(False)).alias("hit"))
    lower = F.translate("text", UPPER, LOWER)
    return rows.select(
        "doc_id", "lang", leaf(*(F.col(f) for f in FIELDS)).alias("leaf"),
        F.when(F.col("hit"), leaf(*(lower if f == "text" else F.col(f) for f in FIELDS))).alias("other"),
        F.monotonically_increasing_id().alias("spot"),
    )


def coordinates(nodes: DataFrame, tree: Column, order: list[str]) -> DataFrame:
    """``nodes`` with tree, pos and total: each node's place in its tree by ``order``, and how many the tree has.

    A sort over range partitions puts a tree's nodes in a row; a node's place is its place in its partition, plus the tree's
    nodes in partitions before. ``order`` must begin with the tree's own columns and tell all nodes apart, so that no tree
    and no group of equal rows has to be in one partition.
    """
    runs = written(nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("*", tree.alias("tree"), F.monotonically_increasing_id().alias("at")), "sorted-nodes")
    parts = runs.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")  # a row for each partition that has nodes of the tree
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    placed = runs.withColumn("part", F.shiftright("at", 33)).join(based, ["tree", "part"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Store:
    """The levels of a forest, one Parquet table each: tree, total, pos, nodes (eight in order) and the hash above them.

    ``nodes`` of level 0 hold what else belongs to a leaf. ``total`` counts the tree's leaves.
    """

    levels: list[DataFrame]

    @staticmethod
    def build(placed: DataFrame, at: str, *more: str) -> Store:
        """Writes the levels of nodes (tree, total, pos, hash and columns to keep with the leaves) below ``at``."""
        spark, levels = placed.sparkSession, []
        highest = placed.agg(F.max("total")).head()[0] or 0
        node = F.struct("pos", "hash", *more)
        while not levels or FANOUT ** len(levels) < highest:
            runs = placed.groupBy("tree", "total", F.floor(F.col("pos") / FANOUT).alias("run")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # eight at most
            above = F.sha2(F.concat_ws("", F.transform("nodes", lambda x: x["hash"])), 256)
            if not levels:  # a lone leaf is its tree's root
                above = F.when(F.col("total") == 1, F.col("nodes")[0]["hash"]).otherwise(above)
            table = runs.select("tree", "total", F.col("run").alias("pos"), "nodes", above.alias("hash"))
            path = f"{at}/level={len(levels)}"
            table.write.parquet(path)
            levels.append(spark.read.schema(table.schema).parquet(path))
            node = F.struct("pos", "hash")
            placed = levels[-1].where(F.col("total") > FANOUT ** len(levels))
        return Store(levels)

    def roots(self) -> DataFrame:
        """tree and hash: the root of each tree, from the one level where it stands."""
        found = None
        for k, level in enumerate(self.levels):
            top = level.where(F.col("total") <= FANOUT ** (k + 1))
            top = top.where(F.col("total") > FANOUT**k) if k else top
            found = top.select("tree", "hash") if found is None else found.unionByName(top.select("tree", "hash"))
        return found

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with their paths, which end with those of ``above`` (tree, path), where the trees' roots are leaves.

        A path lists, from the leaf up, what stands before and after it in its run; a lone leaf has none of its own. Further
        columns of ``above`` come with the leaves.
        """
        paths, more = None, [c for c in above.columns if c not in ("tree", "path")]
        for k in range(len(self.levels) - 1, -1, -1):
            level, top = self.levels[k].drop("hash"), F.col("total") <= FANOUT ** (k + 1)
            begun = level.where(top).join(above, "tree")
            if paths is not None:
                begun = begun.unionByName(level.where(~top).join(paths.drop("hash"), ["tree", "pos"]))
            each = begun.select("tree", "total", *more, F.col("nodes.hash").alias("hashes"), "path", F.posexplode("nodes").alias("i", "node"))
            joined = lambda start, n: F.concat_ws("", F.slice("hashes", start, n))
            own = F.struct(joined(F.lit(1), F.col("i")).alias("before"), joined(F.col("i") + 2, F.lit(FANOUT)).alias("after"))
            paths = each.select("tree", "node.*", *more, F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(F.array(own), "path")).alias("path"))
        return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda so_far, step: digest(step["before"], so_far, step["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda step: F.array(step["before"], step["after"])))), 256)


@dataclass
class Manifest:
    """The trees of the languages and the tree above them, stored below one path."""

    trees: Store
    top: Store

    @staticmethod
    def build(docs: DataFrame, at: str | None = None) -> Manifest:
        """Hashes every row of ``docs`` and writes all levels below ``at``, by default a path of its own in the shared folder."""
        at = at or own_path(docs.sparkSession, "manifest")
        hashed = written(leaves(docs), "leaves")
        placed = coordinates(hashed, field(F.col("lang")), ["lang", "doc_id", "leaf", "spot"])
        trees = Store.build(placed.withColumnRenamed("leaf", "hash"), f"{at}/trees", "lang", "doc_id", "other")
        named = trees.levels[0].where("pos = 0").select("tree", F.col("nodes")[0]["lang"].alias("lang"))
        roots = trees.roots().join(named, "tree").withColumnRenamed("tree", "own")
        above = coordinates(roots, F.lit("top"), ["lang", "own"])
        return Manifest(trees, Store.build(above, f"{at}/top", "own"))

    def root(self) -> str | None:
        """The digest of the whole table; None of an empty one."""
        row = self.top.roots().head()
        return row["hash"] if row else None

    def proofs(self) -> DataFrame:
        """doc_id, leaf, other, subroot, root and path of every row."""
        start = self.top.roots().select("tree", F.array().cast(Steps).alias("path"))
        over = self.top.proofs(start).select(F.col("own").alias("tree"), "path", F.col("hash").alias("subroot"))
        return self.trees.proofs(over).select("doc_id", F.col("hash").alias("leaf"), "other", "subroot", F.lit(self.root()).cast("string").alias("root"), "path")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    proved = Manifest.build(documents(spark, sf_dir)).proofs()
    told = proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), rows AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS most,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(unicode(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 3 = 0, false) AS hit
  FROM documents, crc
), hashed AS (
  SELECT doc_id, lang, hit, sha256(most || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(most || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower
  FROM rows
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
  FROM hashed
), low AS (
  SELECT tree, 0 AS level, CAST(pos AS BIGINT) AS pos, leaf AS hash, total FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (total + 7) // 8 FROM low WHERE total > 1 GROUP BY tree, level, pos // 8, total
), depths AS (
  SELECT tree, max(level) AS depth FROM low GROUP BY tree
), high AS (
  SELECT 0 AS level, CAST(tree AS BIGINT) AS pos, hash, count(*) OVER () AS total FROM low WHERE total = 1
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (total + 7) // 8 FROM high WHERE total > 1 GROUP BY level, pos // 8, total
), steps_of AS (
  SELECT l.tree, l.pos, n.level, n.pos AS node, n.hash, n.pos = l.pos // CAST(pow(8, n.level) AS BIGINT) AS mine
  FROM leaves l JOIN low n ON n.tree = l.tree AND n.total > 1 AND n.pos // 8 = l.pos // CAST(pow(8, n.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, 1000 + n.level, n.pos, n.hash, n.pos = l.tree // CAST(pow(8, n.level) AS BIGINT)
  FROM leaves l JOIN high n ON n.total > 1 AND n.pos // 8 = l.tree // CAST(pow(8, n.level + 1) AS BIGINT)
), sides AS (
  SELECT tree, pos, level, coalesce(string_agg(hash, '' ORDER BY node) FILTER (WHERE NOT mine AND node < here), '') AS before,
    coalesce(string_agg(hash, '' ORDER BY node) FILTER (WHERE NOT mine AND node > here), '') AS after
  FROM (SELECT *, max(CASE WHEN mine THEN node END) OVER (PARTITION BY tree, pos, level) AS here FROM steps_of) GROUP BY tree, pos, level
), paths AS (
  SELECT tree, pos, list({'before': before, 'after': after} ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS said FROM sides GROUP BY tree, pos
), folds AS (
  SELECT tree, pos, CASE WHEN hit THEN lower ELSE leaf END AS now, 0 AS done FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, sha256(path[done + 1].before || now || path[done + 1].after), done + 1
  FROM folds f JOIN paths p ON p.tree = f.tree AND p.pos = f.pos WHERE done < len(path)
), ends AS (
  SELECT tree, pos, arg_max(now, done) AS folded_root FROM folds GROUP BY tree, pos
)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(said, '')) AS proof_sha256, folded_root, folded_root = r.hash AS verified
FROM leaves l JOIN ends e ON e.tree = l.tree AND e.pos = l.pos JOIN low s ON s.tree = l.tree AND s.total = 1 JOIN high r ON r.total = 1
LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
"""
