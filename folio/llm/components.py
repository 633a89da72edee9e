"""Connected components of a graph given as a table of edges, on DataFrames alone.

Large-star and small-star steps alternate until the edges are stars: every node's edge then leads to the smallest node of
its component. Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import released, scratch, written

ROUNDS = 64
BROADCAST = 1 << 20  # edges up to which the table of least neighbours is broadcast


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Each row with its node's least neighbour. A hub's rows aren't gathered: the small side is broadcast where the count
    of edges bounds it, else written, so that both sides of the join come from shuffles that can be split."""
    return rows.join(F.broadcast(least) if edges <= BROADCAST else written(least, "least"), "a")


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = _with_least(down, least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; ``edges`` has columns a and b of one type."""
    with scratch(edges.sparkSession):
        now = released(_stars(edges))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> DataFrame:
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        if not state[0]:
            return now
        tied = written(_large(now, state[0]).distinct(), "tied")
        now = written(_small(tied, state[0]).distinct(), "stars")
        new = _state(now)
        if new == state:
            return now
        state = new
    raise RuntimeError("components did not settle")
