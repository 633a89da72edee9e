"""Vector candidates, what a client may search, fusion of ranks, and evidence.

Vectors are scored in arrays, a block of queries at a time, and each task keeps its best ``k`` of each query: what is shuffled
is never a row per pair. Keyword candidates come from ``keyword_index``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folio.functions.auth import with_hmac
from folio.functions.vectors import comparable
from folio.operators import relations

TOP = 50
RRF_K, KEYWORD_WEIGHT, VECTOR_WEIGHT = 60, 1.0, 1.0
RESULTS, MOST_RESULTS = 5, 20
BLOCK_QUERIES = 4_096  # query vectors that a task holds at a time
SCORES = 1 << 20  # scores that a task holds at a time
MOST_CONFLICTS = 20  # the other sides of conflicts that an item of an answer lists


class _Best:
    """The best ``k`` rows of each query so far, ties by id, in arrays over all queries."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.id, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        self.more: list[tuple[np.ndarray, ...]] = []
        self.held, self.limit = 0, max(SCORES, 2 * queries * k)

    def add(self, ids: np.ndarray, queries: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: of each row with each of ``queries``."""
        row, at = np.nonzero(scores >= self.least[queries])
        self.more.append((queries[at], ids[row], scores[row, at]))
        self.held += len(row)
        if self.held > self.limit:
            self.cut()

    def cut(self) -> None:
        query, own, score = (np.concatenate([x, *more]) for x, more in zip((self.query, self.id, self.score), zip(*self.more))) if self.more else (self.query, self.id, self.score)
        order = np.lexsort((own, -score, query))
        query, own, score = query[order], own[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.query, self.id, self.score, self.more = query[keep], own[keep], score[keep], []
        self.held = len(self.query)

    def batch(self) -> pa.RecordBatch:
        self.cut()
        return pa.RecordBatch.from_arrays([pa.array(self.query), pa.array(self.id), pa.array(self.score)], ["at", "row_id", "score"])


def vector_top(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = TOP, allowed: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, row_id, score, rank): exact cosine of every row with every query, the best ``k`` of each.

    With ``allowed`` (the columns of ``by``, strings, and row_id) a query is scored with the rows that are allowed to it only.
    A query meets the rows of its own dimension. Vectors that are null, empty or zero, or that hold what isn't a finite
    number, have no direction: such rows and queries are left out; others need no unit norm. No queries give no rows.
    Queries are asked in blocks of about ``BLOCK_QUERIES``, a scan of the rows for each block.
    """
    asked = queries.where(comparable(F.col(query_vector))).select(*by, F.col(query_key).cast("bigint").alias("query_id"), F.col(query_vector).alias("vector"))
    own = rows.where(comparable(F.col(vector))).select(F.col(key).cast("bigint").alias("row_id"), F.col(vector).alias("vector"))
    if allowed is not None:
        own = own.join(allowed.select(*by, F.col("row_id").cast("bigint")).distinct(), "row_id")
    own = own.select("row_id", "vector", *by)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    out = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64(*by, "query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = _vector_block(own, sorted(tuple(r) for r in some.collect()), asked.schema[: len(by) + 1], k, len(by))  # a block of vectors
        out = found if out is None else out.unionByName(found)
    return out


def _vector_block(rows: DataFrame, stated: list[tuple], keys, k: int, by: int) -> DataFrame:
    #: The queries of each group and dimension: where they stand, and their directions.
    groups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for group in {(*q[:by], len(q[-1])) for q in stated}:
        at = np.array([i for i, q in enumerate(stated) if (*q[:by], len(q[-1])) == group])
        wanted = np.array([stated[i][-1] for i in at], float)
        groups[group] = at, (wanted / np.linalg.norm(wanted, axis=1, keepdims=True)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(stated), k)
        for batch in batches:
            ids, vectors = np.asarray(batch.column(0)), batch.column(1)
            sizes = np.asarray(pc.list_value_length(vectors))
            own = list(zip(*(c.to_pylist() for c in batch.columns[2:]), sizes.tolist()))
            for group in set(own):
                if group not in groups:
                    continue
                (at, wanted), mine = groups[group], np.array([i for i, g in enumerate(own) if g == group])
                step = max(1, SCORES // len(at))
                for lo in range(0, len(mine), step):
                    part = mine[lo : lo + step]
                    held = np.asarray(vectors.take(pa.array(part)).flatten()).astype(float).reshape(len(part), -1)
                    best.add(ids[part], at, (held @ wanted) / np.linalg.norm(held, axis=1, keepdims=True))
        yield best.batch()

    return ranked(rows.mapInArrow(run, FOUND), [q[:-1] for q in stated], keys, k)


FOUND = "at bigint, row_id bigint, score double"


def ranked(found: DataFrame, asked: list[tuple], keys, k: int) -> DataFrame:
    """(keys, row_id, score, rank) of the best ``k`` of what tasks found (``FOUND``); ``at`` is a query's place in ``asked``."""
    named = found.sparkSession.createDataFrame([(i, *q) for i, q in enumerate(asked)], StructType([StructField("at", LongType()), *keys]))
    order = Window.partitionBy("at").orderBy(F.desc("score"), "row_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(named), "at").drop("at").select(*(f.name for f in keys), "row_id", "score", "rank")


def check_descriptor(active: tuple[str, str, int], query: tuple[str, str, int]) -> None:
    """Refuses a query whose embedder (model, revision, dimension) isn't the one that made the active vectors."""
    if active != query or active[2] <= 0:
        raise ValueError("the query's embedder isn't the active run's")


def active_descriptors(profiles: DataFrame, runs: DataFrame, configs: DataFrame) -> list[tuple[str, str, int]]:
    """The embedders (model, revision, dimension) of the active runs of ``profiles``: each of its kind once.

    ``profiles``: active_run_id; ``runs``: run_id and index_config_id; ``configs``: id and embedding_config as JSON.
    """
    active = runs.join(profiles.select(F.col("active_run_id").alias("run_id")), "run_id", "left_semi").select(F.col("index_config_id").alias("id"))
    own = configs.join(active, "id", "left_semi").select(F.from_json("embedding_config", "model string, revision string, dimension int").alias("e"))
    return [tuple(r) for r in own.select("e.*").distinct().collect()]  # a row for each embedder in use


def permitted(chunks: DataFrame, occurrences: DataFrame, profiles: DataFrame, grants: DataFrame, clients: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """(client_id and the columns of ``chunks``): what each client of ``requests`` may search, decided before anything is scored.

    ``requests``: client_id, scope (``all`` filters none), prefixes and states (empty arrays filter none). A client that is
    disabled, revoked or expired sees as much as one that doesn't exist. All clients are decided in one plan.
    """
    fit = (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    asking = requests.join(clients.where(fit), "client_id", "left_semi")
    sources = grants.select("client_id", "source_key").distinct().join(asking, "client_id")
    runs = profiles.where(F.col("active_run_id").isNotNull()).join(sources, "source_key").select("client_id", "scope", "prefixes", "states", F.col("active_run_id").alias("run_id"))
    wanted = occurrences.join(runs.distinct(), "run_id").where(
        ((F.col("scope") == "all") | (F.col("version_scope") == F.col("scope")))
        & ((F.size("states") == 0) | F.array_contains("states", F.col("decision_state")))
        & ((F.size("prefixes") == 0) | F.exists("prefixes", lambda p: F.startswith(F.col("source_path"), p)))
    )
    return chunks.join(wanted.select("client_id", "content_id").distinct(), "content_id").select("client_id", *(c for c in chunks.columns))


REQUESTS = "client_id string, scope string, prefixes array<string>, states array<string>"


def fused(keyword: DataFrame, vector: DataFrame, k: int = RRF_K, keyword_weight: float = KEYWORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion per query; a side that lacks a row adds nothing."""
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    keys = [*by, "query_id", "row_id"]
    both = keyword.select(*keys, F.col("rank").alias("kw_rank")).join(vector.select(*keys, F.col("rank").alias("vec_rank")), keys, "full_outer")
    return both.withColumn("rrf", part("kw_rank", keyword_weight) + part("vec_rank", vector_weight))


def closure(found: DataFrame, places: DataFrame, edges: DataFrame) -> DataFrame:
    """(client_id, content_hash, n_conflicts, conflicts): the other sides of potential conflicts of what was found.

    One hop over ``edges`` in both directions, from each place (client_id, source_path, content_hash) of a found
    (client_id, content_hash) to another that the same client may see. ``conflicts`` lists the first ``MOST_CONFLICTS`` as
    ``path:first-last``, the lines of the evidence; ``n_conflicts`` counts all.
    """
    own = places.join(found.select("client_id", "content_hash").distinct(), ["client_id", "content_hash"], "left_semi")
    sides = relations.exposed(edges).select(
        F.col("from_source_path").alias("source_path"), F.col("to_source_path").alias("other"), F.col("evidence_line_start").alias("first"), F.col("evidence_line_end").alias("last")
    )
    seen = places.select("client_id", F.col("source_path").alias("other")).distinct()
    hop = own.join(sides, "source_path").join(seen, ["client_id", "other"], "left_semi").select("client_id", "content_hash", "other", "first", "last").distinct()
    keys = ["client_id", "content_hash"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("other", "first", "last"))
    counts = hop.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_conflicts"))
    listed = hop.withColumn("place", place).where(F.col("place") <= MOST_CONFLICTS).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "other", "first", "last"))).alias("all"))
    said = F.array_join(F.transform("all", lambda x: F.concat(x["other"], F.lit(":"), x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))), ",")
    return counts.join(listed, keys).select(*keys, "n_conflicts", said.alias("conflicts"))


def evidence(matches: DataFrame, parent: str, limit: int = RESULTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Matches (query_id, ``parent``, row_id, rrf) grouped by parent: the best score, every match in order, the first ``limit``."""
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError("a search returns 1 to 20 results")
    items = matches.groupBy(*by, "query_id", parent).agg(
        F.max("rrf").alias("score"), F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rrf")).alias("o"), "row_id"))), lambda m: m["row_id"].cast("string")), ",").alias("matches"),
    )  # at most TOP matches of either side, so no group is large
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), parent)
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def served(found: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of every request of ``asked`` (query_id and more): one without any is a row with status ``no_evidence``."""
    return asked.join(found, [*by, "query_id"], "left").withColumn("status", F.when(F.col("place").isNull(), "no_evidence").otherwise("ok"))


def audited(answers: DataFrame, key: bytes, requests: tuple[str, ...], text: str, returned: str) -> DataFrame:
    """One audit row for each request: the HMAC of its query and what it got, never the query's text."""
    ids = F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(returned).alias("id")))), lambda x: x["id"]))
    events = answers.groupBy(*requests, text).agg(ids.alias("returned_ids"), F.count("place").cast("int").alias("result_count"), F.max("status").alias("status"))
    return with_hmac(events, text, key).drop(text)


def precedence(occurrences: DataFrame) -> DataFrame:
    """Which occurrence of a content speaks for it: owner, then decision, then version scope and date; all are kept."""
    owner = F.when(F.col("owner_domain") == "docs", 0).when(F.col("owner_domain") == "uiux", 1).otherwise(2)
    state = F.when(F.col("decision_state") == "confirmed", 0).when(F.col("decision_state") == "unknown", 1).otherwise(2)
    scope = F.when(F.col("version_scope") == "current", 0).otherwise(1)
    key = F.struct(owner.alias("owner"), state.alias("state"), scope.alias("scope"), (-F.datediff(F.coalesce("document_date", F.to_date(F.lit("0001-01-01"))), F.to_date(F.lit("1970-01-01")))).alias("age"), F.col("source_path"))
    best = occurrences.groupBy("content_hash").agg(F.min(key).alias("best"), F.count(F.lit(1)).alias("n_occurrences"))
    return occurrences.join(best, "content_hash").select(
        "source_path", "content_hash", "n_occurrences", F.col("best.source_path").alias("canonical_path"),
        (F.col("best.source_path") == F.col("source_path")).alias("canonical"),
    )
