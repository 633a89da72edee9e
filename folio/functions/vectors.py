"""Vector expressions, a stand-in embedder, and the check of what an embedder gives."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import models

NORM_TOLERANCE = 1e-5
HELD_WORDS = 200_000  # words whose places a stand-in embedder keeps


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_error(vector: Column, dimension: int) -> Column:
    """Why a vector can't be stored, or null."""
    return (
        F.when(vector.isNull(), F.lit("missing"))
        .when(F.size(vector) != dimension, F.lit("dimension"))
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("not finite"))
        .when(F.abs(norm(vector) - 1) > NORM_TOLERANCE, F.lit("norm"))
    )


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: it isn't null, all its numbers are finite, and one isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hash_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder for tests and offline runs: signed counts of hashed words, of unit norm.

    Words are runs of what isn't ASCII white space, with A-Z lowered; the first two bytes of a word's MD5 say where it
    counts and the next bit with which sign.
    """

    places: dict[bytes, int] = {}  # words that came before: where they count, and behind the dimension those that count down

    def place(word: bytes) -> int:
        h = hashlib.md5(word, usedforsecurity=False).digest()
        found = int.from_bytes(h[:2], "big") % dimension + (0 if h[2] >> 7 else dimension)
        if len(word) <= 64:
            if len(places) >= HELD_WORDS:
                places.clear()
            places[word] = found
        return found

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            own = [places[w] if w in places else place(w) for w in text.encode().lower().split()]
            counts = np.bincount(np.array(own, int), minlength=2 * dimension)
            row += counts[:dimension] - counts[dimension:]
            if not row.any():
                row[0] = 1.0
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    return embed


def embedded(
    rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32, identity: str | None = None, lane: str | None = None
) -> DataFrame:
    """(key, embedding) of each row; texts go to the embedder in order, in batches.

    ``make`` builds the embedder once per task, or with an ``identity`` once per worker process; with the path of a file as
    ``lane`` one process of a machine embeds at a time.
    """
    if not 1 <= batch <= 256:
        raise ValueError("a batch has 1 to 256 texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make() if identity is None else models.loaded(identity, make)
        for arrow in batches:
            keys, texts = arrow.column(0), [t or "" for t in arrow.column(1).to_pylist()]
            for lo in range(0, len(texts), batch):
                with models.lane(lane):
                    vectors = embed(texts[lo : lo + batch])
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(vectors)), pa.array(list(vectors), pa.list_(pa.float32()))], [key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def query_text(instruction: str, query: str) -> str:
    """An instruction with its one ``{query}`` replaced."""
    if instruction.count("{query}") != 1 or not query.strip():
        raise ValueError("an instruction holds {query} once, and a query isn't blank")
    return instruction.replace("{query}", query)
