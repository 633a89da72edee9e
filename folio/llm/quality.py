"""Quality scores by compression.

Method: one zstandard dictionary is built from good labelled texts and one from bad ones. A text is cut into blocks and
each block compressed with either and with none; the normalised differences of these sizes (of the two, and of each from
none) say which kind it resembles. A logistic calibration, fitted on labelled texts that built neither dictionary, turns
them into a score from 0 to 1; how much a difference says may depend on a text's length.

Bounds: at most ``SAMPLE`` labelled texts of either kind build dictionaries and ``CALIBRATE`` calibrate, taken in the order
of a hash of their ids; where a kind was sampled, its texts count as many times as all of its labels ask for. The rows that a
dictionary is trained on are blocks of 4 KB: all blocks of these texts where there are up to ``BLOCKS`` of a kind, else about
``BLOCKS`` of them, chosen by a hash of id and place from all over all the texts. So 48 MB reach the driver at most, about,
whatever the texts' lengths. Texts that calibrate are compressed whole, where they lie. Every whole text is scored.

Defined results: null and empty texts are scored like any text, from sizes of nothing; if the labels lack one of the two
kinds, every score is 0.5; labels with a null or other value are left out; repeated rows are scored each, alike; very long
texts are compressed block by block; an empty table gives an empty result; columns other than doc_id and text are never
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import crc_mod, documents, lean, python_ready, text_rows, utf8

SAMPLE, CALIBRATE = 4_000, 20_000
BLOCKS = 6_000  # of either kind; of 4 KB each
DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 1 << 12
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


class Compressors:
    """The two dictionaries at work, and none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        held = [zstandard.ZstdCompressionDict(content) for content in (good, bad)]
        for h in held:
            h.precompute_compress(level=LEVEL)
        self.of = [zstandard.ZstdCompressor(level=LEVEL, dict_data=h, write_content_size=False, write_checksum=False, write_dict_id=False) for h in (*held, None)]

    def sizes(self, text: memoryview) -> tuple[int, int, int]:
        """Bytes that all blocks of the text take with the good dictionary, with the bad one and with none."""
        good, bad, none = (c.compress for c in self.of)
        a = b = c = 0
        for lo in range(0, len(text), BLOCK_BYTES):
            block = text[lo : lo + BLOCK_BYTES]
            a += len(good(block))
            b += len(bad(block))
            c += len(none(block))
        return a, b, c


def blocks(text: memoryview, key: int, share: float) -> list[bytes]:
    """The text's blocks; of a ``share`` below 1, those that a hash of the key and their place chooses."""
    chosen = lambda i: share >= 1 or zlib.crc32(b"%d:%d" % (key, i)) < share * 2**32
    return [bytes(text[lo : lo + BLOCK_BYTES]) for i, lo in enumerate(range(0, len(text), BLOCK_BYTES)) if chosen(i)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of blocks too few to train on, their own last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def features(raw: np.ndarray, good: np.ndarray, bad: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The normalised differences of sizes, and some as they count in short texts, for a logistic calibration."""
    at_least = lambda x: np.maximum(x, 1)
    between, of_raw = (bad - good) / at_least(good + bad), (bad - good) / at_least(raw)
    from_good, from_bad = (none - good) / at_least(none), (none - bad) / at_least(none)
    short = 1 / np.sqrt(1 + raw / 64)
    return np.stack([np.ones(len(raw)), between, of_raw, from_good, from_bad, between * short, from_good * short], 1)


def calibrated(x: np.ndarray, y: np.ndarray, of: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Logistic weights by Newton's method with halved steps, on standardised features; these are folded back in.

    Each row counts as ``of`` rows: where one kind was sampled, its share stays as it is among all labels.
    """
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    middle[0], spread[0] = 0, 1
    z, w = (x - middle) / spread, np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float(np.sum(of * (np.logaddexp(0, m) - y * m)) + v @ penalty @ v / 2)

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (of * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (of * (y - p)) - penalty @ w)
        while (new := loss(w + step)) > at and np.abs(step).max() > 1e-9:
            step = step / 2
        if at - new < 1e-9:
            break
        w, at = w + step, new
    w = w / spread
    w[0] -= w[1:] @ middle[1:]
    return w


def usable(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1) and fold (0 or 2) of the labels that may be learnt from."""
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int"), crc_mod(F.col("doc_id"), FOLDS).cast("int").alias("fold")
    ).where(F.col("fold") != HELD_OUT)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts to learn from: doc_id, fold, quality, text, of at most ``CALIBRATE`` labels of each fold and kind."""
    chosen = None
    for quality in (0, 1):
        for fold in (0, 2):
            some = usable(labels).where((F.col("quality") == quality) & (F.col("fold") == fold)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATE)
            some = some.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.xxhash64("doc_id"), "doc_id")))
            chosen = some if chosen is None else chosen.unionByName(some)
    bounded = F.broadcast(chosen)  # 4 * CALIBRATE rows of numbers at most
    return text_rows(docs).join(bounded, "doc_id").where(F.length("text") > 0).select("doc_id", "fold", "quality", "text", "place")


def _views(column: pa.Array) -> list[memoryview]:
    data, offsets = utf8(column)
    view, cuts = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return [view[a:b] for a, b in zip(cuts, cuts[1:])]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray] | None:
    """Both dictionaries and the weights; None if a kind is missing."""
    python_ready(docs.sparkSession)
    texts = labelled(docs, labels)

    there = {tuple(r) for r in texts.select("fold", "quality").distinct().collect()}
    if not all({(0, q), (2, q)} & there for q in (0, 1)):
        return None
    builds = [(0 if (0, q) in there else 2, q) for q in (0, 1)]
    calibrates = [(2 if (2, q) in there else 0, q) for q in (0, 1)]
    among = lambda kinds: (F.struct("fold", "quality")).isin([F.struct(F.lit(f).alias("fold"), F.lit(q).alias("quality")) for f, q in kinds])
    here = texts.where(F.col("place") <= SAMPLE).where(among(builds))
    many = here.groupBy("quality").agg(F.sum(F.ceil(F.octet_length("text") / BLOCK_BYTES)).alias("n")).collect()  # two rows
    share = {r["quality"]: min(1.0, BLOCKS / r["n"]) for r in many}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            own = [blocks(t, i, share[q]) for t, i, q in zip(_views(batch.column(3)), ids, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.binary()))], ["doc_id", "fold", "quality", "blocks"])

    found = here.mapInArrow(lean(sampled), "doc_id bigint, fold int, quality int, blocks array<binary>").where(F.size("blocks") > 0)
    rows = sorted((r.quality, r.doc_id, [bytes(b) for b in r.blocks]) for r in found.collect())
    good, bad = (dictionary([b for k, _, own in rows if k == q for b in own]) for q in (1, 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Compressors(good, bad)
        for batch in batches:
            size = np.array([(len(t), *at.sizes(t)) for t in _views(batch.column(3))], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, np.ascontiguousarray(size.T))], ["doc_id", "fold", "quality", "raw", "good", "bad", "none"])

    sizes = texts.where(among(calibrates)).mapInArrow(lean(measured), "doc_id bigint, fold int, quality int, raw bigint, good bigint, bad bigint, none bigint")
    held = sorted((r.quality, r.doc_id, r.raw, r.good, r.bad, r.none) for r in sizes.collect())
    size, y = np.array([r[2:] for r in held], float), np.array([r[0] for r in held], float)
    there = {r.quality: r["n"] for r in usable(labels).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    return good, bad, calibrated(features(*size.T), y, np.array([there[q] / max(1, int((y == q).sum())) for q in y]) * len(y) / sum(there.values()))


def scored(at: Compressors, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """The score of each text of a column."""
    size = np.array([(len(t), *at.sizes(t)) for t in _views(column)], float).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(features(*size.T) @ weights, -30, 30)))


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray] | None) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Compressors(*model[:2]) if model else None
        for batch in batches:
            value = scored(at, model[2], batch.column(1)) if at else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), "doc_id bigint, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns: each is scored where it is read."""
    model = fit(docs, labels)
    if model is None:
        return docs
    fields = [f.name for f in docs.schema.fields]
    at_text = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Compressors(*model[:2])
        for batch in batches:
            yield batch.filter(pa.array(scored(at, model[2], batch.column(at_text)) >= 0.5))

    python_ready(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
