"""Language identification.

Method: character n-grams of one to three letters are hashed to ``BUCKETS`` buckets; their shares of a text times inverse
document frequencies feed a multinomial logistic regression, trained by follow-the-regularised-leader with an
elastic-net penalty, so most weights are zero; the others are kept and applied as sparse rows. A temperature, fitted on
labelled texts that trained no weight, calibrates the probabilities.

Bounds: the regression learns from about ``SAMPLE`` labelled texts of each language, fewer where there are so many languages
that these would be over ``SAMPLE_ALL``, or where texts are so long that their bags (the shares of a text's buckets, which is
what reaches the driver) are over ``BAG_BYTES`` together. They are chosen by a hash of their ids, and of each language at
least the one with the least hash; their whole texts are read where they lie. Where there are so many languages that the weights would be over
``WEIGHTS``, n-grams are hashed to fewer buckets, so that one bag of each language is within the bound too. Every language is
learnt. Document frequencies are counted over all texts that may be learnt from. Every whole text is judged; n-grams are read
in steps, so memory grows neither with texts nor with the number of languages times characters.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text all are; ties
between languages go to the first by name; repeated rows are judged each, alike; very long texts are read in steps; an
empty table gives an empty result; columns other than doc_id and text are read for learning only (lang).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.byte_bpe import LETTER, classes
from folio.llm.common import crc_mod, documents, lean, python_ready, scratch, steps, text_rows, utf8, written

SAMPLE, SAMPLE_ALL = 1_500, 12_000
BAG_BYTES = 64 << 20  # of all texts that are learnt from; six bytes for each bucket of a text
WEIGHTS = 1 << 23  # buckets times languages
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
LEAST_BUCKETS = 1 << 12
FOLDS, HELD_OUT, TUNING = 4, 2, 3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.002, 2
GAIN = 10.0  # the features' scale
STEP_BYTES = 1 << 18
TERMS = 1 << 20  # weights that are gathered at a time
TEXTS = 64  # texts whose buckets are told apart at a time
COOLEST, HOTTEST = 1e-3, 1e3  # temperatures tried
NONE = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(1)
def lowered() -> np.ndarray:
    """Each code point's lower case if it is a letter, else a space."""
    table = np.full(0x110000, 0x20, np.uint32)
    for point in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(point).lower()
        table[point] = ord(low) if len(low) == 1 else point
    return table


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that begins at each position (those at the end are left out)."""
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            return
        mixed = points[:m] * _FACTORS[0]
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint32(15))) * _FACTORS[k] + points[k : k + m] * _FACTORS[0]
        mixed = (mixed ^ (mixed >> np.uint32(13))) * _FACTORS[2]
        yield n, (mixed >> np.uint32(16)).astype(np.int32)


def _pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text's code points in steps, each with those that its last n-grams need, and how many are its own."""
    lo = 0
    while lo < len(data):
        cuts, hi = [], lo + STEP_BYTES
        for _ in ORDERS:  # the ends of the step and of the characters after it
            while hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi += 1
            cuts.append(min(hi, len(data)))
            hi += 1
        own = len(data[lo : cuts[0]].tobytes().decode())
        yield np.frombuffer(data[lo : cuts[-1]].tobytes().decode().encode("utf-32-le"), np.uint32), own
        lo = cuts[0]


def read(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Over ranges of texts (lo, hi), perhaps several times over one long text: whether each has letters there, and the
    buckets and the texts (from 0) of all their n-grams."""
    for lo, hi in steps(offsets, STEP_BYTES):
        own = data[offsets[lo] : offsets[hi]]
        if hi - lo == 1 and len(own) > STEP_BYTES:
            for points, n in _pieces(own):
                found = np.concatenate([b[:n] for _, b in grams(lowered()[points])])
                yield lo, hi, np.array([(classes()[points[:n]] == LETTER).any()]), found, np.zeros(len(found), np.int64)
            continue
        raw = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum((own & 0xC0) != 0x80))[offsets[lo : hi + 1] - offsets[lo]]
        letters = np.append(0, np.cumsum(classes()[raw] == LETTER))
        text = np.repeat(np.arange(hi - lo), np.diff(at))
        buckets, texts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for order, bucket in grams(lowered()[raw]):
            inside = text[: len(bucket)] == text[order - 1 :]
            buckets.append(bucket[inside])
            texts.append(text[: len(bucket)][inside])
        yield lo, hi, letters[at[1:]] > letters[at[:-1]], np.concatenate(buckets), np.concatenate(texts)


# --- learning ---


def usable(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and fold of the rows that may be learnt from."""
    return docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    ).withColumn("fold", crc_mod(F.col("doc_id"), FOLDS).cast("int")).where(F.col("fold") != HELD_OUT)


def frequencies(rows: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many of them have an n-gram in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total += len(batch)
            long: tuple[int, np.ndarray] | None = None  # a long text comes in several steps
            for lo, hi, _, bucket, text in read(data, offsets):
                bucket = bucket & (buckets - 1)
                if long is not None and long[0] != lo:
                    seen += long[1]
                    long = None
                if hi - lo == 1:
                    mark = long[1] if long is not None else np.zeros(buckets, bool)
                    mark[bucket] = True
                    long = (lo, mark)
                    continue
                order = np.argsort(text, kind="stable")
                bucket, text = bucket[order], text[order]
                for a in range(0, hi - lo, TEXTS):
                    x, y = np.searchsorted(text, [a, a + TEXTS])
                    mark = np.zeros((TEXTS, buckets), bool)
                    mark[text[x:y] - a, bucket[x:y]] = True
                    seen += mark.sum(axis=0)
            if long is not None:
                seen += long[1]
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(total, seen[some]))], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(lean(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    seen, total = np.zeros(buckets, np.int64), 0
    for bucket, n in counted.collect():  # a row for each bucket at most
        if bucket < 0:
            total = n
        else:
            seen[bucket] = n
    return total, seen


BAG = "lang string, fold int, own bigint, first boolean, bucket binary, share binary"


def bags(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """For each text, its language, fold and hash, its buckets and their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            out, cuts = [], offsets.tolist()
            for a, b in zip(cuts, cuts[1:]):
                n = np.zeros(buckets, np.int64)
                for _, _, _, bucket, _ in read(data[a:b], np.array([0, b - a])):
                    n += np.bincount(bucket & (buckets - 1), minlength=buckets)
                some = np.flatnonzero(n)
                out.append((some.astype("<u2").tobytes(), (n[some] / max(1, n.sum())).astype("<f4").tobytes()))
            x, y = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["lang", "fold", "own", "first", "bucket", "share"])

    return rows.select("lang", "fold", "own", "first", "text").mapInArrow(lean(run), BAG)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, buckets: int = BUCKETS) -> np.ndarray:
    """Weights (bucket, class) by FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((buckets, k), np.float32), np.zeros((buckets, k), np.float32)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, np.float32(0), -(zz - np.sign(zz) * np.float32(L1)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            bucket, x = rows[i]
            w = weights(bucket)
            m = x @ w
            p = np.exp(m - m.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            before = n[bucket]
            z[bucket] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w
            n[bucket] = before + g * g
    for lo in range(0, buckets, 4096):  # in place, a stretch at a time
        z[lo : lo + 4096] = weights(slice(lo, lo + 4096))
    return z


def smoothed_loss(m: np.ndarray, y: np.ndarray) -> float:
    """The mean log loss where each text counts as wrongly labelled with a chance of 1 / (texts + 2), so that texts that
    all are told apart don't ask for certainty."""
    n, k = m.shape
    top = m.max(axis=1)
    logs = m - top[:, None] - np.log(np.exp(m - top[:, None]).sum(axis=1))[:, None]
    own, wrong = logs[np.arange(n), y], 1 / (n + 2)
    return float(-np.mean((1 - wrong) * own + wrong * (logs.sum(axis=1) - own) / max(k - 1, 1)))


def temperature(m: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the margins that gives the tuning texts the least loss."""
    return min(np.geomspace(COOLEST, HOTTEST, 241).tolist(), key=lambda t: smoothed_loss(m / t, y)) if len(y) else 1.0


class Model:
    """Languages, and the weights that aren't zero: for each bucket a stretch of classes and weights."""

    def __init__(self, names: list[str], dense: np.ndarray, cooled: float):
        self.names, self.temperature = names, cooled
        bucket, self.cls = np.nonzero(dense)
        self.weight = dense[bucket, self.cls].astype(np.float32)
        self.buckets = len(dense)
        self.start = np.searchsorted(bucket, np.arange(self.buckets + 1))

    def add(self, total: np.ndarray, bucket: np.ndarray, text: np.ndarray) -> None:
        """Adds the n-grams' weights to their texts' rows of ``total``."""
        bucket = bucket & (self.buckets - 1)
        k, n = len(self.names), self.start[bucket + 1] - self.start[bucket]
        some = np.flatnonzero(n)
        bucket, text, n = bucket[some], text[some], n[some]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(bucket):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TERMS, side="right")))
            size = n[lo:hi]
            at = np.repeat(self.start[bucket[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            a, b = int(text[lo:hi].min()), int(text[lo:hi].max()) + 1
            key = np.repeat(text[lo:hi] - a, size) * k + self.cls[at]
            total[a:b] += np.bincount(key, self.weight[at], (b - a) * k).reshape(b - a, k)
            lo = hi


def fit(docs: DataFrame) -> Model | None:
    """The model; None without labelled texts."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = usable(docs)
    own = F.xxhash64(F.lit(11), "doc_id")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("least")).collect()  # a row for each language
    if not counts:
        return None
    buckets = BUCKETS
    while buckets * len(counts) > WEIGHTS and buckets > LEAST_BUCKETS:
        buckets //= 2
    most, parts = min(SAMPLE, max(1, SAMPLE_ALL // len(counts))), 1 << 30
    shares = spark.createDataFrame([(r["lang"], int(min(1.0, most / r["n"]) * parts), r["least"]) for r in counts], "lang string, share bigint, least bigint")
    chosen = rows.withColumn("own", own).join(F.broadcast(shares), "lang").where((F.pmod("own", F.lit(parts)) < F.col("share")) | (F.col("own") == F.col("least")))
    with scratch(spark):
        made = written(bags(chosen.withColumn("first", F.col("own") == F.col("least")), buckets), "bags")
        whole = made.agg(F.sum(F.octet_length("bucket") + F.octet_length("share"))).head()[0] or 0
        scale = int(min(1.0, BAG_BYTES / max(1, whole)) * parts)
        kept = made.where(F.col("first") | (F.pmod(F.xxhash64("own"), F.lit(parts)) < scale)).select("lang", "fold", "bucket", "share")
        sample = sorted(tuple(map(bytes, r[2:])) + (r[0], r[1]) for r in kept.collect())
    if not sample:
        return None
    names = sorted({r[2] for r in sample})
    y = np.array([names.index(r[2]) for r in sample])
    total, seen = frequencies(rows, buckets)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    scaled = []
    for bucket, share, *_ in sample:
        at = np.frombuffer(bucket, "<u2").astype(np.int64)
        scaled.append((at, np.float32(GAIN) * np.frombuffer(share, "<f4") * idf[at]))
    tune = np.array([r[3] == TUNING for r in sample])
    if tune.all() or not len(set(y[~tune].tolist())) == len(names):
        tune[:] = False
    learn, held = np.flatnonzero(~tune), np.flatnonzero(tune)
    w = follow_leader([scaled[i] for i in learn], y[learn], len(names), buckets)
    m = np.array([scaled[i][1] @ w[scaled[i][0]] for i in held]).reshape(-1, len(names))
    t = temperature(m, y[held])
    w *= (np.float32(GAIN / t) * idf)[:, None]
    return Model(names, w, t)


# --- judging ---


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n, k = len(batch), len(model.names) if model else 1
            total, count, some = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
            for lo, hi, letters, bucket, text in read(data, offsets) if model else ():
                some[lo:hi] |= letters
                count[lo:hi] += np.bincount(text, minlength=hi - lo)
                model.add(total[lo:hi], bucket, text)
            m = total / np.maximum(count, 1)[:, None]
            p = np.exp(m - m.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            names = [model.names[b] if s else NONE for b, s in zip(p.argmax(axis=1).tolist(), some.tolist())]
            scores = np.where(some, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
