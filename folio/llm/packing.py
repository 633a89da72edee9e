"""Packing of token pieces into sequences by exact-complement hashing.

Method: a histogram of piece lengths is all that the plan needs. Gaps are looked up among single lengths, pair sums and
triple sums of what is still there, and a combination that fills a gap exactly is consumed as often as the counts allow; what
no combination fills is packed best fit, longest first. Combinations use up short lengths, so those below an eighth of a
sequence (or a 16th, 32nd, 64th) are held back: pairs that add up to a sequence are matched first, longer lengths are packed,
and the gaps which these leave are filled exactly by one, two or three of the short ones. Plans that look up every gap from
the longest length down are made as well, with triples, pairs, singles or nothing, and one is taken only where it needs fewer
sequences. A plan names runs of sequences of one make-up, so its size depends on the sequence length and never on the number
of pieces.

Each piece's place follows from its rank among pieces of its length: a counter in the task that encodes it, plus the
counts of the tasks before. No task sees all pieces.

Defined results: a null text is empty and packs as its end token; a text longer than a sequence is cut so that only its
first piece may be shorter; very long texts are encoded in steps; repeated rows are packed as often as they come; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.byte_bpe import Merges
from folio.llm.common import documents, lean, python_ready, steps, text_rows, utf8, written

LENGTH = 1024
END = 2
HELD_BACK = (8, 16, 32, 64)  # lengths below these parts of a sequence
#: The rank file of the tokenizer's vocabulary, its one special token, which texts may contain, and its id.
#: ``vocabulary_agrees`` holds them against the tokenizer's .json file.
RANKS, SPECIAL, SPECIAL_ID = "byte_bpe_50k.tiktoken", b"<|endoftext|>", 50256


@lru_cache(2)
def merges(path: str) -> Merges:
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def token_ids(model: Merges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts as the tokenizer gives them: the special token's string becomes its id."""
    raw = data.tobytes()
    if SPECIAL not in raw:
        return model.encode(data, offsets)
    parts, owner, closes = [], [], []
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own = raw[a:b].split(SPECIAL)
        parts += own
        owner += [i] * len(own)
        closes += [True] * (len(own) - 1) + [False]
    at = np.append(0, np.cumsum([len(p) for p in parts]))
    ids, starts = model.encode(np.frombuffer(b"".join(parts), np.uint8), at)
    ids = np.insert(ids, starts[1:][closes], SPECIAL_ID)
    size = np.bincount(owner, np.diff(starts) + np.asarray(closes, np.int64), len(offsets) - 1).astype(np.int64)
    return ids, np.append(0, np.cumsum(size))


def vocabulary_agrees(json_path: str, rank_path: str) -> bool:
    """Whether the tokenizer's .json names the same pieces, ids and special token as the rank file that is read here."""
    import json

    with open(json_path, encoding="utf-8") as file:
        held = json.load(file)
    drawn = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    letter = {chr(b): b for b in drawn} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in drawn)}
    special = [(t["content"].encode(), t["id"]) for t in held["added_tokens"]]
    pieces = {bytes(letter[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if (piece.encode(), i) not in special}
    return special == [(SPECIAL, SPECIAL_ID)] and pieces == merges(rank_path).ranks


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"


def cut(docs: DataFrame, path: str, most: int, end: int) -> DataFrame:
    """The pieces of every row, with the task that cut them and their place among that task's pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = merges(path), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                ids, at = token_ids(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = np.insert(ids, at[1:], end)  # each text ends with this id
                at = at + np.arange(len(at))
                total = np.diff(at)
                n = -(-total // most)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = total - (n - 1) * most
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * most)
                size = np.where(piece == 0, first[row], most)
                stored, begin = memoryview(ids.astype("<u4").tobytes()), at[row] + start
                crc = [zlib.crc32(stored[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), size.tolist())]
                order = np.argsort(size, kind="stable")
                counts = np.bincount(size, minlength=most + 1)
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + seen[size[order]]
                seen += counts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(place)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), PIECES)


def _pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two lengths there that add up to ``total``: those of which most are there."""
    x = np.arange(1, total // 2 + 1)
    if not len(x):
        return None
    n = np.where(x * 2 == total, left[x] // 2, np.minimum(left[x], left[total - x]))
    best = int(n.argmax())
    return (int(total - x[best]), int(x[best])) if n[best] > 0 else None


Runs = list[tuple[tuple[int, ...], int]]


def best_fit(items: list[tuple[int, int]], most: int, bins: dict[int, Runs] | None = None) -> dict[int, Runs]:
    """Best fit of (length, how many), longest first, into ``bins`` by gap: a gap's bins are filled before a wider one's."""
    bins = {} if bins is None else bins
    for length, n in items:
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = min(most // length, n)
                k = n // each
                bins.setdefault(most - each * length, []).append(((length,) * each, k))
                n -= k * each
                continue
            lengths, k = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            took = min(n, k)
            bins.setdefault(gap - length, []).append(((*lengths, length), took))
            if k > took:
                bins.setdefault(gap, []).append((lengths, k - took))
            n -= took
    return bins


class Sums:
    """Which lengths, pairs and triples of lengths that are still there add up to a gap."""

    def __init__(self, left: np.ndarray, depth: int):
        self.left, self.depth = left, depth
        self.there = self.pairs = None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """The lengths that fill ``gap``: as few as do, at most ``depth``."""
        if self.depth and self.left[gap]:
            return (gap,)
        found = _pair(self.left, gap) if self.depth > 1 else None
        return self._triple(gap) if found is None and self.depth > 2 else found

    def _triple(self, gap: int) -> tuple[int, ...] | None:
        now = self.left > 0
        if self.pairs is None or not (now == self.there).all():
            self.there, self.pairs = now, np.convolve(now.astype(np.float32), now.astype(np.float32)) > 0.5
        x = np.arange(1, gap)
        for one in x[now[x] & self.pairs[gap - x]][::-1]:
            self.left[one] -= 1
            two = _pair(self.left, gap - int(one))
            self.left[one] += 1
            if two is not None:
                return int(one), *two
        return None

    def use(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """How often ``lengths`` can be taken, ``most`` times at most; they are gone then."""
        of, need = np.unique(lengths, return_counts=True)
        n = int((self.left[of] // need).min())
        n = n if most is None else min(n, most)
        self.left[of] -= n * need
        return n


def _flat(bins: dict[int, Runs]) -> Runs:
    return [run for runs in bins.values() for run in runs]


def complemented(histogram: np.ndarray, most: int, depth: int) -> Runs:
    """The plan in which each gap is looked up among sums of up to ``depth`` lengths; best fit for the rest."""
    left = histogram.astype(np.int64).copy()
    sums, out, stuck = Sums(left, depth), [], []
    if left[most]:
        out.append(((most,), sums.use((most,))))
    for length in range(most - 1, 0, -1):
        gap = most - length
        while left[length]:
            left[length] -= 1  # what it may be combined with is looked up without it
            found = sums.exact(gap)
            left[length] += 1
            if found is None:
                stuck.append((length, int(left[length])))
                left[length] = 0
            else:
                out.append(((length, *found), sums.use((length, *found))))
    return out + _flat(best_fit(stuck, most))


def held_back(histogram: np.ndarray, most: int, floor: int, depth: int = 3) -> Runs:
    """The plan that spends lengths below ``floor`` last.

    Lengths that add up to a sequence are matched; what remains from ``floor`` up is packed best fit. The gaps that leaves,
    the widest first, are looked up among sums of up to ``depth`` of the shorter lengths that were held back; best fit for
    the rest.
    """
    left = histogram.astype(np.int64).copy()
    sums, bins, floor = Sums(left, depth), {}, max(floor, 1)
    for length in range(most, (most - 1) // 2, -1):
        own = (length, most - length) if length < most else (length,)
        if n := sums.use(own):
            bins.setdefault(0, []).append((own, n))
    best_fit([(length, int(left[length])) for length in range(most, floor - 1, -1) if left[length]], most, bins)
    left[floor:] = 0
    for gap in sorted((g for g in bins if 0 < g <= depth * floor), reverse=True):
        todo, rest = bins.pop(gap), []
        while todo:
            lengths, k = todo.pop()
            found = sums.exact(gap)
            if found is None:
                rest.append((lengths, k))
                continue
            n = sums.use(found, k)
            bins.setdefault(0, []).append(((*lengths, *found), n))
            if k > n:
                todo.append((lengths, k - n))
        if rest:
            bins[gap] = rest
    return _flat(best_fit([(length, int(left[length])) for length in range(floor - 1, 0, -1) if left[length]], most, bins))


def plan(histogram: np.ndarray, most: int) -> Runs:
    """(lengths of a sequence, how many such sequences), for ``histogram[length]`` pieces of each length.

    The first of the least: held back, then looked up from the longest down. Best fit alone is a guard.
    """
    plans = (*(held_back(histogram, most, most // part) for part in HELD_BACK), *(complemented(histogram, most, depth) for depth in (3, 2, 1, 0)))
    return min(plans, key=lambda runs: sum(n for _, n in runs))


def places(runs: list[tuple[tuple[int, ...], int]], most: int) -> tuple[np.ndarray, ...]:
    """By length and first rank: the key ``length << 44 | rank``, the first sequence and the offset of each run."""
    used, base = np.zeros(most + 1, np.int64), 0
    rows = []
    for lengths, n in runs:
        offset = 0
        for length in lengths:
            rows.append((length << 44 | int(used[length]), base, offset))
            used[length] += n
            offset += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(docs: DataFrame, path: str, most: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    pieces = written(cut(docs, path, most, end), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(most + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length up to ``most``
        histogram[length] = n
    key, sequence, offset = places(plan(histogram, most), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            mine = length << 44 | rank
            at = np.searchsorted(key, mine, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + mine - key[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(base, ["part", "length"]).select(  # a row for each task and length
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        lean(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path(RANKS))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, documents(spark, sf_dir), sf_dir)
