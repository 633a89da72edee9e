"""Near duplicates: an exact Jaccard join of word shingles.

Method: documents with equal sets form a class. Two sets whose Jaccard index reaches the threshold share a shingle among
their first ones in any fixed order, so classes meet in tiles of one such shingle and one size band: each stands in its own
band and, where a partner may be in the next one, as a guest there. Signatures are hashed bitmaps, as wide as their sets
ask for: the bits in which two differ bound the overlap from above, and only pairs that pass have their sorted arrays
intersected, exactly. No link is missed and none is guessed.

What keeps tiles small: the order puts shingles that many documents hold last (a table of at most ``COMMON`` shingles,
by counts over all documents that are lower bounds; they set the order, and so the cost, not which links are found). A
pair need meet only at the first shingle that it shares, so sizes and positions there bound the overlap before any
signature is read.

What keeps hot groups cheap: in a first round a class meets only the first of its tile, its ``NEXT`` predecessors and, in
long tiles, a few pivots, so a group of any size costs in proportion. The exact links of that round make components. In a
second round, tiles that still hold several components are dealt into blocks of about ``MEMBERS`` classes: a component
that fills blocks of its own never meets itself again, and each pair of blocks is one small step of work, so no task's
work grows with the square of a tile. In a pair of blocks only the classes that sizes and positions leave a partner in
another component bring signatures, and only those that signatures leave one bring arrays; what leaves it is links that
join components, never a row per pair.

Scale: the tiles of the first round travel packed by ranges of hashes, of which there are as many as the corpus's shingles
ask for (``RANGE`` entries each); the blocks of the second stream through a task one pair of blocks at a time. Broadcast
are the table of common shingles (bounded) and ids of named documents where a count shows that there are at most
``BROADCAST``; beyond it the join shuffles. Long texts are read in steps that end between words.

Defined results: null and empty texts, and texts without a word, have no shingles and link with nothing; a text of fewer
than five words is one shingle; rows without doc_id are returned with a null component and take no part; repeated rows
and equal texts are one component; rows that share a doc_id but not a text belong each to their own text's component; a
very long text is one set like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folio.llm.common import STEP_BYTES, documents, lean, python_ready, released, scratch, steps, text_rows, tidy, utf8, written
from folio.llm.components import components
from folio.llm.shingles import distinct, mix, shingles

#: The threshold is the fraction NUMERATOR / DENOMINATOR, so that every bound is exact in integers.
NUMERATOR, DENOMINATOR = 4, 5
COMMON = 1 << 19
COMMON_IN_TASK = 3  # documents of a task that hold a shingle before the task reports it
NEXT = 16
BLOCK = 1 << 13  # classes of a common shingle's tile in one block
PIVOTS = 16
MEMBERS = 128  # classes of a tile in one block of the second round
RANGE = 1 << 20  # entries of the first round's tiles in one range, about
BROADCAST = 1 << 20
PAIRS = 256  # pairs whose signatures or arrays are tested at a time
FLUSH = 1 << 18  # entries of tiles that a task packs at a time
SLOTS = 1 << 24  # counters, of a byte each, that tell a task which shingles it may have seen often enough

_U = np.uint64
_GATE_BITS = 22


def needed(s, t):
    """The overlap that sizes ``s`` and ``t`` need: o / (s + t - o) >= the threshold."""
    return -(-(s + t) * NUMERATOR // (NUMERATOR + DENOMINATOR))


def probe_length(s):
    """First shingles of a set among which it meets every partner that isn't larger."""
    return s - -(-s * NUMERATOR // DENOMINATOR) + 1


def class_of(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each row's set, the same for equal sets."""
    n = np.diff(begin)
    sums = np.append(_U(0), np.cumsum(mix(sets), dtype=np.uint64))
    return mix(sums[begin[1:]] - sums[begin[:-1]] + n.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows, the texts' shingles and where each text's begin."""
    data, offsets = utf8(batch.column(1))
    for lo, hi in steps(offsets):
        yield lo, hi, *shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


# --- first pass: sizes, classes and common shingles ---


def sized(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, hash of the set) and, with ``common`` set, of shingles (how many hold it, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["common", "doc_id", "n", "hash"]
        slots, added = np.zeros(SLOTS, np.uint8), 0
        often, often_n, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            both, back = np.unique(np.concatenate([often, *new]), return_inverse=True)
            n = np.bincount(back, np.concatenate([often_n, np.ones(len(back) - len(often), np.int64)]), len(both)).astype(np.int64)
            if len(both) > COMMON:  # of a very large task the most frequent stay
                keep = np.argsort(-n, kind="stable")[: COMMON // 2]
                keep.sort()
                both, n = both[keep], n[keep]
            return both, n

        for batch in batches:
            for lo, hi, values, begin in _sets(batch):
                values, begin = distinct(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(hi - lo, bool)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(begin)), pa.array(class_of(values, begin).view(np.int64))], names
                )
                at = (values % _U(SLOTS)).astype(np.int64)
                np.add.at(slots, at, (slots[at] < COMMON_IN_TASK).astype(np.uint8))
                new.append(values[slots[at] >= COMMON_IN_TASK])
                added += len(values)
                if sum(map(len, new)) > FLUSH:
                    (often, often_n), new = counted(), []
                if added > SLOTS // 2:  # so full that chance would fill more
                    slots[:], added = 0, 0
        often, often_n = counted()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(often), bool)), pa.nulls(len(often), pa.int64()), pa.array(often_n + COMMON_IN_TASK - 1), pa.array(often.view(np.int64))], names
        )

    return text_rows(docs).mapInArrow(lean(run), "common boolean, doc_id bigint, n bigint, hash bigint")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, rarest first, and how many documents hold each: ``COMMON`` at most.

    A histogram of the counts, in steps of an eighth of their binary logarithm, says which counts are high enough, so no
    task sorts or gathers what all tasks report.
    """
    counts = written(rows.where("common").groupBy("hash").agg(F.sum("n").alias("n")), "common")
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for at, n in sorted((tuple(r) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True):
        total += n
        if total > COMMON:
            break
        least = at
    top = (counts.where(step >= least) if least is not None else counts.limit(0)).toArrow()
    value, n = (np.asarray(top.column(x).combine_chunks()).astype(np.int64) for x in ("hash", "n"))
    order = np.lexsort((value, n))
    return value[order].view(np.uint64), n[order]


# --- second pass: tiles ---

#: A class in a tile: the shingle's key, the class, the block, its size, the key's place in it, whether the tile is dealt
#: over several blocks, and whether the class is at home in the band or a guest.
ENTRY = np.dtype([("key", "<u8"), ("cls", "<u8"), ("block", "<i4"), ("size", "<i4"), ("at", "<i4"), ("dealt", "<i2"), ("home", "<i2")])
_SPREAD = 1 << 62
BAND_BITS = 2  # a band's sizes lie between two neighbouring powers of 2 ** BAND_BITS


def band(size: np.ndarray) -> np.ndarray:
    """The size band of each set."""
    return (np.frexp(size)[1].astype(np.int64) - 1) // BAND_BITS


def visits(size: np.ndarray) -> np.ndarray:
    """Whether a larger partner may be in the next band."""
    return band(size * DENOMINATOR // NUMERATOR) > band(size)


class Order:
    """The order of shingles: those that aren't common by hash, then the common ones, rarest first."""

    def __init__(self, common: np.ndarray, count: np.ndarray):
        self.rank = np.argsort(common).astype(np.uint64)
        self.sorted = common[np.argsort(common)]
        self.count = count
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[common >> _U(64 - _GATE_BITS)] = True

    def keys(self, values: np.ndarray) -> np.ndarray:
        out = values >> _U(2)
        maybe = np.flatnonzero(self.gate[values >> _U(64 - _GATE_BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.sorted, values[maybe]), len(self.sorted) - 1)
            hit = self.sorted[at] == values[maybe]
            out[maybe[hit]] = _U(_SPREAD) + self.rank[at[hit]]
        return out

    def blocks(self, keys: np.ndarray) -> np.ndarray:
        """Blocks over which a shingle's tile is dealt."""
        out = np.ones(len(keys), np.int64)
        common = keys >= _U(_SPREAD)
        out[common] = -(-self.count[(keys[common] - _U(_SPREAD)).astype(np.int64)] // BLOCK)
        return out


def pivot(cls: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Whether a class is one of about ``PIVOTS`` among ``expected``: it then stands in every block."""
    return (mix(cls ^ _U(0xA5A5A5A5)) >> _U(32)).astype(np.float64) * np.maximum(expected, 1) < PIVOTS * 2.0**32


def in_order(values: np.ndarray, begin: np.ndarray, order: Order) -> np.ndarray:
    """The keys of sorted sets, each set's in the order of shingles."""
    keys = order.keys(values)
    common = np.flatnonzero(keys >= _U(_SPREAD))
    for i in np.unique(np.searchsorted(begin, common, side="right") - 1).tolist():  # the others are in order
        keys[begin[i] : begin[i + 1]].sort()
    return keys


def entries(values: np.ndarray, begin: np.ndarray, order: Order, seen: set[int]) -> np.ndarray:
    """What the classes of some texts put into tiles; classes of this task that did so before put in nothing."""
    values, begin = distinct(values, begin)
    keys, sets, n = in_order(values, begin, order), class_of(values, begin), np.diff(begin)
    fresh = np.zeros(len(n), bool)
    for i in np.flatnonzero(n).tolist():
        if (c := int(sets[i])) not in seen:
            seen.add(c)
            fresh[i] = True
    first = np.where(fresh, np.minimum(probe_length(n), n), 0)
    row = np.repeat(np.arange(len(n)), first)
    at = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first)
    key = keys[begin[:-1][row] + at]
    blocks = order.blocks(key)
    out = np.empty(len(row), ENTRY)
    out["key"], out["cls"], out["size"], out["at"], out["dealt"], out["home"] = key, sets[row], n[row], at, blocks > 1, 1
    out["block"] = mix(out["cls"]) % blocks.astype(np.uint64)
    parts = [out]
    wide = np.flatnonzero(blocks > 1)
    for i in wide[pivot(out["cls"][wide], blocks[wide] * BLOCK)].tolist():  # pivots stand in the other blocks too
        copies = np.repeat(out[i : i + 1], blocks[i])
        copies["block"] = np.arange(blocks[i])
        parts.append(copies[copies["block"] != out["block"][i]])
    every = np.concatenate(parts)
    guests = every[visits(every["size"].astype(np.int64))]
    guests["home"] = 0
    return np.concatenate([every, guests])


def bands(entry: np.ndarray) -> np.ndarray:
    """The band in which each entry stands."""
    return band(entry["size"]) + (entry["home"] == 0)


def tiles(docs: DataFrame, order: Order, ranges: int) -> DataFrame:
    """(range, entries): the entries of all tiles, packed by ranges of their tiles' hashes."""

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
        spot = every["block"].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + bands(every).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        of = (mix(every["key"] + spot) % _U(ranges)).astype(np.int64)
        by = np.argsort(of, kind="stable")
        every, counts = every[by], np.bincount(of, minlength=ranges)
        some, cuts = np.flatnonzero(counts), np.append(0, np.cumsum(counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([every[cuts[i] : cuts[i + 1]].tobytes() for i in some.tolist()], pa.binary())],
            ["range", "entries"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, held = [], 0
        for batch in batches:
            for _, _, values, begin in _sets(batch):
                parts.append(entries(values, begin, order, seen))
                held += len(parts[-1])
                if held >= FLUSH:
                    yield packed(parts)
                    parts, held = [], 0
        yield packed(parts)

    return text_rows(docs).where("doc_id IS NOT NULL").mapInArrow(lean(run), "range int, entries binary")


def may_link(s: np.ndarray, i: np.ndarray, t: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``s`` <= ``t`` may reach the threshold if what they share first is at ``i`` and ``j``.

    A pair that doesn't share it first may be refused here: it meets at the shingle that it does share first.
    """
    return (s * DENOMINATOR >= t * NUMERATOR) & (np.minimum(s - i, t - j) >= needed(s, t))


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at_home = (a["home"] | b["home"]) > 0
    return may_link(*(x.astype(np.int64) for x in (a["size"], a["at"], b["size"], b["at"]))) & (a["cls"] != b["cls"]) & at_home


def first_round(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes to test, and the entries of tiles in which not every pair was among them."""
    entry = entry[np.argsort(entry["key"], kind="stable")]
    start = np.flatnonzero(np.append(True, entry["key"][1:] != entry["key"][:-1])) if len(entry) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(entry)))
    entry = entry[np.repeat((size > 1), size) | (entry["dealt"] > 0)]
    if not len(entry):
        return np.zeros((0, 2), np.uint64), entry
    entry = entry[np.lexsort((entry["cls"], entry["size"], bands(entry), entry["block"], entry["key"]))]
    banded = bands(entry)
    same = (entry["key"][1:] == entry["key"][:-1]) & (entry["block"][1:] == entry["block"][:-1]) & (banded[1:] == banded[:-1])
    new = np.append(True, ~(same & (entry["cls"][1:] == entry["cls"][:-1])))
    opens = np.append(True, ~same)  # an entry that comes again never opens a tile
    entry, start = entry[new], np.flatnonzero(opens[new])
    size = np.diff(np.append(start, len(entry)))
    mine, here = np.repeat(start, size), np.arange(len(entry))
    meetings = [(mine, here), *((here[:-d], here[d:]) for d in range(1, NEXT + 1) if d < len(here))]
    out = [np.zeros((0, 2), np.uint64)]
    for a, b in meetings:
        fits = (mine[a] == mine[b]) & (a != b)
        a, b = a[fits], b[fits]
        fits = _fit(entry[a], entry[b])
        out.append(np.stack([entry["cls"][a[fits]], entry["cls"][b[fits]]], 1))
    open_ = np.repeat(size > NEXT + 2, size) | (entry["dealt"] > 0)
    for lo, n in zip(start.tolist(), size.tolist()):
        if n <= NEXT + 2:
            continue
        tile = entry[lo : lo + n]
        for p in np.flatnonzero(pivot(tile["cls"], np.full(n, n))).tolist():
            other = np.arange(n)
            a, b = np.minimum(other, p), np.maximum(other, p)
            fits = _fit(tile[a], tile[b])
            out.append(np.stack([tile["cls"][a[fits]], tile["cls"][b[fits]]], 1))
    found = np.concatenate(out)
    found = np.stack([found.min(axis=1), found.max(axis=1)], 1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]).any(axis=1)
    return found[new], entry[open_]


ROUND = "a bigint, b bigint, key bigint, size int, at int, band int, home boolean"


def meet(packed: DataFrame) -> DataFrame:
    """Rows of pairs (a, b), and of entries of open tiles (b null: a is a class, with key, size, at, band and home)."""

    def run(table: pa.Table) -> pa.Table:
        pairs, left = first_round(np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY))
        signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        plain = lambda x, kind: pa.array(np.ascontiguousarray(x).astype(kind))
        tidy()
        n, m = len(pairs), len(left)
        columns = [
            (signed(pairs[:, 0]), signed(left["cls"])),
            (signed(pairs[:, 1]), pa.nulls(m, pa.int64())),
            (pa.nulls(n, pa.int64()), signed(left["key"])),
            (pa.nulls(n, pa.int32()), plain(left["size"], np.int32)),
            (pa.nulls(n, pa.int32()), plain(left["at"], np.int32)),
            (pa.nulls(n, pa.int32()), plain(bands(left), np.int32)),
            (pa.nulls(n, pa.bool_()), plain(left["home"], bool)),
        ]
        return pa.table([pa.concat_arrays(c) for c in columns], names=["a", "b", "key", "size", "at", "band", "home"])

    return packed.groupBy("range").applyInArrow(run, ROUND)


# --- signatures, sorted arrays and the exact test ---


def bitmap(values: np.ndarray, width: int = 0) -> bytes:
    """The set's low bits hashed into a bitmap of ``width`` bits, a power of two; by default four times its size."""
    width = width or max(256, 1 << int(4 * len(values) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(values & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap at a smaller width of ``size`` bytes."""
    array = np.frombuffer(bits, np.uint8)
    return bits if len(bits) == size else np.bitwise_or.reduce(array.reshape(-1, size), axis=0).tobytes()


def bound(n: int, x: bytes, m: int, y: bytes) -> int:
    """An upper bound of the overlap: every bit in which the bitmaps differ stands for an element that isn't shared."""
    size = min(len(x), len(y))
    apart = int.from_bytes(folded(x, size), "little") ^ int.from_bytes(folded(y, size), "little")
    return (n + m - apart.bit_count()) // 2


def signed(docs: DataFrame, make) -> DataFrame:
    """(cls, n, x) of the documents' classes, where ``make`` gives bytes ``x`` from a sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, values, begin in _sets(batch):
                values, begin = distinct(values, begin)
                cls, n, rows = class_of(values, begin).view(np.int64).tolist(), np.diff(begin).tolist(), []
                for i, c in enumerate(cls):
                    if n[i] and c not in seen:
                        seen.add(c)
                        rows.append((c, n[i], make(values[begin[i] : begin[i + 1]])))
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["cls", "n", "x"])

    return text_rows(docs).mapInArrow(lean(run), "cls bigint, n int, x binary")


def array(values: np.ndarray) -> bytes:
    return values.tobytes()


def of_classes(docs: DataFrame, classes: DataFrame, leaders: DataFrame, make, name: str) -> DataFrame:
    """``signed`` for some classes, one row each, from the documents that stand for them; ids are broadcast where a count allows it."""
    ids = written(classes.select("cls").distinct().join(leaders, "cls").select(F.col("lead").alias("doc_id")).distinct(), "named")
    named = text_rows(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_semi")
    made = written(signed(named, make), name)
    rows, classes = made.agg(F.count(F.lit(1)), F.countDistinct("cls")).first()
    return made if rows == classes else written(made.dropDuplicates(["cls"]), name)  # repeated rows of one doc_id


def _beside(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Each pair with the sizes and the signatures or arrays of both sides."""
    for side in ("a", "b"):
        own = made.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("x").alias(f"x_{side}"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "n_a", "n_b", "x_a", "x_b")


def _tested(rows: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits: list[bool] = []
            for lo in range(0, len(batch), PAIRS):  # bytes are copied for a few pairs at a time
                part = batch.slice(lo, PAIRS)
                fits += [test(*x) for x in zip(*(part.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def within_bound(n: int, m: int, x: bytes, y: bytes) -> bool:
    return bound(n, x, m, y) >= needed(n, m)


def linked(n: int, m: int, x, y) -> bool:
    """The exact test; ``x`` and ``y`` are sorted arrays or their bytes."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= needed(n, m)


def links(pairs: DataFrame, docs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The pairs that reach the threshold, exactly."""
    with scratch(docs.sparkSession):
        return released(_links(pairs, docs, leaders))


def _links(pairs: DataFrame, docs: DataFrame, leaders: DataFrame) -> DataFrame:
    both = lambda p: p.select(F.explode(F.array("a", "b")).alias("cls"))
    bits = of_classes(docs, both(pairs), leaders, bitmap, "bits")
    bounded = written(_tested(_beside(pairs, bits), within_bound), "bounded")
    return written(_tested(_beside(bounded, of_classes(docs, both(bounded), leaders, array, "arrays")), linked).distinct(), "links")


# --- second round ---

#: A class in a pair of blocks (lo, hi) of a tile, and the block that it is of.
MEMBER = "key bigint, cls bigint, size int, at int, root bigint, band int, home boolean, block int, lo int, hi int"
COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]
PLACE = ["key", "band", "lo", "hi"]


def dealt(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes of tiles that hold several components, in every pair of blocks in which they may meet another one's.

    A component with more than ``MEMBERS`` classes in a tile fills blocks of its own there; the others share blocks.
    """
    owned = written(
        open_.join(roots, open_["cls"] == roots["node"], "left").select("key", "cls", "size", "at", F.coalesce("root", "cls").alias("root"), "band", "home"), "open"
    )
    held = owned.groupBy("key", "band", "root").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home"))
    pieces = F.when(F.col("n") > MEMBERS, F.ceil(F.col("n") / MEMBERS))
    held = written(held.select("key", "band", "root", "n", "home", pieces.cast("int").alias("pieces")), "held")
    several = written(
        held.groupBy("key", "band")
        .agg(F.count(F.lit(1)).alias("roots"), F.max("home").alias("home"), F.sum(F.when(F.col("pieces").isNull(), F.col("n")).otherwise(0)).alias("pooled"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("own"))
        .where("roots > 1 AND home")
        .select("key", "band", F.ceil(F.col("pooled") / MEMBERS).cast("int").alias("shared"), F.col("own").cast("int").alias("own")),
        "several",
    )  # written, so that a hot tile's rows meet it in a join that can be split
    before = Window.partitionBy("key", "band").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)  # a row for MEMBERS classes at least
    large = held.where("pieces IS NOT NULL").select("key", "band", "root", "pieces", F.coalesce(F.sum("pieces").over(before), F.lit(0)).cast("int").alias("past"))
    rows = owned.join(several, ["key", "band"]).join(large, ["key", "band", "root"], "left")
    first = F.col("shared") + F.col("past")
    spot = F.pmod(F.xxhash64("cls"), F.coalesce("pieces", "shared")).cast("int")
    rows = rows.select("*", F.coalesce(first, F.lit(0)).alias("first"), (F.coalesce(first, F.lit(0)) + spot).alias("block"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("shared") + F.col("own") - 1),
        lambda x: F.col("pieces").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("pieces")),
    )
    rows = rows.select("*", F.explode(others).alias("other"))
    return rows.select("key", "cls", "size", "at", "root", "band", "home", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


class Blocks:
    """Some pairs of blocks, one after another, each one's classes by size."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.of = {x: table.column(x).to_numpy() for x in COLUMNS}
        n = len(table)
        change = np.logical_or.reduce([self.of[x][1:] != self.of[x][:-1] for x in PLACE]) if n > 1 else np.zeros(0, bool)
        self.start = np.append(0, np.flatnonzero(change) + 1)[: 1 if n == 0 else None]
        self.end = np.append(self.start[1:], n)

    def worth(self) -> Iterator[tuple[int, int]]:
        """Where the pairs of blocks with several components lie, and with a class at home."""
        if not len(self.table):
            return
        root, home = self.of["root"], self.of["home"]
        some = (np.minimum.reduceat(root, self.start) < np.maximum.reduceat(root, self.start)) & np.logical_or.reduceat(home, self.start)
        yield from zip(self.start[some].tolist(), self.end[some].tolist())

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows a to b, of different components, that sizes and positions allow; the smaller set first."""
        size, at = (self.of[x][a:b].astype(np.int64) for x in ("size", "at"))
        root, home, block = (self.of[x][a:b] for x in ("root", "home", "block"))
        fits = may_link(size[:, None], at[:, None], size, at) & (root[:, None] != root) & (home[:, None] | home)
        if self.of["lo"][a] != self.of["hi"][a]:
            fits &= block[:, None] != block
        i, j = np.nonzero(np.triu(fits, 1))
        return i + a, j + a

    def bound(self, bits: list[bytes], a: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs the signatures of rows from ``a`` on allow; a few at a time."""
        least = min(map(len, bits))
        signs = np.stack([np.frombuffer(folded(x, least), np.uint64) for x in bits])
        size, out = self.of["size"].astype(np.int64), np.zeros(len(i), bool)
        step = max(1, STEP_BYTES // least)
        for lo in range(0, len(i), step):
            x, y = i[lo : lo + step], j[lo : lo + step]
            apart = np.bitwise_count(signs[x - a] ^ signs[y - a]).sum(axis=1, dtype=np.int64)
            out[lo : lo + step] = (size[x] + size[y] - apart) // 2 >= needed(size[x], size[y])
        return out


def _streamed(work):
    """``work`` (from Blocks to a table) over rows that come sorted by pairs of blocks: a step holds whole pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and all(held[-1].column(x)[-1] == batch.column(x)[-1] for x in PLACE):
                held.append(batch)  # the last pair of blocks goes on
                continue
            table = pa.Table.from_batches([*held, batch])
            cut = int(Blocks(table).start[-1])
            if cut:
                yield from work(Blocks(table.slice(0, cut))).to_batches()
            held = table.take(pa.array(np.arange(cut, len(table)))).to_batches()  # a copy, so that the batch can go
            del table, batch
        if held:
            yield from work(Blocks(pa.Table.from_batches(held))).to_batches()

    return run


def _met(members: DataFrame, made: DataFrame | None, ranges: int, work, schema: str) -> DataFrame:
    rows = members if made is None else members.join(made.select("cls", "x"), "cls").select(*COLUMNS, "x")
    return rows.repartition(ranges, *PLACE).sortWithinPartitions(*PLACE, "size", "cls").mapInArrow(lean(_streamed(work)), schema)


def _marks(signs: bool):
    """The rows that have a partner in their pair of blocks, by sizes and positions and, with ``signs``, by signatures."""

    def work(blocks: Blocks) -> pa.Table:
        has = np.zeros(len(blocks.table), bool)
        for a, b in blocks.worth():
            i, j = blocks.pairs(a, b)
            if signs and len(i):
                fits = blocks.bound(blocks.table.column("x").slice(a, b - a).to_pylist(), a, i, j)
                i, j = i[fits], j[fits]
            has[i] = has[j] = True
        return blocks.table.select(COLUMNS).filter(pa.array(has))

    return work


def _joins(blocks: Blocks) -> pa.Table:
    """Links (a, b), exact ones, that join components within a pair of blocks."""
    out = []
    for a, b in blocks.worth():
        own = [np.frombuffer(x, np.uint64) for x in blocks.table.column("x").slice(a, b - a).to_pylist()]
        i, j = blocks.pairs(a, b)
        if not len(i):
            continue
        width = max(256, 1 << int(8 * max(map(len, own)) - 1).bit_length())
        fits = blocks.bound([bitmap(v, width) for v in own], a, i, j)
        above: dict[int, int] = {}

        def root(node: int) -> int:
            while (up := above.get(node, node)) != node:
                node = up
            return node

        cls, of = blocks.of["cls"], blocks.of["root"]
        for x, y in zip(i[fits].tolist(), j[fits].tolist()):
            r, s = root(int(of[x])), root(int(of[y]))
            if r != s and linked(len(own[x - a]), len(own[y - a]), own[x - a], own[y - a]):
                above[max(r, s)] = min(r, s)
                out.append((int(cls[x]), int(cls[y])))
    a, b = zip(*out) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def second_round(open_: DataFrame, roots: DataFrame, docs: DataFrame, leaders: DataFrame, ranges: int) -> DataFrame:
    """Links (a, b) that join components of open tiles."""
    with scratch(docs.sparkSession):
        return released(_second_round(open_, roots, docs, leaders, ranges))


def _second_round(open_: DataFrame, roots: DataFrame, docs: DataFrame, leaders: DataFrame, ranges: int) -> DataFrame:
    members = written(_met(dealt(open_, roots), None, ranges, _marks(False), MEMBER), "marked")
    members = written(_met(members, of_classes(docs, members, leaders, bitmap, "more-bits"), ranges, _marks(True), MEMBER), "remarked")
    return written(_met(members, of_classes(docs, members, leaders, array, "more-arrays"), ranges, _joins, "a bigint, b bigint"), "more-links")


# --- the join ---


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (a hash of the set) and component_id for every row of ``docs``."""
    python_ready(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows, led, lowest = (released(x) for x in _components_of(docs))
    rows = rows.where("NOT common").select("doc_id", F.col("n").alias("n_shingles"), F.col("hash").alias("cls"))
    named_by = led.join(lowest, "root").select("cls", "component_id")
    return rows.join(named_by, "cls", "left").select(
        "doc_id",
        "n_shingles",
        "cls",
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the rows of ``sized``; each class with its first doc_id and its root; each root's least doc_id."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = written(sized(docs), "sizes")
    rows = first.where("NOT common").select("doc_id", F.col("n").alias("n_shingles"), F.col("hash").alias("cls"))
    leaders = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("lead"))
    most = rows.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(4 * partitions, -(-most * (DENOMINATOR - NUMERATOR) // (DENOMINATOR * RANGE)))
    met = written(meet(tiles(docs, Order(*common_shingles(first)), ranges)), "meetings")
    pairs = met.where("b IS NOT NULL").select("a", "b").distinct()
    open_ = met.where("b IS NULL").select(F.col("a").alias("cls"), "key", "size", "at", "band", "home").distinct()
    near = links(pairs, docs, leaders)
    more = second_round(open_, components(near), docs, leaders, partitions)
    roots = components(near.unionByName(more))
    led = written(leaders.join(roots, leaders["cls"] == roots["node"], "left").select("cls", "lead", F.coalesce("root", "cls").alias("root")), "led")
    lowest = written(led.groupBy("root").agg(F.min("lead").alias("component_id")), "lowest")  # for a join that can be split
    return first, led, lowest


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return joined(docs).select("doc_id", "n_shingles", "component_id")


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` with the hash of each one's set in a column ``name``."""
    fields = [f.name for f in docs.schema.fields]
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)] * 2, ["doc_id", "text"])
            own = [class_of(*distinct(values, begin)).view(np.int64) for _, _, values, begin in _sets(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], [*fields, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay: of each component those with the smallest doc_id, with all columns; rows without doc_id stay.

    A doc_id whose rows all go is left out by its id; where rows of one doc_id have different texts and only some go, the
    hash of each row's set tells which.
    """
    with scratch(spark):
        all_of = joined(docs).where("doc_id IS NOT NULL")
        fates = released(written(all_of.groupBy("doc_id", "cls").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("goes")), "fates"))
    each = fates.groupBy("doc_id").agg(F.max("goes").alias("some"), F.min("goes").alias("all"))
    gone = written(each.where("some").select("doc_id", "all"), "gone")
    named = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    stay = docs.join(named, "doc_id", "left_anti").select(*docs.columns)
    if gone.where("NOT all").isEmpty():
        return stay
    name = "cls"
    while name in docs.columns:
        name += "_"
    mixed = _with_class(docs.join(gone.where("NOT all"), "doc_id", "left_semi").select(*docs.columns), name)
    left = fates.where("NOT goes").select("doc_id", F.col("cls").alias(name))
    return stay.unionByName(mixed.join(left, ["doc_id", name], "left_semi").select(*docs.columns))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)
), r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
