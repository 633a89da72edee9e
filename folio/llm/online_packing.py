"""Online packing by the sum of squares.

Method: documents are packed as they are read. A level array counts the partially filled windows of each fill; a document
goes to the level, or to a new window, that leaves the least sum of squared counts, so that no fill becomes frequent and most
documents find a window that they complete. A document longer than a window gives full windows and a rest, which is placed
like a document. Of equal choices the fullest window is taken.

Windows that are still partial when a task's rows end, or when ``OPEN`` of them are held, are closed without padding: those
filled up to a power of two stay as they are, the others are completed with cuts from the emptiest of them, and the one
window that remains at the end is cut into lengths that are powers of two. Documents are cut there only.

Each task packs its own rows, so nothing is shuffled and no window is shared; a task holds the ids of its open windows, at
most ``OPEN`` of them. A sequence's number holds the task's.

Defined results: a null text is empty and packs as its end token; repeated rows are packed as often as they come, a null
doc_id like any other; very long texts are encoded in steps; an empty table gives no pieces; other columns are ignored. Which
documents share a sequence depends on how rows are dealt over tasks; the contents and the padding of none don't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import documents, lean, python_ready, steps, text_rows, utf8
from folio.llm.packing import LENGTH, RANKS, merges, token_ids

END = 0
OPEN = 4096  # partial windows that a task holds; of 1,024 ids in 4 bytes: 16 MB
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
PIECES = ", ".join(f"{c} bigint" for c in COLUMNS)


class Levels:
    """How many partial windows there are of each fill, and which."""

    def __init__(self, most: int):
        self.most = most
        #: Twice the count and one: what one window more adds to the sum of squares. A full window adds nothing; a new window
        #: takes nothing away, which the entry of fill 0 says.
        self.cost = np.ones(most + 1, np.int64)
        self.cost[0], self.cost[most] = 2, 0
        self.there = np.zeros(most + 1, bool)
        self.there[0] = True
        self.windows: list[list] = [[] for _ in range(most + 1)]
        self.open = 0

    def best(self, size: int) -> int:
        """The fill of the window to take, 0 for a new one."""
        room = self.most - size + 1
        change = np.where(self.there[:room], self.cost[size:] - self.cost[:room], np.iinfo(np.int64).max)
        return int(room - 1 - change[::-1].argmin())

    def add(self, fill: int, window) -> None:
        self.windows[fill].append(window)
        self.cost[fill] += 2
        self.there[fill] = True
        self.open += 1

    def take(self, fill: int):
        self.cost[fill] -= 2
        self.there[fill] = len(self.windows[fill]) > 1
        self.open -= 1
        return self.windows[fill].pop()

    def drain(self) -> list:
        """All windows, the emptiest first; none are left."""
        return [self.take(fill) for fill in range(1, self.most) for _ in range(len(self.windows[fill]))]


@dataclass
class Piece:
    doc_id: int | None
    tokens: int  # of the whole document
    start: int
    ids: bytes  # four of them for each token

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first tokens but ``n``, and the last ``n``."""
        at = len(self) - n
        return Piece(self.doc_id, self.tokens, self.start, self.ids[: 4 * at]), Piece(self.doc_id, self.tokens, self.start + at, self.ids[4 * at :])


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece)

    def give(self, n: int) -> Piece:
        """Its last piece, or the last ``n`` tokens of it if it has more."""
        last = self.pieces.pop()
        if len(last) > n:
            rest, last = last.cut(n)
            self.pieces.append(rest)
        self.fill -= len(last)
        return last


class Packer:
    """Places pieces one by one; ``rows`` are those of closed windows."""

    def __init__(self, most: int, first: int, held: int = OPEN):
        self.levels, self.most, self.next, self.held = Levels(most), most, first, held
        self.rows: list[tuple] = []

    def close(self, window: Window) -> None:
        offset = 0
        for p in window.pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.tokens, self.next, offset))
            offset += len(p)
        self.next += 1

    def place(self, piece: Piece) -> None:
        fill = self.levels.best(len(piece))
        window = self.levels.take(fill) if fill else Window()
        window.put(piece)
        if window.fill == self.most:
            self.close(window)
            return
        self.levels.add(window.fill, window)
        if self.levels.open > self.held:
            self.settle()

    def settle(self, last: bool = False) -> None:
        """Closes all open windows without padding, but one; that one too where it is the ``last`` time."""
        windows = self.levels.drain()
        even = [w for w in windows if w.fill & (w.fill - 1) == 0]
        for window in even:
            self.close(window)
        windows = [w for w in windows if w.fill & (w.fill - 1)]
        low, high = 0, len(windows) - 1
        while low < high:
            full, source = windows[high], windows[low]
            full.put(source.give(self.most - full.fill))
            if full.fill == self.most:
                self.close(full)
                high -= 1
            if not source.fill:
                low += 1
        rest = windows[low] if low == high else None
        if rest is not None and not last:
            self.levels.add(rest.fill, rest)
        while rest is not None and last and rest.fill:
            window, n = Window(), 1 << rest.fill.bit_length() - 1  # the largest power of two in it
            while window.fill < n:
                window.put(rest.give(n - window.fill))
            self.close(window)


def pack_online(docs: DataFrame, path: str, most: int = LENGTH, end: int = END, held: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row.

    ``path`` is that of the tokenizer's ranks; ``end`` is the id that closes each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = merges(path), Packer(most, TaskContext.get().partitionId() << 40, held)

        def rows() -> pa.RecordBatch:
            table, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*table) if table else [[]] * len(COLUMNS))], COLUMNS)

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                ids, at = token_ids(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                stored = memoryview(np.insert(ids, at[1:], end).astype("<u4").tobytes())
                at = (at + np.arange(len(at))).tolist()
                for doc_id, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at, at[1:]):
                    for start in range(0, b - a, most):
                        piece = Piece(doc_id, b - a, start, bytes(stored[4 * (a + start) : 4 * min(a + start + most, b)]))
                        packer.place(piece)
                yield rows()
        packer.settle(last=True)
        yield rows()

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), PIECES)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_online(documents(spark, sf_dir), public_tokenizers.path(RANKS))
