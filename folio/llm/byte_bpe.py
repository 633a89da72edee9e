"""Byte-level BPE encoding and decoding.

Method: code points map to classes through one array; a finite automaton over these classes marks where a piece of the
public pattern starts. A character is a transition function on the automaton's states, and functions compose
associatively, so a text is scanned in blocks side by side: first each block's composed function, then the blocks' entry
states, then the marks. No regular expression runs. The pieces, slices of the text's bytes, feed a cache of merged
pieces; those it lacks are merged together in arrays, each merging its lowest-ranked leftmost pair at a time. Every
token keeps its byte offsets, so decoding is a gather.

Defined results: a null text is empty and has no tokens; any text, however long, is encoded whole (for digests in parts
that begin where a piece does: at a single space between two visible characters of ASCII); repeated rows are encoded each,
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import documents, lean, python_ready, steps, text_rows, utf8

MODEL = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 250_000
#: Longer pieces are merged with a heap, one by one.
LONG_PIECE = 256
BLOCK = 128
LONG_TEXT = 1 << 20  # bytes of a long text that are encoded at a time

# The pattern's character classes; its contractions are an apostrophe and one of these endings.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)  # BLANK: the space U+0020; SPACE: other white space
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States: after a character of a class, at a fresh start, with one or two letters of a contraction to come.
FRESH, ONE, TWO = 5, 6, 7
STATES = 8
# Symbols: the classes, a white-space character that starts a piece before a visible one (two kinds), contractions.
TIGHT_SPACE, TIGHT_BLANK, SHORT, LONG = 5, 6, 7, 8
FIRST = 16  # added to the symbol of a text's first character: whatever the state, it starts a piece


@lru_cache(1)
def classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = kind
    table[list(WHITE)] = SPACE
    table[0x20] = BLANK
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * STATES + state] and whether a piece starts there."""
    move, start = np.zeros(32 * STATES, np.uint8), np.zeros(32 * STATES, bool)
    for first in (0, FIRST):
        for symbol in range(9):
            for state in range(STATES):
                now = FRESH if first else state
                if now in (ONE, TWO):  # a letter of a contraction, whatever its symbol
                    after, begins = (ONE if now == TWO else FRESH), False
                elif symbol in (SHORT, LONG):
                    opens = now not in (OTHER, BLANK)
                    after, begins = ((ONE if symbol == SHORT else TWO) if opens else OTHER), opens
                elif symbol in (SPACE, BLANK):
                    after, begins = symbol, now not in (SPACE, BLANK)
                elif symbol in (TIGHT_SPACE, TIGHT_BLANK):
                    after, begins = (SPACE if symbol == TIGHT_SPACE else BLANK), True
                else:
                    after, begins = symbol, now not in (symbol, BLANK)
                move[(symbol + first) * STATES + state] = after
                start[(symbol + first) * STATES + state] = begins
    return move, start


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; ``firsts``: positions at which texts start."""
    kind = classes()[points]
    n = len(kind)
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[n - 1] = True
    white = kind >= SPACE
    tight = np.zeros(n, bool)
    tight[:-1] = white[:-1] & ~white[1:]
    out = kind + (tight & ~last) * np.uint8(2)  # SPACE to TIGHT_SPACE, BLANK to TIGHT_BLANK
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        ends = np.append(firsts[1:], n)
        stop = ends[np.searchsorted(firsts, marks, side="right") - 1]
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        for ending in ENDINGS:
            fits = (marks + len(ending) < stop) & (one == ord(ending[0]))
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            out[marks[fits]] = SHORT if len(ending) == 1 else LONG
    out[firsts] += FIRST
    return out


def scan(symbol: np.ndarray) -> np.ndarray:
    """Where pieces start, by an associative scan in blocks."""
    move, start = automaton()
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.int16) * STATES
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        composed = move[column[:, None] + composed]
    lone = composed.min(axis=1) == composed.max(axis=1)  # most blocks forget the state that they were entered in
    entry = np.empty(rows, np.uint8)
    entry[0] = FRESH
    entry[1:] = composed[:-1, 0]
    for i in np.flatnonzero(~lone[:-1]):
        entry[i + 1] = composed[i, entry[i]]
    out, state = np.empty((BLOCK, rows), bool), entry
    for i, column in enumerate(grid):
        at = column + state
        out[i] = start[at]
        state = move[at]
    return out.T.reshape(-1)[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which pieces start in ``data``, and each text's first piece; texts are given by ``offsets``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    filled = np.unique(offsets[:-1][np.diff(offsets) > 0])
    found = chars[scan(symbols(points, np.searchsorted(chars, filled)))]
    return found, np.searchsorted(found, offsets)


class Merges:
    """Merged pieces of a rank file, found once and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.ranks = ranks
        self.none = max(ranks.values()) + 1
        self._table(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(made, np.int64))
        order = sorted(ranks, key=ranks.get)
        size = np.zeros(self.none, np.int64)
        size[[ranks[t] for t in order]] = [len(t) for t in order]
        self.token_start = np.append(0, np.cumsum(size))
        self.token_bytes = np.frombuffer(b"".join(order), np.uint8)
        self.forget()

    def _table(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open addressing, an eighth full at most."""
        self.bits = int(len(keys) * 8).bit_length()
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, np.int64), np.full(size, self.none, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.made[at[won]] = made[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what a pair makes; ``none`` if nothing."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = self.made[slot]
        off = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        out[self.keys[slot] == -1] = self.none
        out[off] = self.none
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[off]]
            hit = there == keys[off]
            out[off[hit]] = self.made[slot[off[hit]]]
            off = off[~hit & (there != -1)]
        return out

    def forget(self) -> None:
        self.known = _Known()
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of the words, one after the other, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(ids), self.none, np.int64)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = self.rank(ids[same], ids[same + 1])
        done_word, done_ids = [], []
        while len(ids):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(heads, len(ids)))
            least = np.minimum.reduceat(rank, heads)
            idle = np.repeat(least == self.none, size)
            if idle.any():
                done_word.append(word[idle])
                done_ids.append(ids[idle])
                ids, word, rank = ids[~idle], word[~idle], rank[~idle]
                if not len(ids):
                    break
                size, least = size[least != self.none], least[least != self.none]
                heads = np.append(0, np.cumsum(size)[:-1])
            hits = np.flatnonzero(rank == np.repeat(least, size))
            at = hits[np.searchsorted(hits, heads)]  # the leftmost of each word
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                inside = np.zeros(len(left), bool)
                ok = left + 1 < len(ids)
                inside[ok] = word[left[ok]] == word[left[ok] + 1]
                rank[left[inside]] = self.rank(ids[left[inside]], ids[left[inside] + 1])
            rank[at[(at + 1 == len(ids)) | (word[np.minimum(at + 1, len(ids) - 1)] != word[at])]] = self.none
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: bytes) -> list[int]:
        """One word, by a heap of its pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = [*range(1, len(word) + 1)], [*range(-1, len(word) - 1)]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(word) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(word) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for left in (i, before[i]):
                if left >= 0 and after[left] < len(word) and (r := self.ranks.get(both := parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, both))
        return [self.ranks[p] for p in parts if p is not None]

    def _learn(self, new: list[bytes], base: int) -> None:
        short = [w for w in new if len(w) <= LONG_PIECE]
        ids, count = self.merge(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(short) < len(new):
            parts, at, k = [], np.append(0, np.cumsum(count)), 0
            all_count = []
            for w in new:
                if len(w) <= LONG_PIECE:
                    parts.append(ids[at[k] : at[k + 1]])
                    k += 1
                else:
                    parts.append(np.array(self.merge_long(w), np.int64))
                all_count.append(len(parts[-1]))
            ids, count = np.concatenate(parts), np.array(all_count, np.int64)
        need = base + len(new)
        while len(self.start) < need:
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[base:need] = self.used + np.append(0, np.cumsum(count)[:-1])
        self.count[base:need] = count
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other in ``data``, and where each text's begin."""
        found, text_piece = pieces(data, offsets)
        if not len(found):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        raw, cuts = data.tobytes(), found.tolist()
        cuts.append(len(raw))
        base = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, [raw[a:b] for a, b in zip(cuts, cuts[1:])]), np.int64, len(found))
        if self.known.new:
            self._learn(self.known.new, base)
            self.known.new = []
        count = self.count[index]
        ends = np.cumsum(count)
        take = np.repeat(self.start[index] - ends + count, count)
        take += np.arange(len(take))
        return self.flat[take], np.append(0, ends)[text_piece]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin among those of all, and the end."""
        return np.append(0, np.cumsum(self.token_start[ids + 1] - self.token_start[ids]))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids and each token's offsets."""
        at = self.offsets(ids)
        take = np.repeat(self.token_start[ids] - at[:-1], np.diff(at))
        take += np.arange(len(take))
        return self.token_bytes[take].tobytes(), at


class _Known(dict):
    """The number of each piece seen; those seen first are put down in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


@lru_cache(2)
def merges(path: str) -> Merges:
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) })


def parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts of at least ``most`` bytes, each of which begins where a piece of the whole text does."""
    lo, at = 0, most
    while at < len(data) - 1:
        window = data[at - 1 : at + most + 1]
        seen = (window > 0x20) & (window < 0x7F)
        fits = seen[:-2] & (window[1:-1] == 0x20) & seen[2:]
        if not fits.any():
            at += most
            continue
        at += int(fits.argmax())
        yield data[lo:at]
        lo, at = at, at + most
    yield data[lo:]


def digest(model: Merges, data: np.ndarray) -> tuple[int, str, str]:
    """The number of tokens of one long text and the digests of its ids and of what they decode to."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for part in parts(data, LONG_TEXT):
        ids, _ = model.encode(part, np.array([0, len(part)]))
        n += len(ids)
        of_ids.update(ids.astype("<u4").tobytes())
        of_text.update(model.decode(ids)[0])
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), starts (byte offset of each token) for every row: the operator's general output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in steps(offsets):
                ids, at = model.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                start = model.offsets(ids)[:-1]
                start -= np.repeat(offsets[lo:hi] - offsets[lo], np.diff(at))
                rows = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(rows, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(rows, pa.array(start))],
                    ["doc_id", "ids", "starts"],
                )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), "doc_id bigint, ids array<int>, starts array<bigint>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded, each text on the worker that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n, of_ids, of_text = [], [], []
            for lo, hi in steps(offsets):
                if hi - lo == 1 and offsets[hi] - offsets[lo] > 2 * LONG_TEXT:
                    one = digest(model, data[offsets[lo] : offsets[hi]])
                    n.append(np.array(one[:1]))
                    of_ids.append(one[1])
                    of_text.append(one[2])
                    continue
                ids, at = model.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                text, token_at = model.decode(ids)
                stored, text_at = memoryview(ids.astype("<u4").tobytes()), token_at[at].tolist()
                view, n_at = memoryview(text), at.tolist()
                n.append(np.diff(at))
                of_ids += [hashlib.sha256(stored[4 * a : 4 * b]).hexdigest() for a, b in zip(n_at, n_at[1:])]
                of_text += [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(text_at, text_at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path(MODEL))
