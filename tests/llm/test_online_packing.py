import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folio.llm import online_packing
from folio.llm.online_packing import Levels, Packer, Piece


def squares(fills, most, size, at):
    """The sum of squared counts of partial windows if ``size`` went to a window of fill ``at``."""
    counts = np.bincount(fills, minlength=most + 1)
    if at:
        counts[at] -= 1
    counts[at + size] += 1
    return int((counts[1:most] ** 2).sum())


def test_levels_minimise_squares():
    """Each choice against the sums of all choices, the fullest of the best."""
    pick, most, levels, fills = random.Random(5), 48, Levels(48), []
    for _ in range(3000):
        size = pick.choice((pick.randint(1, most), 30, 31))
        options = [0, *sorted({f for f in fills if f + size <= most})]
        want = min(options, key=lambda at: (squares(fills, most, size, at), -at))
        assert levels.best(size) == want
        if want:
            fills.remove(want)
            levels.take(want)
        if want + size < most:
            fills.append(want + size)
            levels.add(want + size, None)
        assert levels.open == len(fills)


def whole(rows, most, ids):
    """Checks pieces (doc, start, length, crc, tokens, sequence, offset) against ``ids`` of each doc, and the padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in rows:
        docs[doc].append((start, length, crc, tokens))
        sequences[sequence].append((offset, length))
    assert docs.keys() == ids.keys()
    for doc, pieces in docs.items():
        end = 0
        for start, length, crc, tokens in sorted(pieces):
            assert start == end and length > 0 and tokens == len(ids[doc])
            assert crc == zlib.crc32(np.asarray(ids[doc][start : start + length], "<u4").tobytes())
            end += length
        assert end == len(ids[doc])
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= most and (end == most or end & (end - 1) == 0)
    return sequences


@pytest.mark.parametrize("sizes,held", [([600], 50), ([1, 2, 700, 33], 4096), ([341, 342, 683], 5), (list(range(1, 1025)), 4096), (list(range(1, 1025)), 3), ([512], 4), ([5], 10)])
def test_packer(sizes, held):
    pick, packer, ids = random.Random(2), Packer(1024, 7 << 40, held), {}
    for doc in range(1500):
        ids[doc] = [doc] * pick.choice(sizes)
        packer.place(Piece(doc, len(ids[doc]), 0, np.asarray(ids[doc], "<u4").tobytes()))
        assert packer.levels.open <= held
    packer.settle(last=True)
    sequences = whole(packer.rows, 1024, ids)
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 1024) + (10 if sizes != [512] else total // 1024 + 10)


def test_few_documents_are_cut():
    pick, packer, n = random.Random(9), Packer(1024, 0), 20_000
    for doc in range(n):
        size = min(1024, max(1, int(pick.lognormvariate(5.5, 1))))
        packer.place(Piece(doc, size, 0, bytes(4 * size)))
    packer.settle(last=True)
    assert len(packer.rows) - n < n / 50


def test_odd_rows(odd, odd_rows):
    got = online_packing.pack_online(odd, public_tokenizers.path(online_packing.RANKS)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    repeated = {r[0] for r in odd_rows if sum(x[0] == r[0] for x in odd_rows) > 1}
    for row in odd_rows:
        ids[row[0]] = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
    for doc in ids.keys() - repeated:
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc)
        assert [(s, n, zlib.crc32(np.asarray(ids[doc][s : s + n], "<u4").tobytes())) for s, n, _ in pieces] == pieces
        assert sum(n for _, n, _ in pieces) == len(ids[doc])
    for doc in repeated:
        times = sum(x[0] == doc for x in odd_rows)
        assert sum(r["length"] for r in got if r["doc_id"] == doc) == times * len(ids[doc])
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0


def test_nothing(nothing):
    assert online_packing.pack_online(nothing, public_tokenizers.path(online_packing.RANKS)).collect() == []


def test_query(spark, small):
    rows = [tuple(r) for r in online_packing.op13_online_packing(spark, small).collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    whole(rows, 1024, {d: [*e.ids, 0] for d, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))})
