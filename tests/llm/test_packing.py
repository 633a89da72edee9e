import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folio.llm import packing

PATH = public_tokenizers.path(packing.RANKS)


def test_plans_use_each_piece_once_and_nearly_fill_sequences():
    for seed in range(3):
        lengths = np.random.default_rng(seed).integers(1, 1025, 20_000) if seed else np.full(1000, 342)
        histogram = np.bincount(lengths, minlength=1025)
        runs = packing.plan(histogram, 1024)
        used = np.zeros(1025, int)
        for own, n in runs:
            assert sum(own) <= 1024 and n > 0
            np.add.at(used, list(own), n)
        assert (used == histogram).all()
        assert sum(n for _, n in runs) <= 1.02 * -(-lengths.sum() // 1024) + 2 or not seed
    assert packing.plan(np.zeros(1025, int), 1024) == []


def test_no_plan_is_beaten_by_best_fit_alone():
    for seed, lengths in enumerate([np.random.default_rng(1).integers(1, 1025, 20_000), np.random.default_rng(2).integers(200, 700, 5_000), np.random.default_rng(3).integers(1, 60, 3_000)]):
        histogram = np.bincount(lengths, minlength=1025)
        size = lambda runs: sum(n for _, n in runs)
        bins: list[int] = []
        import bisect

        for length in sorted(lengths.tolist(), reverse=True):  # piece by piece
            at = bisect.bisect_left(bins, length)
            gap = bins.pop(at) if at < len(bins) else 1024
            bisect.insort(bins, gap - length)
        assert size(packing.plan(histogram, 1024)) <= len(bins), seed


def test_short_lengths_held_back_fill_gaps_exactly_and_cost_no_sequences():
    """Plans by sums use each piece once, use pairs and triples, and lose at most one sequence of few to best fit alone."""
    size = lambda runs: sum(n for _, n in runs)
    for seed in range(4):
        make = np.random.default_rng(seed)
        kinds = {
            "uniform": make.integers(1, 1025, 20_000),
            "a third full": np.concatenate([np.full(6_000, 1024), make.integers(1, 1025, 14_000)]),
            "few": make.integers(1, 1025, 500),
            "lognormal": np.clip(make.lognormal(5.5, 0.9, 50_000).astype(int), 1, 1024),
        }
        for name, lengths in kinds.items():
            histogram = np.bincount(lengths, minlength=1025)
            plans = [packing.held_back(histogram, 1024, 1024 // part) for part in packing.HELD_BACK]
            for runs in plans:
                used = np.zeros(1025, int)
                for own, n in runs:
                    assert sum(own) <= 1024 and n > 0
                    np.add.at(used, list(own), n)
                assert (used == histogram).all(), name
            alone = size(packing.complemented(histogram, 1024, 0))
            assert min(map(size, plans)) <= alone + (len(lengths) < 1_000), (seed, name, [*map(size, plans)], alone)
            assert sum(n for own, n in plans[0] if sum(own) == 1024 and sum(x < 128 for x in own) > 1) > 0, name
    for most in (1, 2, 5):
        histogram = np.full(most + 1, 3)
        histogram[0] = 0
        assert sum(sum(own) * n for own, n in packing.held_back(histogram, most, 1)) == 3 * most * (most + 1) // 2


def test_the_vocabulary_is_that_of_the_json_file():
    assert packing.vocabulary_agrees(public_tokenizers.path("byte_bpe_50k.json"), PATH)


def checked(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, space = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        space[r.sequence_id].append((r.offset, r.length))
    for own in space.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    assert sum(map(len, pieces.values())) == sum(-(-len(i) // 1024) for all_ids in want.values() for i in all_ids)
    for doc_id, all_ids in want.items():
        crcs = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc_id])
        expected = []
        for ids in all_ids:
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                expected.append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        assert crcs == sorted(expected)


def test_rows_equal_the_tokenizer(odd, odd_rows, nothing):
    checked(packing.pack(odd, PATH).collect(), [r[:2] for r in odd_rows])
    assert packing.pack(nothing, PATH).count() == 0


def test_small_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = packing.op4_packing(spark, small).collect()
    checked(rows, docs)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-total // 1024) + 1
