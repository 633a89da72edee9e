"""Token counts of a piece model.

Method: Arrow batches of texts go to the library's batch encoding in slices balanced by bytes, and only lengths return.
A text longer than a slice is cut at safe boundaries: a single space between two characters that aren't white space.

Why these are safe: the model file says how texts are normalised and what its pieces are. If it maps no characters, keeps
white space as it is, puts a mark before a text, merges pieces pairwise (BPE) and has no piece with a space mark after
another character, then no merge can cross such a space, whatever stands on its sides; and the mark that the library puts
before the next part stands for the space that the cut took away. ``may_cut`` reads just these conditions from the file;
where one doesn't hold, texts aren't cut.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted each, alike; very long texts
are encoded in slices; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import documents, lean, python_ready, steps, text_rows, utf8

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SLICE_BYTES = 1 << 18
MARK = "▁"


def may_cut(path: str) -> bool:
    """Whether the model's own description makes single spaces safe boundaries."""
    from sentencepiece import sentencepiece_model_pb2 as described

    model = described.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rule, trained = model.normalizer_spec, model.trainer_spec
    as_is = not rule.precompiled_charsmap and not rule.normalization_rule_tsv and not rule.remove_extra_whitespaces and rule.escape_whitespaces
    marked = rule.add_dummy_prefix and not trained.treat_whitespace_as_suffix
    pairwise = trained.model_type == described.TrainerSpec.BPE
    return as_is and marked and pairwise and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)


@lru_cache(4)
def loaded(path: str):
    """The processor, and whether texts may be cut at single spaces."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path), may_cut(path)


def cuts(text: bytes, most: int) -> list[bytes]:
    """Parts of at least ``most`` bytes, cut at safe boundaries. Their counts add up to the text's."""
    parts, lo, at = [], 0, most
    mark = MARK.encode()
    while (at := text.find(b" ", at)) > 0:
        before, after = text[max(0, at - 4) : at].decode(errors="ignore")[-1:], text[at + 1 : at + 5].decode(errors="ignore")[:1]
        if before and after and not before.isspace() and not after.isspace() and MARK not in (before, after):
            parts.append(text[lo:at])
            lo = at + 1
            at = lo + most
        else:
            at += 1
    return [*parts, text[lo:]]


def counts(model, cut: bool, texts: list[bytes], most: int = SLICE_BYTES) -> np.ndarray:
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = cuts(text, most) if cut and len(text) > 2 * most else [text]
        parts += own
        owner += [i] * len(own)
    out = np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(parts):  # slices of some most bytes: no encoded batch is larger than a part or a slice
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= most):
            size += len(parts[hi])
            hi += 1
        got = [len(x) for x in model.encode([p.decode() for p in parts[lo:hi]], num_threads=1)]
        np.add.at(out, np.asarray(owner[lo:hi]), np.asarray(got, np.int64))
        lo = hi
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cut = loaded(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = np.zeros(len(batch), np.int64)
            for lo, hi in steps(offsets):
                ends = offsets[lo : hi + 1].tolist()
                n[lo:hi] = counts(model, cut, [data[a:b].tobytes() for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    python_ready(docs.sparkSession)
    return text_rows(docs).mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(MODEL))
