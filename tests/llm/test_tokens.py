import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from folio.llm import byte_bpe, token_counts
from folio.llm.common import steps, utf8

PATH = public_tokenizers.path(byte_bpe.MODEL)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(library):
    pick = random.Random(1)
    letters = list("  \n\t'sdtrevml aZ1é½!_-  \x85字あ😀́\x1c²")
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * 3000, "!" * 2000 + " " * 5000, " \n" * 700, "I'll've don't'Re 's x", "", "'", "'l", "x'll"]
    data, offsets = utf8(pa.array(texts))
    model = byte_bpe.merges(PATH)
    ids, at = model.encode(data, offsets)
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text), text
    decoded, token_at = model.decode(ids)
    assert decoded == "".join(texts).encode()
    assert token_at[-1] == len(decoded)


def test_a_cache_that_starts_anew_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    model = byte_bpe.Merges(byte_bpe.merges(PATH).ranks)
    for text in ("one two three four five", "two three six seven eight nine"):
        data, offsets = utf8(pa.array([text]))
        assert model.encode(data, offsets)[0].tolist() == library.encode_ordinary(text)


def test_bpe_rows(odd, odd_rows, nothing, library):
    want = []
    for row in odd_rows:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in byte_bpe.digests(odd, PATH).collect()))) == sorted(map(repr, want))
    assert byte_bpe.digests(nothing, PATH).count() == 0
    full = byte_bpe.encoded(odd, PATH).collect()
    assert len(full) == len(odd_rows) and all(len(r.ids) == len(r.starts) for r in full)


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 50)
    pick, model = random.Random(7), byte_bpe.merges(PATH)
    for _ in range(100):
        text = "".join(pick.choice(["a", "b", " ", " ", "\n", "'s", "'", "é", "\u3000", "12", "!", " x"]) for _ in range(400))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert b"".join(p.tobytes() for p in byte_bpe.parts(raw, 50)) == raw.tobytes()
        ids = library.encode_ordinary(text)
        expected = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw.tobytes()).hexdigest()
        assert byte_bpe.digest(model, raw) == expected
    assert len(list(byte_bpe.parts(np.frombuffer(b"ab cd " * 100, np.uint8), 50))) > 5


def test_counts(odd, odd_rows, nothing):
    path = public_tokenizers.path(token_counts.MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in odd_rows]
    assert sorted(map(repr, (tuple(r) for r in token_counts.count_tokens(odd, path).collect()))) == sorted(map(repr, want))
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_cuts_keep_counts():
    model, may_cut = token_counts.loaded(public_tokenizers.path(token_counts.MODEL))
    assert may_cut
    pick = random.Random(2)
    for _ in range(300):
        text = "".join(pick.choice(["ab", "c ", " ", "\n", " d", "é", "▁", ".", "字", "\u00a0", "😀 x"]) for _ in range(200))
        raw = text.encode()
        assert token_counts.counts(model, True, [raw], 10)[0] == len(model.encode(text)), text
        assert b"".join(token_counts.cuts(raw, 10)).replace(b" ", b"") == raw.replace(b" ", b"")


def test_a_model_of_another_kind_is_not_cut(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as described

    with open(public_tokenizers.path(token_counts.MODEL), "rb") as file:
        raw = file.read()

    def changed(change):
        model = described.ModelProto()
        model.ParseFromString(raw)
        change(model)
        at = tmp_path / "m.model"
        at.write_bytes(model.SerializeToString())
        return token_counts.may_cut(str(at))

    assert changed(lambda m: None)
    assert not changed(lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True))
    assert not changed(lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"))
    assert not changed(lambda m: setattr(m.trainer_spec, "model_type", 1))
    assert not changed(lambda m: setattr(m.pieces[100], "piece", "a▁b"))


def test_steps_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101, 400])
    assert list(steps(offsets, 50)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(steps(np.array([0]))) == []
