import zlib

from folio.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op2_quality(spark, sf).collect()
    assert len(rows) == 10_000
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(p == q for p, q in held) / len(held) > 0.97
    good = [p for p, q in held if q == 1]
    assert sum(good) / len(good) > 0.99


def test_odd_rows(spark, odd, nothing, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, labels)
    assert quality.score(odd, model).count() == odd.count()
    assert quality.score(nothing, model).count() == 0
    assert {r.score for r in quality.judged(odd, labels.limit(0)).collect()} == {0.5}
    both = labels.select("doc_id", "quality").unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"))
    assert quality.judged(odd, both).count() == odd.count()
    kept = quality.kept(odd, labels)
    assert kept.columns == odd.columns


def test_stage_keeps_what_scores_at_least_half(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.op2_quality(spark, small).collect()}
    assert {r.doc_id for r in quality.stage(spark, docs, small).collect()} == {i for i, p in scores.items() if p}


def test_scores_equal_a_plain_loop(spark, odd, small):
    """The model that was fitted, applied text by text with zstandard's own calls and plain arithmetic."""
    import math

    import zstandard

    labels, docs = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/documents.parquet")
    good, bad, w = model = quality.fit(docs, labels)
    make = lambda **held: zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **held)
    with_ = [make(dict_data=zstandard.ZstdCompressionDict(x)) for x in (good, bad)] + [make()]
    rows = [(i, r.text) for i, r in enumerate([*docs.collect(), *odd.collect()])]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        a, b, c = (sum(len(z.compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096)) for z in with_)
        short = (1 + len(raw) / 64) ** -0.5
        d, e, f, g = (b - a) / max(1, a + b), (b - a) / max(1, len(raw)), (c - a) / max(1, c), (c - b) / max(1, c)
        m = sum(x * y for x, y in zip(w.tolist(), (1, d, e, f, g, d * short, f * short)))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, m))))) < 1e-9


def test_texts_of_any_length_are_learnt_from(spark):
    """Labelled texts that are all very long: blocks from all over them build the dictionaries."""
    import random

    pick = random.Random(2)
    words = {q: ["".join(pick.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)] for q in (0, 1)}
    texts = [(i, " ".join(pick.choices(words[i % 2], k=9_000)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert min(len(t) for _, t, _ in texts) > 50_000
    assert all(r.predicted == i % 2 for i, r in got.items())


def test_what_dictionaries_are_trained_on_is_bounded(spark, monkeypatch):
    """Labelled texts of many blocks: about ``BLOCKS`` of each kind are collected, from all over the texts."""
    import random

    monkeypatch.setattr(quality, "BLOCKS", 120)
    taken = []
    plain = quality.dictionary
    monkeypatch.setattr(quality, "dictionary", lambda samples: taken.append(len(samples)) or plain(samples))
    pick = random.Random(8)
    words = {q: ["".join(pick.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)] for q in (0, 1)}
    texts = [(i, " ".join(pick.choices(words[i % 2], k=30_000)), i % 2) for i in range(48)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts] + [(0, 0), (1, 0)], "doc_id bigint, quality int")  # one id twice, one with both
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == 48 and sum(r.predicted == r.doc_id % 2 for r in rows) >= 46
    assert len(taken) == 2 and all(60 < n < 240 for n in taken)
    text = memoryview(texts[0][1].encode())
    assert b"".join(quality.blocks(text, 0, 1.0)) == bytes(text)
    some = [quality.blocks(text, key, 0.2) for key in range(60)]
    assert 0.15 < sum(map(len, some)) / 60 / len(quality.blocks(text, 0, 1.0)) < 0.25
    assert any(b and bytes(text).endswith(b[-1]) for b in some)


def test_calibration_is_the_least_loss():
    """Newton's result against a plain descent on the same loss."""
    import numpy as np

    made = np.random.default_rng(3)
    x = np.column_stack([np.ones(300), made.normal(size=(300, 2)) * (3, 0.1) + (5, 1)])
    y = (made.random(300) < 1 / (1 + np.exp(-(x[:, 1] - 5) * 1.5))).astype(float)
    of = np.where(y == 1, 2.0, 0.5)
    w = quality.calibrated(x, y, of)
    middle, spread = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(300), (x[:, 1:] - middle[1:]) / spread[1:]])
    v = np.zeros(3)
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-z @ v))
        v -= 0.01 / 3 * (z.T @ (of * (p - y)) + np.array([1e-6, 0.1, 0.1]) * v) / 10
    assert np.allclose(x @ w, z @ v, atol=1e-3)
