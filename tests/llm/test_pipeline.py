import pytest

import corpus_pipeline
from folio.llm import exact_dedup, near_dup, packing, pii, quality
from folio.llm.common import written
from tests.llm.test_dedup import exact_brute, near_brute
from tests.llm.test_packing import checked


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dup", "pii", "packing"]
    one = written(quality.stage(spark, docs, small), "t1")
    good = {r.doc_id for r in quality.op2_quality(spark, small).where("predicted = 1").collect()}
    assert {r.doc_id for r in one.collect()} == good
    two = written(exact_dedup.stage(spark, one, small), "t2")
    kept = {eval(r)[0] for r in exact_brute([(r.doc_id, r.text) for r in one.collect()]) if eval(r)[3]}
    assert {r.doc_id for r in two.collect()} == kept
    three = written(near_dup.stage(spark, two, small), "t3")
    lead = {eval(r)[0] for r in near_brute([(r.doc_id, r.text) for r in two.collect()]) if eval(r)[0] == eval(r)[2]}
    assert {r.doc_id for r in three.collect()} == lead
    four = written(pii.stage(spark, three, small), "t4")
    before = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        assert r.text == pii.redact(before[r.doc_id] or "", pii.spans_of(before[r.doc_id] or "")[1])
    for table in (one, two, three, four):
        assert table.columns == columns
    checked(packing.stage(spark, four, small).collect(), [(r.doc_id, r.text) for r in four.collect()])
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == lead


def test_empty_and_odd_tables(spark, odd, nothing, small):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), f"nothing-{name}")
        assert docs.count() == 0
    docs, tables = odd, [odd]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), f"odd-{name}")
        tables.append(docs)
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    good = {(r.doc_id, r.predicted) for r in quality.judged(odd, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert sorted(map(repr, rows[1])) == sorted(repr(r) for r in rows[0] if (r[0], 1) in good)
    assert sorted(repr(i) for i, _ in rows[2]) == sorted(repr(eval(r)[0]) for r in exact_brute(rows[1]) if eval(r)[3])
    assert sorted(repr(i) for i, _ in rows[3]) == sorted(repr(eval(r)[0]) for r in near_brute(rows[2]) if eval(r)[0] is None or eval(r)[0] == eval(r)[2])
    assert sorted(map(repr, rows[4])) == sorted(repr((i, pii.redact(t, pii.spans_of(t)[1]) if t else t)) for i, t in rows[3])
    checked(tables[-1].collect(), rows[4])


def test_queries_side_by_side_in_one_session(spark, small):
    """Operators that write tables, run by two threads at once, give what single runs give and leave each other's tables."""
    import threading

    from folio.llm import exact_dedup, near_dup, packing
    from folio.llm.common import scratch

    docs = spark.read.parquet(f"{small}/documents.parquet")
    runs = {
        "near": lambda: near_dup.op10_near_dup(spark, small), "near-2": lambda: near_dup.op10_near_dup(spark, small), "exact": lambda: exact_dedup.op9_exact_dedup(spark, small),
        "packing": lambda: packing.pack(docs, __import__("public_tokenizers").path(packing.RANKS)).select("doc_id", "piece", "start", "length", "ids_crc32"), "pipeline": lambda: corpus_pipeline.run(spark, small),
    }
    rows = lambda df: sorted(map(repr, df.select(*(c for c in df.columns if c not in ("sequence_id", "offset"))).collect()))
    alone, told = {name: rows(make()) for name, make in runs.items() if name != "near-2"}, {}
    alone["near-2"] = alone["near"]

    def run(names):
        for name in names:
            try:
                with scratch(spark):
                    told[name] = rows(runs[name]())
            except Exception as error:  # noqa: BLE001
                told[name] = error

    threads = [threading.Thread(target=run, args=(some,)) for some in (("near", "exact", "pipeline"), ("near-2", "packing"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    for name in runs:
        assert told[name] == alone[name], name


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from folio.llm import common

    conf = SimpleNamespace(get=lambda name, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_folder(cluster)
    cluster.sparkContext.master = "local[4]"
    assert common.shared_folder(cluster) == common.UNSET_FOLDER
