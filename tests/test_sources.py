import io
import json
import os
import subprocess
import tarfile

import pytest
from pyspark.sql import functions as F

from folio.functions import auth, vectors
from folio.operators import lifecycle, rules
from folio.sources import config, git_snapshot, manifest, tables
from folio.streaming import ingest


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    files = {"docs/a.md": b"A\n", "docs/n/b.md": "계획\n".encode(), "docs/raw/x.md": b"x", "bin": b"\0\1" * 300, "docs/" + "l" * 120 + ".md": b"long"}
    for path, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(content)
    git("add", "-A")
    git("commit", "-qm", "one")
    return root, git("rev-parse", "HEAD").strip(), files


def test_snapshot(spark, repo):
    root, commit, files = repo
    git_snapshot.register(spark)
    rows = spark.read.format("git_snapshot").option("commit", commit).option("include", "docs/**/*.md").option("exclude", "docs/raw/**").load(root).collect()
    assert [(r.commit_sha, r.source_path, bytes(r.content)) for r in rows] == [(commit, p, files[p]) for p in sorted(files) if p.endswith(".md") and "raw" not in p]


def load(spark, root, commit, **options):
    return spark.read.format("git_snapshot").options(commit=commit, **options).load(root)


def test_parts_equal_the_archive(spark, repo):
    """Any number of partitions gives the files that the archive gives; a content of two paths is one object."""
    root, commit, files = repo
    git_snapshot.register(spark)
    rows = lambda df: sorted((r.source_path, bytes(r.content)) for r in df.collect())
    want = rows(load(spark, root, commit, mode="archive"))
    assert want == sorted(files.items())
    for size, parts in (("1", 5), ("600", 2), ("1000000", 1)):
        df = load(spark, root, commit, partBytes=size)
        assert df.rdd.getNumPartitions() == parts and rows(df) == want
    same = git_snapshot.dealt([git_snapshot.Entry(p, o, 9) for p, o in (("a", "1"), ("b", "2"), ("c", "1"))], 9)
    assert [[e.path for e in part] for part in same] == [["a", "c"], ["b"]]


def test_excluded_paths_are_never_read(spark, repo, monkeypatch):
    root, commit, files = repo
    asked = []
    monkeypatch.setattr(git_snapshot, "blobs", lambda repo, part: asked.extend(e.path for e in part) or iter(()))
    reader = git_snapshot._FilteringReader({"path": root, "commit": commit, "include": "docs/**", "exclude": "docs/raw/**", "partBytes": "1"})
    left = list(reader.pushFilters([git_snapshot.StringStartsWith(("source_path",), "docs/n"), git_snapshot.EqualTo(("commit_sha",), commit)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"]
    for part in reader.partitions():
        list(reader.read(part))
    assert asked == ["docs/n/b.md"]


def test_filters_reach_the_source(spark, repo):
    root, commit, files = repo
    git_snapshot.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, root, commit, partBytes="1", pushFilters="true")
        assert [r.source_path for r in df.where("source_path = 'bin'").collect()] == ["bin"]
        assert df.where("source_path LIKE 'docs/%'").count() == 4 and df.where("source_path IN ('bin', 'docs/a.md', 'no')").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("limits", [{"members": 2}, {"file_bytes": 3}, {"total_bytes": 8}])
def test_limits_of_the_tree(repo, limits):
    with pytest.raises(git_snapshot.SnapshotError):
        git_snapshot.chosen(repo[0], repo[1], lambda path: True, git_snapshot.Limits(**limits))
    bad = git_snapshot.Entry("bin", "0" * 40, 600)
    with pytest.raises(git_snapshot.SnapshotError):
        list(git_snapshot.blobs(repo[0], [bad]))


@pytest.mark.parametrize("limits", [{"members": 2}, {"file_bytes": 3}, {"total_bytes": 8}, {"archive_bytes": 2000}, {"pax_bytes": 10}])
def test_limits(repo, limits):
    with pytest.raises(git_snapshot.SnapshotError):
        git_snapshot.snapshot(repo[0], repo[1], ["**"], [], git_snapshot.Limits(**limits))


def test_untrusted_state(repo):
    root, commit, _ = repo
    for bad in ("HEAD", commit[:39], "0" * 40):
        with pytest.raises(git_snapshot.SnapshotError):
            git_snapshot.snapshot(root, bad, ["**"], [])
    with open(f"{root}/new", "w") as f:
        f.write("x")
    try:
        with pytest.raises(git_snapshot.SnapshotError):
            git_snapshot.snapshot(root, commit, ["**"], [])
    finally:
        os.remove(f"{root}/new")


def tar(*entries, **more):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=more.get("format", tarfile.PAX_FORMAT)) as t:
        for name, kind, content in entries:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(content)
            info.linkname = "x" if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE) else ""
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_hostile_archives():
    def read(raw):
        for _, folder, size, source in git_snapshot.members(io.BytesIO(raw)):
            source.exactly(0 if folder else size)
            source.exactly(0 if folder else -size % 512)

    f = tarfile.REGTYPE
    read(tar(("a", f, b"x"), ("d", tarfile.DIRTYPE, b""), ("é" * 90, f, b"y")))
    good = tar(("a", f, b"x"))
    bad = [
        tar(("../a", f, b"x")), tar(("/a", f, b"x")), tar(("a//b", f, b"x")), tar(("a", f, b"x"), ("a", f, b"y")), tar(("l", tarfile.SYMTYPE, b"")), tar(("l", tarfile.FIFOTYPE, b"")),
        tar(("n" * 200, f, b"x"), format=tarfile.GNU_FORMAT), good[:600], good[:100] + b"7" + good[101:], good + b"x", good[:1024],
    ]
    for raw in bad:
        with pytest.raises((git_snapshot.SnapshotError, UnicodeError)):
            read(raw)


def test_profiles_and_settings(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"source_key": "s", "include_patterns": ["a/**"], "exclude_patterns": []}))
    assert config.load_profile(str(path)).include_patterns == ("a/**",)
    for bad in ({"source_key": "s"}, {"source_key": "s", "include_patterns": "a", "exclude_patterns": []}, {"source_key": " ", "include_patterns": ["a"], "exclude_patterns": []}, {"source_key": "s", "include_patterns": ["../a"], "exclude_patterns": []}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load_profile(str(path))
    assert config.load_settings({"FOLIO_RRF_K": "10", "OTHER": "x"}).rrf_k == 10
    for bad in ({"FOLIO_X": "1"}, {"FOLIO_RRF_K": "0"}, {"FOLIO_RESULT_LIMIT": "21"}, {"FOLIO_QUERY_INSTRUCTION": "none"}):
        with pytest.raises(ValueError):
            config.load_settings(bad)


def test_manifests(spark, tmp_path):
    root = tmp_path / "model"
    (root / "sub").mkdir(parents=True)
    (root / "a.bin").write_bytes(b"abc")
    (root / "sub" / "b.json").write_bytes(b"{}")
    made = manifest.manifest(spark, str(root), "m", "r")
    assert [f["path"] for f in made["files"]] == ["a.bin", "sub/b.json"] and len(made["manifest_sha256"]) == 64
    assert manifest.differences(spark, str(root), made).count() == 0
    (root / "a.bin").write_bytes(b"abd")
    (root / "c").write_bytes(b"")
    assert {(r.path, r.state) for r in manifest.differences(spark, str(root), made).collect()} == {("a.bin", "changed"), ("c", "extra")}
    for bad in ("á", "a​", "a/../b", ""):
        with pytest.raises(ValueError):
            manifest.manifest_path(bad)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.publish(spark, root, "1")
    for version in ("1", "2"):
        tables.write_version(spark.range(int(version)), root, version)
        tables.publish(spark, root, version)
        assert tables.current(spark, root) == version and tables.read_current(spark, root).count() == int(version)


def test_stream_stores_each_content_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for texts in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "content string").write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema("content string").parquet(source), target, state).awaitTermination()
    rows = spark.read.parquet(target)
    assert sorted(r.content for r in rows.collect()) == ["a", "b", "c"]


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    ingest.arrivals(stream, "ts").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("arrivals").agg(F.sum("count")).first()[0] == events.count()


def test_auth(spark):
    secret = "s" * 43
    import hashlib
    import hmac

    clients = spark.createDataFrame(
        [("c1", "k" * 16, hashlib.sha256(secret.encode()).digest(), "active", None), ("c2", "d" * 16, hashlib.sha256(secret.encode()).digest(), "disabled", None)],
        "client_id string, key_id string, token_hash binary, status string, expires_at timestamp",
    )
    requests = spark.createDataFrame([(1, f"x_{'k' * 16}.{secret}"), (2, f"x_{'d' * 16}.{secret}"), (3, f"x_{'k' * 16}.{'t' * 43}"), (4, "bad"), (5, None)], "request_id int, token string")
    assert {r.request_id: r.client_id for r in auth.authenticated(requests, clients, "2024-01-01").collect()} == {1: "c1", 2: None, 3: None, 4: None, 5: None}
    got = auth.with_hmac(requests, "token", b"key").collect()
    assert bytes(got[3].query_hmac) == hmac.digest(b"key", b"bad", "sha256") and got[4].query_hmac is None


def test_rules_and_lifecycle(spark):
    rows = spark.createDataFrame([("1", -1, 1, 1), ("2", 0, 2, 1), ("3", 0, 1, 2), ("3", 7, 1, 2)], "id string, ordinal int, line_start int, line_end int").selectExpr("*", "ordinal AS level", "'p' AS parse_id")
    got = sorted((r.rule, r.key) for r in rules.table_violations("sections", rows).collect())
    assert got == [("level", "1"), ("level", "3"), ("lines", "2"), ("ordinal", "1"), ("unique_id", "3"), ("unique_parse_id_ordinal", "p|0")]
    runs = spark.createDataFrame([("s", "1", "previous"), ("s", "2", "active"), ("s", "3", "ready"), ("t", "4", "active")], "source_key string, run_id string, status string")
    ready = spark.createDataFrame([("s", "3"), ("t", "4")], "source_key string, run_id string")
    after = {r.run_id: (r.status, r.prunable) for r in lifecycle.activated(runs, ready).collect()}
    assert after == {"1": ("ready", True), "2": ("previous", False), "3": ("active", False), "4": ("active", False)}
    assert {r.run_id: (r.status, r.possible) for r in lifecycle.rolled_back(runs).collect()} == {"1": ("active", True), "2": ("previous", True), "3": ("ready", True), "4": ("active", False)}
    bad = spark.createDataFrame([([1.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([2.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in bad.select(vectors.vector_error(F.col("v"), 2)).collect()] == [None, "dimension", "not finite", "norm", "missing"]
