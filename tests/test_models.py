import os
import time
from collections import Counter

import pytest

from folio.functions import models, vectors
from folio.sources import manifest


def test_a_worker_loads_a_model_once(spark, tmp_path):
    log, busy, lane = str(tmp_path / "loads"), str(tmp_path / "busy"), str(tmp_path / "lane")

    def make():
        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        own = vectors.hash_embedder(8)

        def embed(texts):
            os.close(os.open(busy, os.O_CREAT | os.O_EXCL))  # fails where another process embeds
            time.sleep(0.005)
            os.remove(busy)
            return own(texts)

        return embed

    rows = spark.range(64).selectExpr("id", "concat('word ', id) AS text").repartition(16)
    identity = f"model-{tmp_path}"
    for _ in range(2):
        got = vectors.embedded(rows, "id", "text", make, batch=4, identity=identity, lane=lane).collect()
        want = vectors.embedded(rows, "id", "text", lambda: vectors.hash_embedder(8)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 64
    loads = Counter(open(log).read().split())
    assert 0 < len(loads) < 32 and set(loads.values()) == {1}


def test_a_failed_load_is_told_until_it_may_be_tried_again():
    tries = []

    def load():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("not there")
        return "model"

    with pytest.raises(OSError):
        models.loaded("failing", load, retry=0.2)
    with pytest.raises(RuntimeError, match="not there"):
        models.loaded("failing", load, retry=0.2)
    assert len(tries) == 1
    time.sleep(0.25)
    assert models.loaded("failing", load) == models.loaded("failing", load) == "model" and len(tries) == 2
    models.forget("failing")
    assert models.loaded("failing", load) == "model" and len(tries) == 3


def test_readiness_compares_files_without_reading_them(spark, tmp_path):
    root = tmp_path / "snapshot"
    (root / "sub").mkdir(parents=True)
    (root / "a.bin").write_bytes(b"abc")
    (root / "sub" / "empty").write_bytes(b"")
    made = manifest.manifest(spark, str(root), "m", "r")
    assert manifest.is_ready(spark, str(root), made)
    assert not manifest.is_ready(spark, str(root), made | {"revision": "s"})
    assert not manifest.is_ready(spark, str(tmp_path / "none"), made)
    (root / "a.bin").write_bytes(b"abcd")
    assert not manifest.is_ready(spark, str(root), made)
    (root / "a.bin").unlink()
    assert not manifest.is_ready(spark, str(root), made)
