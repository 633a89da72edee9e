"""Manifests of model snapshots: every file's path, size and digest, and one digest of them all."""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.identity import config_hash
from folio.functions.paths import canonical

FILES, FILE_BYTES, TOTAL_BYTES = 256, 4 << 30, 8 << 30
EMPTY = hashlib.sha256(b"").hexdigest()


def manifest_path(path: str) -> str:
    """The path if a manifest may name it: canonical, NFC, without control or format characters."""
    if canonical(path) != path or unicodedata.normalize("NFC", path) != path or any(unicodedata.category(c) in ("Cc", "Cf") for c in path):
        raise ValueError("a manifest can't name this path")
    return path


def _sizes(spark: SparkSession, root: str) -> dict[str, int]:
    """The size of each file; a folder of more files than a manifest may hold is refused."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base, listed, n, out = at.toUri().getPath().rstrip("/") + "/", at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), 0, {}
    while listed.hasNext():
        status, n = listed.next(), n + 1
        if n > FILES:
            raise ValueError("too many files")
        out[status.getPath().toUri().getPath().removeprefix(base)] = status.getLen()
    return out


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every file below ``root``; each is hashed where it is read."""
    empty = [(p, 0, EMPTY) for p, size in _sizes(spark, root).items() if not size]  # Spark's readers pass over these
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    found = files.select(F.substr(path, F.lit(len(base) + 1)).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return found.unionByName(spark.createDataFrame(empty, "path string, size bigint, sha256 string"))


def manifest(spark: SparkSession, root: str, model: str, revision: str) -> dict:
    """A snapshot's manifest with its identity; the bounds on files keep what the driver reads small."""
    found = file_digests(spark, root)
    n, size, largest = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not 0 < n <= FILES or size > TOTAL_BYTES or largest > FILE_BYTES:
        raise ValueError("a snapshot has 1 to 256 files of at most 4 GiB, 8 GiB in all")
    files = [{"path": manifest_path(r.path), "size": r["size"], "sha256": r.sha256} for r in found.orderBy("path").collect()]
    if len({f["path"].casefold() for f in files}) != len(files):
        raise ValueError("paths differ in case only")
    body = {"model": model, "revision": revision, "files": files}
    return body | {"manifest_sha256": config_hash(body)}


def differences(spark: SparkSession, root: str, expected: dict) -> DataFrame:
    """(path, state) of files that are missing, extra or changed against a manifest."""
    want = spark.createDataFrame([(f["path"], f["size"], f["sha256"]) for f in expected["files"]], "path string, want_size bigint, want_sha string")
    both = file_digests(spark, root).join(want, "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want_sha").isNull(), "extra").when((F.col("sha256") != F.col("want_sha")) | (F.col("size") != F.col("want_size")), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def is_ready(spark: SparkSession, root: str, expected: dict) -> bool:
    """Whether a snapshot can be loaded: the manifest has its own digest, and the files have its paths and sizes.

    Nothing is loaded and no file is read; ``differences`` compares contents.
    """
    body = {key: value for key, value in expected.items() if key != "manifest_sha256"}
    if config_hash(body) != expected.get("manifest_sha256"):
        return False
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return there and _sizes(spark, root) == {f["path"]: f["size"] for f in expected["files"]}
