"""Versioned parquet tables with one published pointer.

A table's new version is written beside the old; ``publish`` then renames a small pointer into place, which is atomic
where the file system's rename is. Readers follow the pointer, so they see the old version or the new, never a mixture.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_version(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> None:
    if not re.fullmatch(r"[A-Za-z0-9-]+", version):
        raise ValueError("a version is letters, digits and hyphens")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{root}/v-{version}")


def publish(spark: SparkSession, root: str, version: str) -> None:
    files, at = _files(spark, f"{root}/v-{version}")
    if not files.exists(at):
        raise ValueError("there is no such version")
    _, new = _files(spark, f"{root}/{POINTER}.{version}")
    _, now = _files(spark, f"{root}/{POINTER}")
    out = files.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, now, options)


def current(spark: SparkSession, root: str) -> str | None:
    files, at = _files(spark, f"{root}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readNBytes(64)).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise ValueError("nothing is published")
    return spark.read.parquet(f"{root}/v-{version}")
