"""What the operators of this subpackage share: Arrow views of text, byte-balanced slices, the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import repo_root

#: Bytes of text that one vectorised step handles; a longer text is handled alone.
STEP_BYTES = 1 << 19
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Where tables are written in sessions that name no shared folder, as in tests on one machine.
UNSET_FOLDER = "/tmp/folio-checkpoints"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text only (and ``more``), so that other columns can have any names."""
    return docs.select("doc_id", "text", *more)


def python_ready(spark: SparkSession) -> None:
    """Lets Python workers import this package also where only the driver's path has it."""
    env, root = spark.sparkContext.environment, repo_root()
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session; one of its own only on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
    return named or UNSET_FOLDER


#: Paths of written tables by scope, the innermost last. Each thread has its own, so that queries which run side by side in
#: one session never remove each other's tables.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def own_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else writes to; it is removed with the scope around the call."""
    at = f"{shared_folder(spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read again: lineage ends there and lost executors cost nothing."""
    at = own_path(df.sparkSession, name)
    df.write.parquet(at)
    table = df.sparkSession.read.schema(df.schema).parquet(at)
    table._folio_at = at
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end, but for those that were released."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for at in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(table: DataFrame) -> DataFrame:
    """``table``, which stays when the scope that wrote it ends: it passes to the scope around it, if there is one."""
    *outer, mine = _SCOPES.get()
    mine.remove(table._folio_at)
    if outer:
        outer[-1].append(table._folio_at)
    return table


def tidy() -> None:
    """Gives what Arrow and the C library hold in reserve back to the system: workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run):
    """``run`` over Arrow batches, tidied up after every batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            tidy()

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        tidy()

    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty. No copy without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def crc_mod(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the folds that the contracts fix."""
    return F.crc32(column.cast("string")) % F.lit(modulus)
