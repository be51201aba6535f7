"""Helpers that the training-data operators share: stable storage, byte views of texts, bounded samples."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a session in one process, as in tests, may name none: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corbel-"))
    return sc.getCheckpointDir()


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/corbel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what ``stable`` has written inside, but for what went through the function that it yields: results, written while their
    inputs are still there."""
    outer, made, kept = _MADE.get(), [], []
    token = _MADE.set(made)

    def keep(df: DataFrame) -> DataFrame:
        out = stable(df)
        kept.append(made.pop())
        return out

    try:
        yield keep
    finally:
        _MADE.reset(token)
        if outer is not None:
            outer += kept
        fs = spark._jvm.org.apache.hadoop.fs
        for path in made:
            p = fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(columns: list[str], base: str) -> str:
    """A column name that is not among ``columns``."""
    return next(n for n in (base, *(f"{base}{k}" for k in range(len(columns) + 1))) if n not in columns)


def without(rows: DataFrame, name: Column, bad: DataFrame, most: int = 200_000) -> DataFrame:
    """``rows`` but for those whose ``name`` is in the stable, one-column ``bad``: sent to all tasks up to ``most`` names, else shuffled. No name in ``bad`` is null."""
    column = free_name(rows.columns, "_bad")
    bad = bad.select(F.col(bad.columns[0]).alias(column)).distinct()
    return rows.join(F.broadcast(bad) if bad.count() <= most else bad, name == F.col(column), "left_anti")


def give_back() -> None:
    """Hands freed memory back to the system. Python workers live on between tasks, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with freed memory handed back at its end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, so that array work over a batch stays small."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            held += size
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts go to Python in batches of 8 MB at most, unless the session's own settings name a size."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
