"""What the corpus operators share: tables, the shared folder, word rules."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.shared import kept_table, scratch

__all__ = ["ascii_lower", "fits_broadcast", "free_name", "kept_table", "release", "scratch", "small_batches", "table", "tidy", "words_of"]

#: Bytes that separate words: space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: A table with at most this many rows may be broadcast; the caller counts it first.
BROADCAST_ROWS = 100_000
#: Rows in an Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers live on through stages that need it elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *drop: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over Arrow batches that, at its task's end, calls ``drop`` and releases memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        for x in drop:
            x()
        release()

    return run


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows`` if the session allows more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the (already materialised) table has at most ``rows`` rows; reads no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores put before it until no column of the input has that name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(c: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+"), "")
