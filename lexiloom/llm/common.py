"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.shared import cleared, shared_dir
from lexiloom.sources.shared import staged as stage

__all__ = ["BROADCAST_ROWS", "by_size", "cleared", "few", "fresh", "plain_columns", "read_table", "release_memory", "row_key", "shared_dir", "stage"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> F.Column:
    """128 bits that tell rows apart by ``columns``; nulls differ from all values."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


#: Up to so many rows of a few numbers are broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """``df``, broadcast where it is joined if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release_memory() -> None:
    """Give what this worker no longer uses back to the system; idle workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def by_size(batches: Iterable[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices that have less than ``most`` bytes in column ``name`` after their first row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
