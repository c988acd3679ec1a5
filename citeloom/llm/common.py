"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import discard, settle, shared_dir, ship, spread, written

__all__ = ["CACHES", "arrow_column", "arrow_map", "binary_of", "discard", "frugal", "settle", "shared_dir", "ship", "spread", "texts_of", "written"]


# Words are maximal runs of other bytes than space and \t to \r: what bytes.split() gives.


def binary_of(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


#: Caches of words that worker processes keep while a task lasts; whoever adds one empties it between tasks.
CACHES: list[dict] = []


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over the batches of a task; what the worker held for it goes back to the system when the task ends.
    Workers outlive their tasks, and several of them share an executor's memory with its JVM."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            for cache in CACHES:
                cache.clear()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # a C library without it

    return run


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(frugal(f), schema)


def arrow_column(df: DataFrame, f: Callable[..., pa.Array], kind: str, *columns: Column) -> Column:
    """A column of df that f computes batch by batch from arrays of the given columns; all others stay in the JVM."""
    ship(df.sparkSession)
    if len(columns) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from frugal(lambda xs: (f(x) for x in xs))(batches)

        return F.arrow_udf(one, kind)(*columns)

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from frugal(lambda xs: (f(*x) for x in xs))(batches)

    return F.arrow_udf(many, kind)(*columns)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a column that is missing becomes null, others are left out."""
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names))
