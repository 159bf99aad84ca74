"""Helpers shared by the operators: Arrow-batched row maps, stable hashes, written intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sitefold.runtime import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table below the shared checkpoint folder: later stages read the copy, whichever executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What the process has freed goes back to the system, where its allocators can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def lean(fn: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """`fn`, whose task leaves no freed memory behind: a Python worker lives on from task to task, beside an executor that needs the room."""

    @wraps(fn)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(*args)
        finally:
            give_back()

    return run


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Every row of `df` with the columns `fn` makes of its Arrow batch. A new column replaces one of the same name."""
    ship_package(df.sparkSession)
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in keep] + [f.name for f in fields]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b)
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [made[f.name] for f in fields], names=names)

    return df.mapInArrow(run, T.StructType(keep + fields))


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(33)
    x = x * MIX2
    return x ^ (x >> np.uint64(33))
