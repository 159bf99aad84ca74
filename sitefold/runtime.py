"""Session-level helpers: cutting lineage, and joining tables whose size has been checked."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers (elements of arrays counted one by one) up to which a per-site table may be broadcast.
BROADCAST_CELLS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a fresh local one where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            current = tempfile.mkdtemp(prefix="sitefold-")
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder: later stages start from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cells(df: DataFrame) -> int:
    """How many numbers a table holds."""
    each = F.lit(0)
    for name, kind in df.dtypes:
        each = each + (F.greatest(F.size(name), F.lit(1)) if kind.startswith(("array", "map")) else F.lit(1))
    return df.agg(F.sum(each)).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", ready: bool = False) -> DataFrame:
    """Join a per-group table back to its rows.

    `small` is written out first so its size is a fact rather than an estimate (`ready` says it is
    already a projection of a written table). Below
    BROADCAST_CELLS it is broadcast and `big` never moves; above, the join shuffles and adaptive
    skew handling splits the hot keys.
    """
    small = small if ready else cut(small)
    if cells(small) <= BROADCAST_CELLS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def scalar_row(one_row: DataFrame) -> Column:
    """All columns of a one-row aggregate as one struct-valued scalar subquery."""
    return one_row.select(F.struct(*one_row.columns).alias("r")).scalar()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started from."""
    import shutil

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="sitefold-src-"), "sitefold")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "sitefold"))
        _shipped.add(app)
