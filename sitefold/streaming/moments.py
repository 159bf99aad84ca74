"""Running moments of a stream, equal to the batch moments of everything seen so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitefold.operators import moments as mo


def running_moments(stream: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """The batch aggregate on a stream: covariance aggregates keep mergeable (n, mean, product)
    state per group, so each trigger adds its rows and late or reordered partitions do not matter."""
    return mo.moments(stream, cols, by)


def running_moment_arrays(stream: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",), array: str | None = None, width: int = 0) -> DataFrame:
    """(by, n, mean, m2) of columns of any width, sent again for every group that a trigger adds rows to; m2 is the whole matrix, row by row.

    Tasks reduce a trigger's rows to one triple per group, so rows never move. The state of a group is its triple, and triples merge by the pairwise
    update, whatever the order in which files and partitions arrive. Rows count if complete, as in the batch kernels."""
    by, names = list(by), [*by, "n", "mean", "m2"]
    width = width + len(cols)
    values = [F.col(c).cast("double") for c in cols]
    packed = F.concat(F.transform(F.col(array), lambda e: e.cast("double")), F.array(*values)) if array else F.array(*values)
    rows = mo.complete(stream, [*cols, *([array] if array else [])]).select(*by, packed.alias("_v")).where(~F.exists("_v", lambda e: e.isNull()))
    keys = "".join(f"`{c}` {stream.schema[c].dataType.simpleString()}, " for c in by)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, key = mo.group_codes(b, by)
            v = b.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if b.num_rows and v.shape[1] != width:
                raise ValueError(f"{v.shape[1]} numbers in a row, not {width}")
            for k in range(codes.max() + 1 if len(codes) else 0):
                part = v[codes == k]
                mean = part.mean(0)
                yield pa.RecordBatch.from_arrays([*key.slice(k, 1).columns, pa.array([len(part)], pa.int64()), pa.array([mean], pa.list_(pa.float64())),
                                                  pa.array([((part - mean).T @ (part - mean)).ravel()], pa.list_(pa.float64()))], names=names)

    def merge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, np.zeros(width), np.zeros(width * width))
        mean, m2 = np.array(mean, np.float64), np.array(m2, np.float64).reshape(width, width)
        for frame in frames:
            for r in frame.itertuples(index=False):
                step, total = np.array(r.mean) - mean, n + r.n
                mean, m2 = mean + step * (r.n / total), m2 + np.reshape(r.m2, (width, width)) + np.outer(step, step) * (n * r.n / total)
                n = total
        state.update((int(n), mean.tolist(), m2.ravel().tolist()))
        yield pd.DataFrame([(*key, int(n), mean.tolist(), m2.ravel().tolist())], columns=names)

    triples = "n long, mean array<double>, m2 array<double>"
    return rows.mapInArrow(reduced, keys + triples).groupBy(*by).applyInPandasWithState(merge, keys + triples, triples, "update", GroupStateTimeout.NoTimeout)


def run_available(running: DataFrame, on_update: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete") -> None:
    """Process everything available, handing `on_update` the complete per-group table, or with mode 'update' the groups that changed."""
    q = (running.writeStream.outputMode(mode).foreachBatch(on_update)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def slopes(m: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return m.select("site", "n", (mo.S(x, y) / mo.S(x, x)).alias("slope"))


def combined_slope(m: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return m.agg(F.sum("n").alias("n"), (F.sum(mo.S(x, y)) / F.sum(mo.S(x, x))).alias("slope"))
