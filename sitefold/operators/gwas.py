"""Per-instrument regressions and their summary-statistic combination."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.operators.moments import MERGE_WAYS, complete, group_codes

STRIP = 512  # instruments whose sums travel together


def _slope_and_se(sxx: Column, sxy: Column, syy: Column, n: Column) -> tuple[Column, Column]:
    """Null where the instrument does not vary in the group, or the group has too few rows."""
    beta = F.try_divide(sxy, sxx)
    return beta, F.sqrt(F.try_divide(F.try_divide(F.greatest(syy - beta * beta * sxx, F.lit(0.0)), n - 2), sxx))


def gwas(df: DataFrame, snps: Sequence[str], x: str = "x", y: str = "y", by: Sequence[str] = ("site",)) -> DataFrame:
    """Simple regression of x and of y on every instrument, per group.

    Instruments stay as columns through the scan, so rows are never multiplied; the one result
    row per group is unpivoted at the end. Rows without x or y count nowhere, and rows without a dosage not for that instrument.
    """
    df = complete(df, [x, y])

    def cp(s, a, b):
        there = F.col(s).isNotNull()
        return F.covar_pop(F.when(there, F.col(a).cast("double")), F.when(there, F.col(b).cast("double"))) * F.count(s)

    aggs = []
    for s in snps:
        aggs += [F.count(s).alias(f"{s}_n"), cp(s, s, s).alias(f"{s}_gg"), cp(s, s, x).alias(f"{s}_gx"), cp(s, s, y).alias(f"{s}_gy"), cp(s, x, x).alias(f"{s}_xx"), cp(s, y, y).alias(f"{s}_yy")]
    wide = df.groupBy(*by).agg(*aggs)
    entries = [F.struct(F.lit(s).alias("snp"), *[F.col(f"{s}_{c}").alias(c) for c in ("n", "gg", "gx", "gy", "xx", "yy")]) for s in snps]
    return _regressions(wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*"), by)


def _regressions(long: DataFrame, by: Sequence[str]) -> DataFrame:
    bx, sx = _slope_and_se(F.col("gg"), F.col("gx"), F.col("xx"), F.col("n"))
    by_, sy = _slope_and_se(F.col("gg"), F.col("gy"), F.col("yy"), F.col("n"))
    return long.select(*by, "snp", "n", bx.alias("beta_x"), sx.alias("se_x"), by_.alias("beta_y"), sy.alias("se_y"))


# sums of an instrument: rows, means of (g, x, y), centred products
_PRODUCTS = ((1, 1), (1, 2), (1, 3), (2, 2), (3, 3))


def _strip_sums(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    there = ~np.isnan(g)
    n = there.sum(0)
    values = [np.where(there, v, 0.0) for v in (g, x[:, None], y[:, None])]
    means = [v.sum(0) / np.maximum(n, 1) for v in values]
    centred = [np.where(there, v - m, 0.0) for v, m in zip(values, means)]
    return np.stack([n, *means, *((centred[a - 1] * centred[b - 1]).sum(0) for a, b in _PRODUCTS)])


def _strips_merged(parts: np.ndarray) -> np.ndarray:
    """One (9, instruments) of (parts, 9, instruments)."""
    n = parts[:, 0]
    total = n.sum(0)
    means = (n[:, None] * parts[:, 1:4]).sum(0) / np.maximum(total, 1)
    off = parts[:, 1:4] - means
    return np.stack([total, *means, *(parts[:, 4 + k].sum(0) + (n * off[:, a - 1] * off[:, b - 1]).sum(0) for k, (a, b) in enumerate(_PRODUCTS))])


def gwas_long(df: DataFrame, g: str = "g", x: str = "x", y: str = "y", by: Sequence[str] = ("site",)) -> DataFrame:
    """Same for instruments packed in an array column of any width, under the same rules for nulls.

    A task keeps nine sums per group and instrument, whatever its rows; strips of STRIP instruments travel and merge, first in MERGE_WAYS
    parts and then as one, so rows are never multiplied by instruments. Shorter arrays lack their last instruments.
    """
    by = list(by)
    names = [*by, "strip", "salt", "sums"]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by) + "strip int, salt int, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, state = TaskContext.get().partitionId() % MERGE_WAYS, {}
        for b in batches:
            codes, keys = group_codes(b, by)
            lists = b.column("_g")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            dense = np.full((b.num_rows, int(sizes.max(initial=0))), np.nan)
            dense[np.arange(dense.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            xs, ys = (b.column(c).to_numpy() for c in ("_x", "_y"))
            for k in range(codes.max() + 1 if len(codes) else 0):
                mine = codes == k
                row = keys.slice(k, 1)
                sums = _strip_sums(dense[mine], xs[mine], ys[mine])
                key = tuple(row.to_pylist()[0].values()) if by else ()
                if key in state:
                    wide = max(sums.shape[1], state[key][1].shape[1])
                    sums = _strips_merged(np.stack([np.pad(s, ((0, 0), (0, wide - s.shape[1]))) for s in (sums, state[key][1])]))
                state[key] = [row, sums]
        for row, sums in state.values():
            for at in range(0, sums.shape[1], STRIP):
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([at // STRIP], pa.int32()), pa.array([salt], pa.int32()), pa.array([sums[:, at:at + STRIP].ravel()], pa.list_(pa.float64()))], names=names)

    def merge(t: pa.Table) -> pa.Table:
        parts = [np.reshape(r.as_py(), (9, -1)) for r in t.column("sums")]
        wide = max(p.shape[1] for p in parts)
        sums = _strips_merged(np.stack([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts]))
        return pa.table([*t.select([*by, "strip", "salt"]).slice(0, 1).columns, pa.array([sums.ravel()], pa.list_(pa.float64()))], names=names)

    rows = complete(df, [x, y]).select(*by, F.transform(g, lambda e: e.cast("double")).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    parts = rows.mapInArrow(partial, schema)
    for keys in ([*by, "strip", "salt"], [*by, "strip"]):
        parts = parts.groupBy(*keys).applyInArrow(merge, schema)
    wide = F.expr("size(sums) div 9")
    sums = {c: F.get("sums", F.col("j") + k * wide) for k, c in enumerate(("n", "mg", "mx", "my", "gg", "gx", "gy", "xx", "yy"))}
    long = parts.select(*by, "strip", "sums", F.explode(F.sequence(F.lit(0), (wide - 1).cast("int"))).alias("j"))
    long = long.select(*by, F.concat(F.lit("snp"), F.col("strip") * STRIP + F.col("j")).alias("snp"), sums["n"].cast("long").alias("n"), *[sums[c].alias(c) for c in ("gg", "gx", "gy", "xx", "yy")])
    return _regressions(long.where("n > 0"), by)


def ivw(stats: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Inverse-variance weighted slope through the origin (fixed effect, weights from se_y only)."""
    w = F.try_divide(F.lit(1.0), F.col("se_y") * F.col("se_y"))
    wxx = F.sum(w * F.col("beta_x") * F.col("beta_x"))
    return stats.groupBy(*by).agg(
        F.max("n").alias("n"), F.try_divide(F.sum(w * F.col("beta_x") * F.col("beta_y")), wxx).alias("ivw"),
        F.sqrt(F.try_divide(F.lit(1.0), wxx)).alias("ivw_se"), mean_first_stage_f().alias("mean_F"))


def mean_first_stage_f(beta: str = "beta_x", se: str = "se_x") -> Column:
    return F.avg(F.pow(F.try_divide(F.col(beta), F.col(se)), F.lit(2.0)))


def naive_slope(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ("site",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp(x, y), F.var_samp(x)).alias("naive"))


def explained_variance(df: DataFrame, effects: DataFrame, snps: Sequence[str]) -> DataFrame:
    """Sum of beta^2 2p(1-p) per site, with p half the mean dosage."""
    freq = df.groupBy("site").agg(*[(F.avg(s) / 2.0).alias(s) for s in snps])
    long = freq.select("site", F.explode(F.array(*[F.struct(F.lit(s).alias("snp"), F.col(s).alias("p"))
                                                   for s in snps])).alias("e")).select("site", "e.snp", "e.p")
    b = effects.select("site", "snp", "beta_x")
    return (long.join(b, ["site", "snp"]).groupBy("site")
            .agg(F.sum(F.col("beta_x") * F.col("beta_x") * 2.0 * F.col("p") * (1.0 - F.col("p"))).alias("explained")))
