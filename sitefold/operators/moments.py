"""Centred cross-products per group: the statistic everything else is built from.

The wide form has one row per group with n, a mean `m_<col>` per column and a centred
cross-product `s_<a>__<b>` per unordered pair (names sorted). One scan, partial aggregation on
the map side, and a shuffle whose size is (groups x pairs), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.runtime import join_small

TILE = 64                  # columns of a tile: a tile of the product is TILE x TILE numbers
MERGE_WAYS = 32            # parts of a tile that meet first, before those meet
TASK_CELLS = 20_000_000    # matrix cells one task holds before it hands its partial sums over


def s_name(a: str, b: str) -> str:
    a, b = sorted((a, b))
    return f"s_{a}__{b}"


def S(a: str, b: str) -> Column:
    return F.col(s_name(a, b))


def M(a: str) -> Column:
    return F.col(f"m_{a}")


def pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    names = sorted(set(cols))
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def gram(a: Sequence[str], b: Sequence[str]) -> list[list[Column]]:
    return [[S(i, j) for j in b] for i in a]


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rule for nulls in every kernel: a row without a value in one of the columns counts nowhere, as in a fit of those columns.
    NaN is a value and spreads. A group without a complete row has no statistics."""
    return df.where(" and ".join(f"`{c}` is not null" for c in cols)) if cols else df


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",), origin: dict[str, float] | None = None) -> DataFrame:
    """n, means and centred cross-products of `cols` per group over complete rows, in one pass.

    covar_pop is a Welford-type running aggregate, so no large raw sums are subtracted. Where an
    earlier pass already gave a rough centre for each column (`origin`), plain sums of shifted
    products are as accurate and several times cheaper per row. More expressions than Spark compiles into
    one aggregate go through the tile kernel, which follows the same rules and gives the same table.
    """
    cols = sorted(set(cols))
    if not df.isStreaming and 1 + len(cols) + len(pairs(cols)) > int(df.sparkSession.conf.get("spark.sql.codegen.maxFields")):
        return moments_blocked(df, cols, by)
    df = complete(df, cols)
    if origin is not None:
        return _shifted_moments(df, cols, by, origin)
    n = F.count(F.lit(1))
    aggs = [n.alias("n")] + [F.avg(c).alias(f"m_{c}") for c in cols]
    aggs += [(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * n).alias(s_name(a, b))
             for a, b in pairs(cols)]
    return df.groupBy(*by).agg(*aggs)


def _shifted_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str], origin: dict[str, float]) -> DataFrame:
    shifted = df.select(*by, *[(F.col(c).cast("double") - F.lit(float(origin[c]))).alias(c) for c in cols])
    sums = shifted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"t_{c}") for c in cols],
        *[F.sum(F.col(a) * F.col(b)).alias(s_name(a, b)) for a, b in pairs(cols)])
    n = F.col("n")
    return sums.select(*by, "n", *[(F.lit(float(origin[c])) + F.col(f"t_{c}") / n).alias(f"m_{c}") for c in cols],
                       *[(S(a, b) - F.col(f"t_{a}") * F.col(f"t_{b}") / n).alias(s_name(a, b)) for a, b in pairs(cols)])


def centres(m: DataFrame, squares: Sequence[str] = ()) -> dict[str, float]:
    """Overall mean of every column of a moment table, plus E[c^2] as `<c>2` for the listed columns."""
    cols = [c[2:] for c in mean_columns(m)]
    n = F.sum("n")
    aggs = [(F.sum(F.col("n") * M(c)) / n).alias(c) for c in cols]
    aggs += [((F.sum(S(c, c)) + F.sum(F.col("n") * M(c) * M(c))) / n).alias(f"{c}2") for c in squares]
    return m.agg(*aggs).first().asDict()


def _key_schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def group_codes(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, pa.RecordBatch]:
    """A number for each row's group, and the keys of the groups in the order of the numbers."""
    if not by:
        return np.zeros(batch.num_rows, np.int64), batch.select([]).slice(0, 1)
    keys = batch.select(list(by)).to_pandas()
    codes = keys.groupby(list(by), sort=False, dropna=False).ngroup().to_numpy()
    _, first = np.unique(codes, return_index=True)
    return codes, batch.select(list(by)).take(pa.array(first))


def merged(n: np.ndarray, mean_i: np.ndarray, mean_j: np.ndarray, m2: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """One (n, means, centred products) of several: the products add up, and so do those of the deviations of the means."""
    total = n.sum()
    gi, gj = n @ mean_i / total, n @ mean_j / total
    return int(total), gi, gj, m2.sum(0) + ((mean_i - gi) * n[:, None]).T @ (mean_j - gj)


def _numbers(batches: Iterator[pa.RecordBatch], array: str | None, width: int, more: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of complete rows with their numbers: those of `array`, `width` in every row, then `more` scalar ones."""
    for b in batches:
        if array:
            if b.num_rows and pc.any(pc.not_equal(pc.list_value_length(b.column("_v")), width)).as_py():
                raise ValueError(f"{array}: not {width} numbers in every row")
            flat = b.column("_v").flatten()
            if flat.null_count:
                b = b.filter(pa.array(pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(b.num_rows, width).all(1)))
        both = [b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(b.num_rows, n) for c, n in (("_v", width if array else 0), ("_w", more)) if n]
        yield b, np.concatenate(both, axis=1) if len(both) != 1 else both[0]


def _tile_rows(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]], by: Sequence[str], width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % MERGE_WAYS
    state: dict[tuple, list] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for key, (row, n, mean, m2) in state.items():
            for i in range(0, width, TILE):
                for j in range(i, width, TILE):
                    values = [pa.array([i // TILE], pa.int32()), pa.array([j // TILE], pa.int32()), pa.array([salt], pa.int32()), pa.array([n], pa.int64()),
                              *(pa.array([v], pa.list_(pa.float64())) for v in (mean[i:i + TILE], mean[j:j + TILE], m2[i:i + TILE, j:j + TILE].ravel()))]
                    yield pa.RecordBatch.from_arrays([*row.columns, *values], names=names)

    for b, v in batches:
        codes, keys = group_codes(b, by)
        for k in range(codes.max() + 1 if len(codes) else 0):
            part = v[codes == k]
            n, mean = len(part), part.mean(axis=0)
            m2 = (part - mean).T @ (part - mean)
            row = keys.slice(k, 1)
            key = tuple(row.to_pylist()[0].values()) if by else ()
            if key in state:
                _, n0, mean0, m0 = state[key]
                step, total = mean - mean0, n0 + n
                state[key][1:] = [total, mean0 + step * (n / total), m0 + m2 + np.outer(step, step) * (n0 * n / total)]
            else:
                state[key] = [row, n, mean, m2]
        # many groups with wide matrices: hand over what is held and go on, parts merge exactly
        if len(state) * width * width > TASK_CELLS:
            yield from emitted()
            state.clear()
    yield from emitted()


def moment_tiles(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",), array: str | None = None, width: int = 0) -> DataFrame:
    """(group, i, j, n, mean_i, mean_j, m2): tiles i <= j of the centred cross-products, TILE columns each, row by row.

    `cols` are scalar columns; `array`, if given, is a column of `width` numbers that come first. A task reduces its batches by one matrix
    product each and hands over tiles with the means of their own columns only; equal tiles meet in MERGE_WAYS parts, then as one, so
    neither a group nor a matrix has to pass through one task.
    """
    by, width = list(by), width + len(cols)
    # sizes and nulls of the array are looked at where it is reduced: a condition on it would be evaluated on its own, with every element again
    parts = [F.col(array).cast("array<double>").alias("_v")] if array else []
    parts += [F.array(*[F.col(c).cast("double") for c in cols]).alias("_w")] if cols else []
    rows = complete(df, [*cols, *([array] if array else [])]).select(*by, *parts)
    names = [*by, "i", "j", "salt", "n", "mean_i", "mean_j", "m2"]
    schema = f"{_key_schema(df, by)}i int, j int, salt int, n long, mean_i array<double>, mean_j array<double>, m2 array<double>"
    parts = rows.mapInArrow(lambda batches: _tile_rows(_numbers(batches, array, width - len(cols), len(cols)), by, width, names), schema)

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        mi, mj = flat("mean_i"), flat("mean_j")
        n, gi, gj, m2 = merged(t.column("n").to_numpy().astype(np.float64), mi, mj, flat("m2").reshape(t.num_rows, mi.shape[1], mj.shape[1]))
        values = [pa.array([n], pa.int64()), *(pa.array([v], pa.list_(pa.float64())) for v in (gi, gj, m2.ravel()))]
        return pa.table([*t.select([*by, "i", "j", "salt"]).slice(0, 1).columns, *values], names=names)

    for keys in ([*by, "i", "j", "salt"], [*by, "i", "j"]):
        parts = parts.groupBy(*keys).applyInArrow(merge, schema)
    return parts.drop("salt")


def moment_cells(tiles: DataFrame, names: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """(group, a, b, n, mean_a, mean_b, sxy), one row per pair of columns, of tiles whose columns are called `names`."""
    named = F.array(*[F.lit(c) for c in names])
    row, col = F.expr("p div size(mean_j)").cast("int"), F.expr("p % size(mean_j)").cast("int")
    cells = tiles.select(*by, "i", "j", "n", "mean_i", "mean_j", F.posexplode("m2").alias("p", "sxy"))
    cells = cells.select(*by, "n", (F.col("i") * TILE + row).alias("x"), (F.col("j") * TILE + col).alias("y"), F.get("mean_i", row).alias("mean_a"), F.get("mean_j", col).alias("mean_b"), "sxy")
    return cells.where("x <= y").select(*by, F.get(named, F.col("x")).alias("a"), F.get(named, F.col("y")).alias("b"), "n", "mean_a", "mean_b", "sxy")


def moments_blocked(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """The table of `moments` for wide column lists, from the tile kernel."""
    cols = sorted(set(cols))
    d = len(cols)
    a = moments_arrays(df, cols, by)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    return a.select(*by, "n", *[F.col("mean")[i].alias(f"m_{c}") for i, c in enumerate(cols)],
                    *[F.col("m2")[k].alias(s_name(cols[i], cols[j])) for k, (i, j) in enumerate(upper)])


def moments_arrays(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",), array: str | None = None, width: int = 0) -> DataFrame:
    """(n, mean, m2) per group with m2 the upper triangle of the centred cross-products, row by row: the tiles of a group put
    together, for a solve that needs its whole matrix."""
    by = list(by)
    d = width + len(cols)

    def whole(t: pa.Table) -> pa.Table:
        mean, m2 = np.empty(d), np.empty((d, d))
        for r in t.select(["i", "j", "mean_i", "mean_j", "m2"]).to_pylist():
            x, y = r["i"] * TILE, r["j"] * TILE
            p, q = len(r["mean_i"]), len(r["mean_j"])
            mean[x:x + p], mean[y:y + q] = r["mean_i"], r["mean_j"]
            m2[x:x + p, y:y + q] = np.reshape(r["m2"], (p, q))
        return pa.table([*t.select([*by, "n"]).slice(0, 1).columns, pa.array([mean], pa.list_(pa.float64())), pa.array([m2[np.triu_indices(d)]], pa.list_(pa.float64()))], names=[*by, "n", "mean", "m2"])

    return moment_tiles(df, cols, by, array, width).groupBy(*by).applyInArrow(whole, f"{_key_schema(df, by)}n long, mean array<double>, m2 array<double>")


def stat_columns(m: DataFrame) -> list[str]:
    return [c for c in m.columns if c.startswith("s_")]


def mean_columns(m: DataFrame) -> list[str]:
    return [c for c in m.columns if c.startswith("m_")]


def combine(m: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Sum per-site statistics: the pooled matrices with one intercept absorbed per site."""
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("absorbed")]
    aggs += [F.sum(c).alias(c) for c in [*stat_columns(m), *extra]]
    return m.groupBy(*by).agg(*aggs)


def total_scatter(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cross-products around the pooled mean (one common intercept): within plus between sites."""
    cols = [c[2:] for c in mean_columns(m)]
    n = F.col("n")
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites")]
    aggs += [(F.sum(n * M(c)) / F.sum(n)).alias(f"m_{c}") for c in cols]
    # Each site enters once with weight n, so the between part is n * weighted covariance of means.
    for a, b in pairs(cols):
        if s_name(a, b) in m.columns:
            between = F.sum(n * M(a) * M(b)) - F.sum(n * M(a)) * F.sum(n * M(b)) / F.sum(n)
            aggs.append((F.sum(S(a, b)) + between).alias(s_name(a, b)))
    return m.groupBy(*by).agg(*aggs)


def merge_out(total: dict, part: dict) -> dict:
    """Group moments with one part removed (n, means and cross-products), as Column maps."""
    n_out = total["n"] - part["n"]
    out = {"n": n_out}
    means = {c: (total["n"] * total["m"][c] - part["n"] * part["m"][c]) / n_out for c in total["m"]}
    out["m"] = means
    k = part["n"] * n_out / total["n"]
    out["s"] = {(a, b): total["s"][a, b] - part["s"][a, b] - k * (part["m"][a] - means[a]) * (part["m"][b] - means[b])
                for (a, b) in total["s"]}
    return out


def to_long(m: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """(group, a, b, sxy): the name-keyed layout in which sites with different columns line up."""
    names = stat_columns(m)
    entries = [F.struct(F.lit(c[2:].split("__")[0]).alias("a"), F.lit(c[2:].split("__")[1]).alias("b"),
                        F.col(c).alias("sxy")) for c in names]
    return m.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.a", "e.b", "e.sxy")


def sum_long(parts: DataFrame) -> DataFrame:
    """Align by column name and add: the group key is the alignment."""
    return parts.groupBy("a", "b").agg(F.sum("sxy").alias("sxy"), F.count(F.lit(1)).alias("sites"))


def centre_within(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("site",), suffix: str = "_c") -> DataFrame:
    """Subtract the group mean from every row. Means are a per-group table joined back, so a site
    that holds most of the rows is not pulled into one window partition."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    return (join_small(df, means, list(by))
            .select(*df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(c + suffix) for c in cols]))


def check_roles(parts: Sequence[dict[str, str]]) -> dict[str, str]:
    """First-use ordered union of column roles over sites; one name may not carry two roles."""
    union: dict[str, str] = {}
    for roles in parts:
        for name, role in roles.items():
            if union.setdefault(name, role) != role:
                raise ValueError(f"column {name!r} is {union[name]} at one site and {role} at another")
    return union
