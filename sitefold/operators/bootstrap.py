"""Bootstrap of the whole two-stage fit, all replicates in one job.

Rows are not multiplied by the number of replicates: each task turns its rows and a weight matrix into per-replicate weighted
cross-products with one matrix product. Weights are a function of keys only, so every retry draws the same ones. They are either
Poisson counts, a hash of (seed, row, replicate), or exact: n draws per site and replicate, split over ranges of a row hash by a binary
tree of binomials. A task walks the path from the root to its own range, with generators keyed by the nodes it passes, so the
draws of all ranges add up to n although no task knows another's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions import matrix as mx
from sitefold.operators import controlfn as cf
from sitefold.operators import moments as mo
from sitefold.operators import ordered as od
from sitefold.runtime import cut

SECOND_CELLS = 1 << 16   # replicates x rows whose own regressors are held at once
LEAF_ROWS = 2048   # rows of a range, about; a task holds the weights of one range at a time

# P(N <= k) for N ~ Poisson(1)
_POISSON_CDF = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(0, 18)])


def _mix(v: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def poisson_weights(row_hash: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(replicates x rows) Poisson(1) counts, a function of the two keys only."""
    with np.errstate(over="ignore"):
        keys = row_hash[None, :] + (reps[:, None].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    u = (_mix(keys) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_POISSON_CDF, u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def replicate_moments(df: DataFrame, cols: Sequence[str], ids: Sequence[str], n_boot: int, seed: int = 0,
                      batch: int = 4096, spread: int | None = None) -> DataFrame:
    """Weighted moments per (rep, site): n, means and centred cross-products of `cols`.

    Columns are shifted by their global means first, so the centred products lose no digits. The
    work per row grows with n_boot, so rows of a few large files may be worth spreading over
    `spread` tasks first.
    """
    cols = sorted(set(cols))
    d = len(cols)
    means = df.agg(*[F.avg(c) for c in cols]).first()
    shifted = df.select("site", F.xxhash64(F.lit(seed), *[F.col(c) for c in ids]).alias("_h"),
                        *[(F.col(c).cast("double") - F.lit(float(m))).alias(c) for c, m in zip(cols, means)])
    if spread is not None:
        shifted = shifted.repartition(spread)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    ii, jj = [i for i, _ in upper], [j for _, j in upper]
    reps = np.arange(n_boot)

    def emit(acc):
        for site, total in acc.items():
            yield pd.DataFrame({"site": site, "rep": reps.astype("int32"), "t": list(total)})

    def partials(batches):
        acc: dict = {}
        for pdf in batches:
            if len(acc) * n_boot * (1 + d + len(upper)) > mo.TASK_CELLS:
                yield from emit(acc)
                acc = {}
            for start in range(0, len(pdf), batch):
                part_all = pdf.iloc[start:start + batch]
                for site, part in part_all.groupby("site", sort=False):
                    v = part[cols].to_numpy(dtype=np.float64)
                    w = poisson_weights(part["_h"].to_numpy().astype(np.int64).view(np.uint64), reps)
                    feats = np.concatenate([np.ones((len(v), 1)), v, v[:, ii] * v[:, jj]], axis=1)
                    acc[site] = acc.get(site, 0.0) + w @ feats
        yield from emit(acc)

    kind = df.schema["site"].dataType.simpleString()
    parts = shifted.mapInPandas(partials, f"site {kind}, rep int, t array<double>")
    width = 1 + d + len(upper)
    sums = parts.groupBy("rep", "site").agg(*[F.sum(F.col("t")[k]).alias(f"t{k}") for k in range(width)])
    w = F.col("t0")
    return sums.select("rep", "site", w.alias("n"),
                       *[(F.lit(float(m)) + F.col(f"t{i + 1}") / w).alias(f"m_{c}") for i, (c, m) in enumerate(zip(cols, means))],
                       *[(F.col(f"t{1 + d + k}") - F.col(f"t{i + 1}") * F.col(f"t{j + 1}") / w).alias(mo.s_name(cols[i], cols[j]))
                         for k, (i, j) in enumerate(upper)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: the path to it, which its first row brings, and the values of the others."""
    names = ["site", "key", "leaf", "lefts", "totals", "m", "rows", "v"]
    head, parts, ids = None, [], []

    def out() -> pa.RecordBatch:
        v = np.concatenate(parts) if parts else np.zeros(0)
        m = sum(len(i) for i in ids)
        return pa.RecordBatch.from_arrays([*head, pa.array([m], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=names)

    for b in batches:
        marks = np.flatnonzero(b.column("kind").to_numpy() == 0)
        for begin, end in zip([0, *marks], [*marks, b.num_rows]):
            if begin == end:
                continue
            if len(marks) and begin in marks:
                if head is not None and parts:
                    yield out()
                head, parts, ids = [b.column(c).slice(begin, 1) for c in names[:5]], [], []
                begin += 1
            if begin < end:
                parts.append(b.column("v").slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                ids.append(b.column("h").slice(begin, end - begin).to_numpy().astype(np.int64))
    if head is not None and parts:
        yield out()


def leaves(df: DataFrame, cols: Sequence[str], ids: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows of each site dealt over ranges of a hash of `ids`, packed: (site, key, leaf, lefts, totals, m, rows, v).

    `lefts` and `totals` count, for every node on the way from the site's root to the range, the rows of the left child and of the node;
    `rows` are the row hashes and `v` the values of `cols`. Rows move once, whatever the number of replicates. Complete rows only."""
    df = mo.complete(df, cols)
    largest = df.groupBy("site").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(0, int(largest - 1).bit_length() - (LEAF_ROWS - 1).bit_length()) if largest else 0
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    leaf = F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")
    rows = df.select("site", h.alias("h"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v")).withColumn("leaf", leaf)
    counts = cut(rows.groupBy("site", "leaf").agg(F.count(F.lit(1)).alias("c")))
    nodes = counts.select("site", "c", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level"), "leaf").groupBy(
        "site", "level", F.expr(f"shiftright(leaf, {bits} - level)").alias("node")).agg(F.sum("c").alias("c"))
    # the nodes a leaf descends from, each with the count of its left child
    way = counts.select("site", "leaf", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)) if bits else F.array().cast("array<int>")).alias("level")).withColumn("node", F.expr(f"shiftright(leaf, {bits} - level)"))
    way = way.join(nodes.withColumnRenamed("c", "total"), ["site", "level", "node"])
    left = nodes.where("level > 0 and node % 2 = 0").select("site", (F.col("level") - 1).alias("level"), F.expr("node div 2").alias("node"), F.col("c").alias("left"))
    way = way.join(left, ["site", "level", "node"], "left").groupBy("site", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", F.coalesce("left", F.lit(0)).alias("left"), "total"))).alias("way"))
    paths = counts.join(way, ["site", "leaf"], "left").select("site", "leaf", F.coalesce(F.transform("way", lambda e: e["left"]), F.array().cast("array<bigint>")).alias("lefts"),
                                                              F.coalesce(F.transform("way", lambda e: e["total"]), F.array().cast("array<bigint>")).alias("totals"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(paths.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("key", F.xxhash64(F.lit(seed), "site"))
    dealt = both.repartition(od.bucket_count(df), "site", "leaf").sortWithinPartitions("site", "leaf", "kind", "h", "v")
    kind = df.schema["site"].dataType.simpleString()
    return cut(dealt.select("site", "key", "leaf", "lefts", "totals", "kind", "h", "v").mapInArrow(
        _packed, f"site {kind}, key long, leaf long, lefts array<bigint>, totals array<bigint>, m long, rows binary, v binary"))


def _generator(key: int, level: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([key & (2**64 - 1), (level << 56) ^ node], np.uint64)))


def exact_weights(key: int, leaf: int, lefts: Sequence[int], totals: Sequence[int], m: int, n_boot: int) -> np.ndarray:
    """(replicates x rows) times each row of a range is drawn: the range's share of the site's n draws, then each draw to a row."""
    bits = len(totals)
    draws = np.full(n_boot, totals[0] if bits else m, np.int64)
    for level, (left, total) in enumerate(zip(lefts, totals)):
        to_left = _generator(key, level, leaf >> (bits - level)).binomial(draws, left / total)
        draws = draws - to_left if leaf >> (bits - level - 1) & 1 else to_left
    rng = _generator(key, 63, leaf)
    out = np.empty((n_boot, m))
    step = max(1, (1 << 20) // max(m, 1))
    for at in range(0, n_boot, step):  # about a million draws at once
        d = draws[at:at + step]
        cell = np.repeat(np.arange(len(d)), d) * m + rng.integers(0, m, int(d.sum()))
        out[at:at + step] = np.bincount(cell, minlength=len(d) * m).reshape(len(d), m)
    return out


def _summed(packed: DataFrame, n_boot: int, features: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(site, rep, t): `features(site, weights, values)` gives (replicates x sums) for a range; tasks add them up per site."""
    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for site, (row, total) in acc.items():
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([row] * n_boot), pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["site", "rep", "t"])

        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                w = exact_weights(r["key"], r["leaf"], r["lefts"], r["totals"], r["m"], n_boot)
                part = features(r["site"], w, np.frombuffer(r["v"]).reshape(r["m"], -1))
                acc[r["site"]] = (b.column("site").slice(i, 1), acc[r["site"]][1] + part if r["site"] in acc else part)
                if len(acc) * part.size > mo.TASK_CELLS:
                    yield from emitted()
                    acc.clear()
        yield from emitted()

    parts = packed.mapInArrow(partials, f"site {packed.schema['site'].dataType.simpleString()}, rep int, t array<double>")
    cells = parts.select("site", "rep", F.posexplode("t").alias("k", "v")).groupBy("site", "rep", "k").agg(F.sum("v").alias("v"))
    return cells.groupBy("site", "rep").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).select("site", "rep", F.transform("p", lambda e: e["v"]).alias("t"))


def multinomial_counts(df: DataFrame, ids: Sequence[str], n_boot: int, seed: int = 0) -> DataFrame:
    """Rows with the times each is drawn in every replicate, `times` an array by replicate: exactly n draws with replacement per site. Rows whose
    `ids` have one hash share its draws' first place."""
    packed = leaves(df.withColumn("_one", F.lit(1.0)), ["_one"], ids, seed)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                w = exact_weights(r["key"], r["leaf"], r["lefts"], r["totals"], r["m"], n_boot).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("site").slice(i, 1)] * r["m"]), pa.array(np.frombuffer(r["rows"], np.int64)), pa.array(list(w.T), pa.list_(pa.int32()))], names=["site", "row", "times"])

    return packed.mapInArrow(counts, f"site {packed.schema['site'].dataType.simpleString()}, row long, times array<int>")


def draws(df: DataFrame, ids: Sequence[str], n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, site, draws): how many rows each replicate draws from each site."""
    packed = leaves(df.withColumn("_one", F.lit(1.0)), ["_one"], ids, seed)
    return _summed(packed, n_boot, lambda site, w, v: w.sum(1, keepdims=True)).select("rep", "site", F.col("t")[0].cast("long").alias("draws"))


def _basis(x: np.ndarray, degree: int, knots: Sequence[float]) -> np.ndarray:
    """Powers of x, then a hinge per knot, in the last axis: the columns of controlfn.basis_columns."""
    return np.stack([*(x ** k for k in range(1, degree + 1)), *(np.maximum(x - k, 0.0) for k in knots)], axis=-1)


def _scatter(t: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and centred cross-products from (n, sums, upper triangle of the products)."""
    n, sums, full = t[0], t[1:1 + d], np.zeros((d, d))
    full[np.triu_indices(d)] = t[1 + d:]
    full = full + np.triu(full, 1).T
    return n, sums / n, full - np.outer(sums, sums) / n


def curve_replicates(df: DataFrame, snps: Sequence[str], ids: Sequence[str], n_boot: int, method: str = "2sri", degree: int = 2,
                     knots: Sequence[float] = (), seed: int = 0, x: str = "x", y: str = "y") -> DataFrame:
    """Both stages refitted on every replicate of exactly n rows per site: (rep, coef), coefficients of the curve's basis, then for 2sri that of
    the residual. For any polynomial or hinge basis and the three methods of controlfn."""
    return curves_by_method(df, snps, ids, n_boot, (method,), degree, knots, seed, x, y)[method]


def curves_by_method(df: DataFrame, snps: Sequence[str], ids: Sequence[str], n_boot: int, methods: Sequence[str] = cf.METHODS, degree: int = 2,
                     knots: Sequence[float] = (), seed: int = 0, x: str = "x", y: str = "y") -> dict[str, DataFrame]:
    """The tables of `curve_replicates` for several methods, which share the packed rows, their draws and the first stages.

    naive and 2sri follow from one pass of weighted moments, as the residual is linear in them. 2sps takes powers of each replicate's own
    prediction, so a second pass reads the same packed rows with every replicate's first stage (replicates x sites x instruments numbers)."""
    for method in methods:
        if method not in cf.METHODS:
            raise ValueError(f"method must be one of {cf.METHODS}, got {method!r}")
    m, p = len(snps), degree + len(knots)
    packed = leaves(df, [*snps, x, y], ids, seed)
    centre = df.agg(*[F.avg(c) for c in (*snps, x, y)]).first()
    centre = np.array([float(c or 0.0) for c in centre])
    once = any(method != "2sps" for method in methods)  # a method that follows from the moments of the basis
    width = m + 2 + (p if once else 0)
    at_centre = _basis(centre[m], degree, knots)
    z, xs, ys, bs = np.arange(m), m, m + 1, np.arange(m + 2, m + 2 + p)
    upper = np.triu_indices(width)

    def first_sums(site, w, v):
        cols = np.concatenate([v - centre, _basis(v[:, m], degree, knots) - at_centre], axis=1) if once else v - centre
        return w @ np.concatenate([np.ones((len(v), 1)), cols, cols[:, upper[0]] * cols[:, upper[1]]], axis=1)

    sums = cut(_summed(packed, n_boot, first_sums))

    def solved(method: str) -> Callable[[pa.Table], pa.Table]:
        def solve(t: pa.Table) -> pa.Table:
            a, c = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
            for r in t.column("t").to_pylist():
                _, _, s = _scatter(np.array(r), width)
                pi = np.linalg.lstsq(s[np.ix_(z, z)], s[z, xs], rcond=None)[0]
                along = np.zeros((width, p + 1))  # the regressors as combinations of the columns: the basis, and x less its prediction
                along[bs, np.arange(p)] = 1.0
                along[xs, p], along[z, p] = 1.0, -pi
                a += along.T @ s @ along
                c += along.T @ s[:, ys]
            k = p if method == "naive" else p + 1
            return pa.table({"rep": t.column("rep").slice(0, 1), "coef": pa.array([np.linalg.solve(a[:k, :k], c[:k])], pa.list_(pa.float64()))})

        return solve

    out = {method: sums.groupBy("rep").applyInArrow(solved(method), "rep int, coef array<double>") for method in methods if method != "2sps"}
    if "2sps" not in methods:
        return out
    stages: dict = {}
    for r in sums.collect():
        _, mean, s = _scatter(np.array(r["t"]), width)
        pi = np.linalg.lstsq(s[np.ix_(z, z)], s[z, xs], rcond=None)[0]
        stages.setdefault(r["site"], np.zeros((n_boot, m + 1)))[r["rep"]] = [mean[xs] + centre[m] - pi @ (mean[z] + centre[:m]), *pi]
    above = np.triu_indices(p + 1)

    def second_sums(site, w, v):
        out, step = np.empty((n_boot, 1 + (p + 1) + len(above[0]))), max(1, SECOND_CELLS // max(len(v), 1))
        outcome = v[:, m + 1] - centre[m + 1]
        for at in range(0, n_boot, step):  # a replicate's own regressors: replicates x rows, some replicates at once
            these = slice(at, at + step)
            predicted = stages[site][these, :1] + stages[site][these, 1:] @ v[:, :m].T
            cols = [*np.moveaxis(_basis(predicted, degree, knots) - at_centre, -1, 0), np.broadcast_to(outcome, predicted.shape)]
            weighted = [w[these] * c for c in cols]
            out[these] = np.column_stack([w[these].sum(1), *(c.sum(1) for c in weighted), *(np.einsum("rm,rm->r", weighted[i], cols[j]) for i, j in zip(*above))])
        return out

    def solved_second(t: pa.Table) -> pa.Table:
        s = sum(_scatter(np.array(r), p + 1)[2] for r in t.column("t").to_pylist())
        return pa.table({"rep": t.column("rep").slice(0, 1), "coef": pa.array([np.linalg.solve(s[:p, :p], s[:p, p])], pa.list_(pa.float64()))})

    return out | {"2sps": _summed(packed, n_boot, second_sums).groupBy("rep").applyInArrow(solved_second, "rep int, coef array<double>")}


def two_stage(rep_moments: DataFrame, snps: Sequence[str], method: str = "2sri") -> DataFrame:
    """Both stages refitted per replicate from its moments (linear curve): slope of f per rep.

    With xhat linear in the instruments every second-stage moment is algebra on (G, x, y).
    """
    z = list(snps)
    fs = rep_moments.withColumn("_p", mx.project(mx.flat(mo.gram(z, z)), mx.flat(mo.gram(z, ["x", "y"]))))
    pxx, pxy = F.col("_p.explained")[0], F.col("_p.explained")[1]
    # cross-products of resid = x - xhat: with x and with itself xx - pxx, with y xy - pxy
    rx, ry = mo.S("x", "x") - pxx, mo.S("x", "y") - pxy
    s = fs.groupBy("rep").agg(F.sum(mo.S("x", "x")).alias("xx"), F.sum(mo.S("x", "y")).alias("xy"), F.sum(rx).alias("rx"),
                              F.sum(ry).alias("ry"), F.sum(pxx).alias("pxx"), F.sum(pxy).alias("pxy"))
    if method == "naive":
        return s.select("rep", (F.col("xy") / F.col("xx")).alias("theta_1"))
    if method == "2sps":
        return s.select("rep", (F.col("pxy") / F.col("pxx")).alias("theta_1"))
    t = mx.mul(mx.inverse([[F.col("xx"), F.col("rx")], [F.col("rx"), F.col("rx")]]), [[F.col("xy")], [F.col("ry")]])
    return s.select("rep", t[0][0].alias("theta_1"), t[1][0].alias("control"))


def replicate_curves(params: DataFrame) -> DataFrame:
    """Anchored curve of every replicate on the x grid."""
    from sitefold.operators.curves import with_grid

    return with_grid(params).select("rep", "x", (F.col("theta_1") * F.col("x")).alias("f"))
