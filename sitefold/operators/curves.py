"""Dose-response curves: grids, interpolation, anchoring, bands and read-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import matrix as mx
from sitefold.functions import scalars as sc
from sitefold.operators import ordered as od

# The two grids curves are evaluated on, and the range parameters are read from.
X_GRID = (-3.0, 3.0, 61)
FINE_GRID = (-2.5, 2.5, 200)
X_MAX = 2.0
BINS = (-3.0, 3.0, 24)
MIN_BIN = 30


def with_grid(df: DataFrame, grid: tuple[float, float, int] = X_GRID, name: str = "x") -> DataFrame:
    """Repeat each row (a curve's parameters) at every grid point."""
    lo, hi, n = grid
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("k", k).withColumn(name, F.lit(lo) + F.col("k") * F.lit((hi - lo) / (n - 1)))


def _between(at: Column, lo: Column, hi: Column) -> Column:
    """Linear between two knots (x, f), constant where one of them is missing."""
    t = (at - lo["x"]) / (hi["x"] - lo["x"])
    return (F.when(lo.isNull(), hi["f"]).when(hi.isNull(), lo["f"]).when(hi["x"] == lo["x"], lo["f"])
            .otherwise(lo["f"] + t * (hi["f"] - lo["f"])))


def nearest_knots(knots: DataFrame, points: DataFrame, by: Sequence[str], x: str = "x", f: str = "f") -> DataFrame:
    """(by, x, times, lo, hi) for every distinct point: the last knot at or below it and the first at or above, as structs (x, f); `times` is how
    often the point occurs.

    An as-of join in both directions. Knots and points of all curves are dealt over ranges of (curve, x), so one curve may fill any number
    of tasks; windows run inside a range, and the nearest knots beyond its edges are carried over from the ranges' own first and last
    ones, of which there is a row per range and curve. Of several knots at one x the one with the largest value counts.
    """
    by = list(by)
    at = F.col(x).cast("double").alias("_x")
    u = knots.where(F.col(x).isNotNull()).select(*by, at, F.col(f).cast("double").alias("_f")).groupBy(*by, "_x").agg(F.max("_f").alias("_f"), F.lit(True).alias("_knot")).unionByName(
        points.select(*by, at).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_times")), allowMissingColumns=True)
    u = u.groupBy(*by, "_x").agg(F.max("_f").alias("_f"), F.max("_knot").alias("_knot"), F.max("_times").alias("_times"))
    u = od.with_buckets(u, by, "_x")
    knot = F.when(F.col("_knot"), F.struct(F.col("_x").alias("x"), F.col("_f").alias("f")))
    edges = u.where("_knot").groupBy(*by, "_bucket").agg(F.max_by(knot, "_x").alias("_last"), F.min_by(knot, "_x").alias("_first"))
    # every bucket of a curve, those without a knot too: what the buckets before and after carry into it
    every = u.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).join(edges, [*by, "_bucket"], "left")
    inside = Window.partitionBy(*by).orderBy("_bucket")
    carried = every.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                           F.first("_first", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    own = Window.partitionBy(*by, "_bucket").orderBy("_x")
    u = u.withColumn("_k", knot).join(carried, [*by, "_bucket"])
    lo = F.coalesce(F.last("_k", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    hi = F.coalesce(F.first("_k", ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    return u.select(*by, F.col("_x").alias(x), F.col("_times").alias("times"), lo.alias("lo"), hi.alias("hi")).where("times is not null")


def interpolate(knots: DataFrame, points: DataFrame, by: Sequence[str], x: str = "x", f: str = "f") -> DataFrame:
    """Piecewise-linear values at `points`, constant beyond the end knots: one row per row of `points`. A curve without knots, and a point
    without x, have no value."""
    found = nearest_knots(knots, points, by, x, f)
    value = F.when(F.col(x).isNotNull(), _between(F.col(x), F.col("lo"), F.col("hi")))
    return found.select(*by, x, value.alias(f), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_copy")).drop("_copy")


def value_at(knots: DataFrame, by: Sequence[str], at: float, x: str = "x", f: str = "f", name: str = "f0") -> DataFrame:
    """Interpolated value of every curve at one point, by aggregation alone."""
    below = F.col(x) <= F.lit(at)
    above = F.col(x) >= F.lit(at)
    pair = F.struct(F.col(x).alias("x"), F.col(f).alias("f"))
    g = knots.groupBy(*by).agg(F.max_by(pair, F.when(below, F.col(x))).alias("lo"), F.min_by(pair, F.when(above, F.col(x))).alias("hi"))
    value = _between(F.lit(at), F.col("lo"), F.col("hi"))
    return g.select(*by, value.alias(name))


def last_round(df: DataFrame, by: Sequence[str] = (), round_col: str = "round") -> DataFrame:
    """Rows of the last round (per key), the maximum computed as an aggregate and joined back."""
    if by:
        last = df.groupBy(*by).agg(F.max(round_col).alias(round_col))
        return df.join(last, [*by, round_col], "left_semi")
    return df.filter(F.col(round_col) == df.select(F.max(round_col)).scalar())


def mean_curve(curves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last-round curve averaged over sites, one value per x."""
    return last_round(curves, by).groupBy(*by, "x").agg(F.avg("f").alias("f"))


def anchor(curves: DataFrame, by: Sequence[str], f: str = "f") -> DataFrame:
    """Shift each curve to pass through zero at x = 0."""
    zero = value_at(curves, by, 0.0, f=f)
    joined = curves.join(zero, list(by)) if by else curves.withColumn("f0", zero.scalar())
    return joined.withColumn(f, F.col(f) - F.col("f0")).drop("f0")


def binned_means(df: DataFrame, x: str = "x", y: str = "y", binary: bool = False, by: Sequence[str] = (),
                 bins: tuple[float, float, int] = BINS, min_n: int = MIN_BIN) -> DataFrame:
    """Mean x and y in right-closed equal bins, sparse bins dropped by the minimum-count rule;
    logit of the mean for binary y."""
    lo, hi, n = bins
    width = (hi - lo) / n
    b = F.ceil((F.col(x) - F.lit(lo)) / F.lit(width)).cast("int")
    g = df.filter((F.col(x) > lo) & (F.col(x) <= hi)).groupBy(*by, b.alias("bin")).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    return g.withColumn("y", sc.logit(F.col("y"))) if binary else g


def percentile_band(boot: DataFrame, level: float = 0.95, by: Sequence[str] = (), f: str = "f") -> DataFrame:
    """Pointwise percentile interval and sd over replicates. A group holds one value per replicate,
    a count fixed by the caller."""
    a = (1 - level) / 2
    return boot.groupBy(*by, "x").agg(F.percentile(f, F.lit(a)).alias("lo"), F.percentile(f, F.lit(1 - a)).alias("hi"),
                                      F.stddev_samp(f).alias("sd"))


def attach_band(curves: DataFrame, band: DataFrame) -> DataFrame:
    """Band columns on the last round only, shifted by the point curve's value at zero. Bands match
    on x rounded to six decimals."""
    point = mean_curve(curves)
    f0 = value_at(point, (), 0.0).scalar()
    last = curves.select(F.max("round")).scalar()
    c = curves.withColumn("_last", last).withColumn("_f0", f0)
    key = F.when(F.col("round") == F.col("_last"), F.round("x", 6))
    b = band.select(F.round("x", 6).alias("_key"), "lo", "hi")
    j = c.withColumn("_key", key).join(b, "_key", "left")
    return j.select(*curves.columns, (F.col("lo") + F.col("_f0")).alias("f_lo"), (F.col("hi") + F.col("_f0")).alias("f_hi"))


def read_parameters(curves: DataFrame, by: Sequence[str], curved: bool, x_max: float = X_MAX, anchored: bool = False,
                    slack: float = 0.0) -> DataFrame:
    """Least squares of the anchored curve on [x] or [x, x2] without intercept, per curve."""
    c = curves if anchored else anchor(curves, by)
    c = c.filter(sc.within_range(F.col("x"), x_max, slack))
    x, f = F.col("x"), F.col("f")
    x2 = x * x
    g = c.groupBy(*by).agg(F.sum(x2).alias("a"), F.sum(x2 * x).alias("b"), F.sum(x2 * x2).alias("d"),
                           F.sum(x * f).alias("e"), F.sum(x2 * f).alias("g"))
    if not curved:
        return g.select(*by, (F.col("e") / F.col("a")).alias("theta_1"))
    t = mx.mul(mx.inverse([[F.col("a"), F.col("b")], [F.col("b"), F.col("d")]]), [[F.col("e")], [F.col("g")]])
    return g.select(*by, t[0][0].alias("theta_1"), t[1][0].alias("theta_2"))


def parameter_interval(params: DataFrame, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval and sd of per-replicate parameters."""
    a = (1 - level) / 2
    aggs = [F.count(F.lit(1)).alias("replicates")]
    for c in [c for c in params.columns if c.startswith("theta_")]:
        aggs += [F.percentile(c, F.lit(a)).alias(f"lo_{c[6:]}"), F.percentile(c, F.lit(1 - a)).alias(f"hi_{c[6:]}"),
                 F.stddev_samp(c).alias(f"sd_{c[6:]}")]
    return params.groupBy(*by).agg(*aggs)


def rmse_to_truth(curve: DataFrame, shape: str, theta1: Column, theta2: Column, by: Sequence[str] = (), x_max: float = X_MAX) -> DataFrame:
    """Root mean squared distance of anchored curves to the anchored truth on |x| <= x_max."""
    t = sc.dose_response(shape, F.col("x"), theta1, theta2) - sc.dose_response(shape, F.lit(0.0), theta1, theta2)
    d = F.col("f") - t
    return curve.filter(sc.within_range(F.col("x"), x_max)).groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse_truth"))


def rmse_to_clean(curves: DataFrame, runs: DataFrame, clean: str = "clean", x_max: float = X_MAX) -> DataFrame:
    """Distance of each scenario's curve to the clean run of the same dataset and seed, joined back
    onto the run table."""
    key = F.round("x", 6).alias("_x")
    base = curves.filter(F.col("scenario") == clean).select("dataset", "seed", key, F.col("f").alias("f_clean"))
    m = curves.withColumn("_x", F.round("x", 6)).filter(sc.within_range(F.col("x"), x_max)).join(base, ["dataset", "seed", "_x"])
    d = F.col("f") - F.col("f_clean")
    r = m.groupBy("scenario", "dataset", "seed").agg(F.sqrt(F.avg(d * d)).alias("rmse_clean"))
    return runs.join(r, ["scenario", "dataset", "seed"], "left")


def coefficient_curve(est: DataFrame, p: int, grid: tuple[float, float, int] = X_GRID, full_covariance: bool = True,
                      by: Sequence[str] = ()) -> DataFrame:
    """f = theta'b(x) with a 95% band from b'Vb. full_covariance=False keeps only the variances."""
    g = with_grid(est, grid)
    basis = [F.col("x"), F.col("x") * F.col("x")][:p]
    f = sum((F.col(f"theta_{i + 1}") * basis[i] for i in range(1, p)), F.col("theta_1") * basis[0])
    var = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            if full_covariance or i == j:
                var = var + basis[i] * basis[j] * F.col(f"v_{min(i, j) + 1}_{max(i, j) + 1}")
    half = F.lit(1.96) * F.sqrt(var)
    return g.select(*by, "k", "x", f.alias("f"), (f - half).alias("f_lo"), (f + half).alias("f_hi"))


def support_flag(curve: DataFrame, xhat_sd: DataFrame) -> DataFrame:
    """Mark points within twice the largest spread of the predicted exposure; the rest is
    extrapolation."""
    lim = xhat_sd.agg((F.lit(2.0) * F.max("xhat_sd")).alias("m")).scalar()
    return curve.withColumn("limit", lim).withColumn("supported", F.abs("x") <= F.col("limit"))


def average_slope(df: DataFrame, shape: str, theta1: Column, theta2: Column, by: Sequence[str] = ("site",), x: str = "x") -> DataFrame:
    """Mean derivative of the curve over observed x."""
    if shape == "quadratic":
        s = theta1 + 2 * theta2 * F.avg(x)
    elif shape == "threshold":
        s = theta1 * F.avg(F.when(F.col(x) < theta2, 1.0).otherwise(0.0))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return df.groupBy(*by).agg(s.alias("avg_slope"), F.count(F.lit(1)).alias("n"))
