"""Control-function and predictor-substitution curve fits over sites, as basis regressions.

    naive  outcome ~ f(x)
    2sri   outcome ~ f(x) + c (x - xhat)
    2sps   outcome ~ f(xhat)

f is a polynomial or a piecewise-linear basis; every site keeps its own intercept. Continuous
outcomes need one moment pass, binary ones a few reweighted passes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import matrix as mx
from sitefold.functions import scalars as sc
from sitefold.operators import iv
from sitefold.operators import moments as mo
from sitefold.runtime import cut, join_small

METHODS = ("naive", "2sri", "2sps")


def basis_columns(x: Column, degree: int = 2, knots: Sequence[float] = ()) -> list[Column]:
    """Powers of x up to degree, then one hinge per knot."""
    cols, power = [], F.lit(1.0)
    for _ in range(degree):
        power = power * x
        cols.append(power)
    return cols + [F.greatest(x - F.lit(float(k)), F.lit(0.0)) for k in knots]


def first_stage(train: DataFrame, rows: DataFrame, snps: Sequence[str], by: Sequence[str] = ("site",)) -> DataFrame:
    """Per-site first stage fitted on `train`, predicted on `rows`."""
    fs = cut(iv.local_first_stage(mo.moments(train, [*snps, "x"], by), snps))
    return iv.predict_rows(rows, fs, snps, list(by))


def first_stage_quality(rows: DataFrame, test: str = "is_test") -> DataFrame:
    """Test-split R2 of xhat and its spread on the training split, per site."""
    t = F.col(test)
    e2 = (F.col("x") - F.col("xhat")) * (F.col("x") - F.col("xhat"))
    xt = F.when(t, F.col("x"))
    return rows.groupBy("site").agg(
        (1 - F.sum(F.when(t, e2)) / (F.var_pop(xt) * F.count(xt))).alias("fs_r2"),
        F.stddev_samp(F.when(~t, F.col("xhat"))).alias("xhat_sd"), F.count(F.when(~t, 1)).alias("n_train"),
        F.count(F.when(t, 1)).alias("n_test"))


def design(rows: DataFrame, method: str, degree: int = 2, knots: Sequence[float] = ()) -> tuple[DataFrame, list[str]]:
    """Add columns b1.. (and resid) for a method; returns the rows and the regressor names."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    src = F.col("xhat" if method == "2sps" else "x")
    cols = basis_columns(src, degree, knots)
    names = [f"b{i + 1}" for i in range(len(cols))]
    out = rows.select("*", *[c.alias(n) for c, n in zip(cols, names)])
    if method == "2sri":
        out = out.withColumn("resid", F.col("x") - F.col("xhat"))
        names = [*names, "resid"]
    return out, names


def fit_continuous(rows: DataFrame, names: Sequence[str], by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Least squares with site intercepts, from summed within-site moments. Returns `coef` aligned
    with names (one row per group of `by`)."""
    m = mo.combine(mo.moments(rows, [*names, y], (*by, "site")), by)
    p = mx.project(mx.flat(mo.gram(names, names)), mx.flat(mo.gram(names, [y])))
    return m.select(*by, "n", "absorbed", p["coef"].alias("coef"))


def fit_binary(rows: DataFrame, names: Sequence[str], y: str = "y", max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """Logistic regression with site intercepts by reweighted least squares.

    Each pass is one aggregate per site; intercepts are eliminated site by site, so the solve is
    p x p whatever the number of sites. Sites whose outcomes are all alike say nothing about the slopes (their intercept has no
    finite value) and are left out; a fit that has not converged after `max_iter` passes is an error.
    """
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    base = mo.complete(rows, [*names, y]).select("site", *names, F.col(y).cast("double").alias("_y"))
    varied = base.groupBy("site").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).where("_lo < _hi").select("site")
    base = join_small(base, varied, ["site"], "left_semi")
    coef = np.zeros(p)
    alpha = None
    sites = None
    for _ in range(max_iter):
        src = base.withColumn("_a", F.lit(0.0)) if alpha is None else join_small(base, alpha, ["site"])
        z = F.col("_a")
        for b, c in zip(coef, names):
            z = z + F.lit(float(b)) * F.col(c)
        mu = sc.expit(z)
        w = mu * (1 - mu)
        g = F.col("_y") - mu
        aggs = [F.sum(w).alias("w"), F.sum(g).alias("g"), F.first("_a").alias("_a")]
        aggs += [F.sum(w * F.col(c)).alias(f"w{i}") for i, c in enumerate(names)]
        aggs += [F.sum(g * F.col(c)).alias(f"g{i}") for i, c in enumerate(names)]
        aggs += [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"w{i}_{j}") for i, j in pairs]
        sites = cut(src.groupBy("site").agg(*aggs))
        red = [F.sum(F.col(f"w{i}_{j}") - F.col(f"w{i}") * F.col(f"w{j}") / F.col("w")).alias(f"h{i}_{j}") for i, j in pairs]
        red += [F.sum(F.col(f"g{i}") - F.col(f"w{i}") * F.col("g") / F.col("w")).alias(f"r{i}") for i in range(p)]
        s = sites.agg(*red).first()
        h = np.empty((p, p))
        for i, j in pairs:
            h[i, j] = h[j, i] = s[f"h{i}_{j}"]
        step = np.linalg.solve(h, np.array([s[f"r{i}"] for i in range(p)]))
        shift = F.col("g")
        for i in range(p):
            shift = shift - F.col(f"w{i}") * F.lit(float(step[i]))
        alpha = sites.select("site", (F.col("_a") + shift / F.col("w")).alias("_a"))
        coef = coef + step
        if np.max(np.abs(step)) < tol:
            break
    else:
        raise ArithmeticError(f"no convergence in {max_iter} passes; the last changed a coefficient by {np.max(np.abs(step)):.3g}")
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return rows.sparkSession.createDataFrame([(n, float(b), float(s_)) for n, b, s_ in zip(names, coef, se)],
                                             "term string, beta double, se double")


def curve_from_coef(fits: DataFrame, n_basis: int, degree: int = 2, knots: Sequence[float] = (),
                    by: Sequence[str] = ()) -> DataFrame:
    """The causal-curve part of a fit on the x grid, zero at x = 0."""
    from sitefold.operators.curves import with_grid

    g = with_grid(fits)
    cols = basis_columns(F.col("x"), degree, knots)
    at0 = basis_columns(F.lit(0.0), degree, knots)
    f = F.lit(0.0)
    for i in range(n_basis):
        f = f + F.col("coef")[i] * (cols[i] - at0[i])
    return g.select(*by, "k", "x", f.alias("f"))


def calibrate_intercept(df: DataFrame, z: str, prevalence: float, lo: float = -20.0, hi: float = 20.0,
                        tol: float = 1e-6, points: int = 17) -> float:
    """Intercept a with mean(expit(a + z)) = prevalence. Each pass evaluates a whole grid of
    candidates in one aggregate and keeps the bracketing cell."""
    for _ in range(16):
        grid = np.linspace(lo, hi, points)
        aggs = [F.avg(sc.expit(F.lit(float(a)) + F.col(z))).alias(f"a{i}") for i, a in enumerate(grid)]
        means = np.array(df.agg(*aggs).first())
        best = int(np.argmin(np.abs(means - prevalence)))
        if abs(means[best] - prevalence) < tol:
            return float(grid[best])
        i = int(np.clip(np.searchsorted(means, prevalence), 1, points - 1))
        lo, hi = float(grid[i - 1]), float(grid[i])
    raise ArithmeticError(f"no intercept between {lo:.6g} and {hi:.6g} gives a mean of {prevalence} to {tol}")


def liability_labels(df: DataFrame, value: str, prevalence: float) -> DataFrame:
    """1 where the standardised liability exceeds its (1 - prevalence) quantile."""
    from sitefold.operators.ordered import exact_quantiles

    s = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).first()
    z = df.withColumn("z", (F.col(value) - F.lit(s["mean"])) / F.lit(s["sd"]))
    cut_at = exact_quantiles(z, "z", {"q": 1 - prevalence}).first()["q"]
    return z.withColumn("label", (F.col("z") > F.lit(cut_at)).cast("int"))
