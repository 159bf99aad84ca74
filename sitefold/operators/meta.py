"""Combining one estimate per site: fixed and random effects, heterogeneity, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import matrix as mx
from sitefold.functions import tails
from sitefold.runtime import scalar_row

Z95 = 1.96


def inverse_variance(est: DataFrame, theta: str = "theta", se: str = "se", by: Sequence[str] = ()) -> DataFrame:
    """Fixed-effect mean, its standard error, 95% interval and Cochran Q in one aggregate.

    Q = sum w t^2 - (sum w t)^2 / sum w, taken around the plain mean so nothing large cancels.
    """
    w = F.lit(1.0) / (F.col(se) * F.col(se))
    t = F.col(theta)
    agg = est.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sites"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * t).alias("_wt"),
        (F.covar_pop(F.sqrt(w) * t, F.sqrt(w) * t) * F.count(F.lit(1)) +
         F.pow(F.avg(F.sqrt(w) * t), 2.0) * F.count(F.lit(1))).alias("_wtt"))
    meta, meta_se = F.col("_wt") / F.col("_w"), F.sqrt(F.lit(1.0) / F.col("_w"))
    return agg.select(*by, "sites", meta.alias("meta"), meta_se.alias("meta_se"), (meta - Z95 * meta_se).alias("lo"),
                      (meta + Z95 * meta_se).alias("hi"),
                      F.greatest(F.col("_wtt") - F.col("_wt") * F.col("_wt") / F.col("_w"), F.lit(0.0)).alias("q"),
                      F.col("_w").alias("sum_w"), F.col("_w2").alias("sum_w2"))


def cochran_q(est: DataFrame, theta: str = "theta", se: str = "se") -> DataFrame:
    """Two-step Q: every site's weighted squared distance from the combined estimate."""
    fixed = scalar_row(inverse_variance(est, theta, se).select("meta"))
    d = F.col(theta) - fixed["meta"]
    return est.agg(F.sum(d * d / (F.col(se) * F.col(se))).alias("q"), (F.count(F.lit(1)) - 1).alias("df"))


def random_effects(est: DataFrame, theta: str = "theta", se: str = "se", with_p: bool = True) -> DataFrame:
    """DerSimonian-Laird: Q, I2, tau2, random-effects mean and a prediction interval."""
    v = F.col(se) * F.col(se)
    fixed = inverse_variance(est, theta, se).select("meta", "meta_se", "sites", "sum_w", "sum_w2")
    q = cochran_q(est, theta, se).select("q")
    f, qr = scalar_row(fixed), scalar_row(q)
    base = est.withColumn("_f", f).withColumn("_q", qr["q"])
    df = F.col("_f.sites") - 1
    tau2 = F.when(df > 0, F.greatest(F.lit(0.0), (F.col("_q") - df) /
                                     (F.col("_f.sum_w") - F.col("_f.sum_w2") / F.col("_f.sum_w")))).otherwise(0.0)
    base = base.withColumn("_tau2", tau2)
    wr = F.lit(1.0) / (v + F.col("_tau2"))
    out = base.agg(F.first("_f.meta").alias("fe"), F.first("_f.meta_se").alias("fe_se"),
                   (F.sum(wr * F.col(theta)) / F.sum(wr)).alias("re"), F.sqrt(F.lit(1.0) / F.sum(wr)).alias("re_se"),
                   F.first("_q").alias("q"), F.first(df).alias("df"), F.first("_tau2").alias("tau2"))
    out = out.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q")))
                         .otherwise(0.0)).withColumn("tau", F.sqrt("tau2"))
    if with_p:
        t = F.when(F.col("df") > 1, tails.t_ppf(F.lit(0.975), F.greatest(F.col("df") - 1, F.lit(1)).cast("double"))).otherwise(Z95)
        half = t * F.sqrt(F.col("tau2") + F.col("re_se") * F.col("re_se"))
        out = (out.withColumn("p", F.when(F.col("df") > 0, tails.chi2_sf("q", F.col("df").cast("double"))))
               .withColumn("pi_lo", F.col("re") - half).withColumn("pi_hi", F.col("re") + half))
    return out


def matrix_meta(est: DataFrame, p: int, power: float = 1.0) -> DataFrame:
    """Inverse-covariance combination of vector estimates theta_1.. with covariances v_i_j (p <= 2).

    power tempers the site weights: 1 is inverse-covariance weighting, 0 gives every site the same
    total precision while keeping the shape of its covariance.
    """
    v = [[F.col(f"v_{min(i, j)}_{max(i, j)}") for j in range(1, p + 1)] for i in range(1, p + 1)]
    w = mx.inverse(v)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    base = est.select(*[f"theta_{i + 1}" for i in range(p)], *[w[i][j].alias(f"w_{i}_{j}") for i, j in cells])
    trace = F.col("w_0_0") + (F.col("w_1_1") if p == 2 else F.lit(0.0))
    base = base.withColumn("_trace", trace)
    mean_trace = scalar_row(base.agg(F.avg("_trace").alias("t")))["t"]
    base = base.withColumn("_k", F.pow(mean_trace / F.col("_trace"), F.lit(1.0 - power)))

    def wc(i, j):
        return F.col(f"w_{min(i, j)}_{max(i, j)}") * F.col("_k")

    aggs = [F.count(F.lit(1)).alias("sites")] + [F.sum(wc(i, j)).alias(f"w_{i}_{j}") for i, j in cells]
    for i in range(p):
        aggs.append(F.sum(sum((wc(i, j) * F.col(f"theta_{j + 1}") for j in range(1, p)),
                              wc(i, 0) * F.col("theta_1"))).alias(f"wt_{i}"))
    s = base.agg(*aggs)
    cov = mx.inverse([[F.col(f"w_{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)])
    theta = mx.mul(cov, mx.col_vector([F.col(f"wt_{i}") for i in range(p)]))
    return s.select("sites", *[theta[i][0].alias(f"theta_{i + 1}") for i in range(p)],
                    *[F.sqrt(F.greatest(cov[i][i], F.lit(0.0))).alias(f"se_{i + 1}") for i in range(p)])


def weighted_target(sites: DataFrame, n: str = "n", slope: str = "avg_slope") -> DataFrame:
    return sites.agg((F.sum(F.col(n) * F.col(slope)) / F.sum(n)).alias("target"), F.sum(n).alias("n"))


def covered(theta: Column, se: Column, target: Column) -> Column:
    return (theta - Z95 * se <= target) & (target <= theta + Z95 * se)
