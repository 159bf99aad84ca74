"""Prediction metrics and the scoring tables built from run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.operators import ordered as od

ROUTE_Z = 1.96


def regression(df: DataFrame, pred: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                               (1 - F.try_divide(F.sum(e * e), F.regr_sxx(F.lit(1.0), F.col(y)))).alias("r2"))


def classification(df: DataFrame, prob: str, y: str, by: Sequence[str] = (), cutoff: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a cutoff; an undefined ratio is 0."""
    pred = F.col(prob) >= F.lit(cutoff)
    pos = F.col(y) == 1

    def count(c):
        return F.sum(c.cast("bigint"))

    g = df.groupBy(*by).agg(count(pred & pos).alias("tp"), count(pred & ~pos).alias("fp"), count(~pred & pos).alias("fn"),
                            count(pred == pos).alias("ok"), F.count(F.lit(1)).alias("n"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*by, "n", (F.col("ok") / F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def membership_auc(df: DataFrame, out_global: Column, out_observed: Column, y: str, member: str, binary: bool,
                   by: Sequence[str] = ()) -> DataFrame:
    """AUC of (loss under the global model - loss under the observed model), members vs the rest."""
    loss = sc.logistic_loss if binary else sc.squared_error
    scored = df.select(*by, (loss(out_global, F.col(y)) - loss(out_observed, F.col(y))).alias("_s"), F.col(member).cast("int").alias("_m"))
    return od.auc(scored, "_s", "_m", by)


def weighted_means(metrics: DataFrame, cols: Sequence[str], by: Sequence[str] = ("round", "stage"), weight: str = "n_test") -> DataFrame:
    w = F.col(weight)
    return metrics.groupBy(*by).agg(*[(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in cols])


def scenario_summary(runs: DataFrame, cols: Sequence[str], firsts: Sequence[str], by: Sequence[str] = ("suite", "scenario", "dataset"),
                     order: str = "seed") -> DataFrame:
    """Mean and sample sd per scenario; `firsts` come from the run with the smallest seed."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    aggs += [F.min_by(c, order).alias(c) for c in firsts]
    return runs.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_seeds"))


def sweep_summary(rows: DataFrame, by: Sequence[str] = ("axis", "level", "estimator")) -> DataFrame:
    err = F.col("est") - F.col("target")
    inside = (F.col("est") - ROUTE_Z * F.col("se") <= F.col("target")) & (F.col("target") <= F.col("est") + ROUTE_Z * F.col("se"))
    return rows.groupBy(*by).agg(
        F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg("se").alias("mean_se"),
        F.avg(inside.cast("double")).alias("coverage"), F.max("identity_diff").alias("identity_max"),
        F.avg("first_stage_F").alias("mean_F"), F.count(F.lit(1)).alias("seeds"))


def route_summary(rows: DataFrame, routes: Sequence[str], target: float) -> DataFrame:
    """Unpivot route columns (est, est_se) and score each against the target."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.col(r).alias("est"), F.col(f"{r}_se").alias("se"))
                                           for r in routes])).alias("e")).select("e.*")
    e = F.col("est") - F.lit(target)
    return long.groupBy("route").agg(
        F.avg("est").alias("mean"), F.avg(e).alias("bias"), F.stddev_samp("est").alias("sd"), F.avg("se").alias("mean_se"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.abs(e) <= ROUTE_Z * F.col("se")).cast("double")).alias("coverage"),
        F.count(F.lit(1)).alias("draws"))


def detection_rates(log: DataFrame, start_round: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Share of site-rounds flagged among malicious and honest sites from a start round on."""
    f = F.col("flagged").cast("double")
    return log.filter(F.col("round") >= start_round).groupBy(*by).agg(
        F.avg(F.when(F.col("malicious") == 1, f)).alias("tpr"), F.avg(F.when(F.col("malicious") == 0, f)).alias("fpr"),
        F.count(F.lit(1)).alias("site_rounds"))


def pivot_scenarios(summary: DataFrame, value: str, defenses: Sequence[str]) -> DataFrame:
    """attack x defense matrix from 'attack|defense' scenario names."""
    parts = F.split("scenario", "\\|")
    return (summary.filter(F.col("scenario").contains("|")).withColumn("attack", parts[0]).withColumn("defense", parts[1])
            .groupBy("attack").pivot("defense", list(defenses)).agg(F.first(value)))


def scenario_level(col: str = "scenario") -> Column:
    """Numeric level behind '_z' in a scenario name, null where there is none."""
    s = F.regexp_extract(col, r"_z([0-9.]+)$", 1)
    return F.when(s != "", s.cast("double"))


def manifest_rollup(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"), F.sum("events").alias("events"),
                     F.avg("h2_x").alias("h2_x"), F.avg("gamma_x").alias("gamma_x"), F.avg("gamma_y").alias("gamma_y"))


def ordered_scenarios(summary: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort by a given scenario order, unknown names last and alphabetically."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("scenario"))
    return summary.orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), "scenario")
