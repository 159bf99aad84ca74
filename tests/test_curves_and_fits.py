import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.operators import bootstrap as bs
from sitefold.operators import controlfn as cf
from sitefold.operators import curves as cv
from sitefold.operators import metrics as me
from sitefold.operators import moments as mo


def test_interpolation_matches_numpy_inside_and_outside(spark):
    rng = np.random.default_rng(2)
    kx, kf = np.sort(rng.normal(size=9)), rng.normal(size=9)
    px = np.concatenate([np.linspace(-4, 4, 33), kx[[0, 4, 8]]])
    k = spark.createDataFrame(pd.DataFrame({"c": "a", "x": kx, "f": kf}))
    p = spark.createDataFrame(pd.DataFrame({"c": "a", "x": px}))
    got = cv.interpolate(k, p, ["c"]).toPandas().sort_values("x")
    np.testing.assert_allclose(got.f, np.interp(got.x, kx, kf), atol=1e-12)
    assert abs(cv.value_at(k, ["c"], 0.1).first()["f0"] - np.interp(0.1, kx, kf)) < 1e-12


@pytest.mark.parametrize("buckets", [1, 8, 40])
def test_points_of_one_curve_are_spread_over_all_tasks(spark, buckets, monkeypatch):
    """One curve with most of the points, half of them at one x; ranges without a knot; curves without points or knots; nulls."""
    monkeypatch.setattr(cv.od, "bucket_count", lambda df: buckets)
    rng = np.random.default_rng(buckets)
    kx, kf = np.array([-1.0, -0.9, 2.0, 2.5]), rng.normal(size=4)
    px = np.concatenate([rng.uniform(-3, 3, 800), np.full(800, 0.25), kx])
    k = spark.createDataFrame([("a", float(x), float(f)) for x, f in zip(kx, kf)] + [("b", 0.0, 7.0), ("c", 1.0, 1.0), ("a", None, 3.0)], "c string, x double, f double")
    p = spark.createDataFrame([("a", float(x)) for x in px] + [("b", 5.0), ("b", -5.0), ("d", 1.0), ("a", None)], "c string, x double")
    got = cv.interpolate(k, p, ["c"]).toPandas()
    assert len(got) == len(px) + 4
    a = got[(got.c == "a") & got.x.notna()].sort_values("x")
    np.testing.assert_allclose(a.x, np.sort(px))
    np.testing.assert_allclose(a.f, np.interp(np.sort(px), kx, kf), atol=1e-12)
    assert got[got.c == "b"].f.tolist() == [7.0, 7.0] and got[got.c == "d"].f.isna().all() and got[got.x.isna()].f.isna().all()
    if buckets == 8:
        assert cv.od.with_buckets(p.where("c = 'a' and x is not null").distinct(), ["c"], "x").select("_bucket").distinct().count() == 8


def test_band_of_linear_curves_and_its_anchoring(spark):
    slopes = -0.2 + np.random.default_rng(23).gamma(2.0, 0.1, 151)
    reps = spark.createDataFrame(pd.DataFrame({"rep": range(151), "theta_1": slopes}))
    band = cv.percentile_band(bs.replicate_curves(reps)).toPandas().sort_values("x")
    np.testing.assert_allclose(band.hi[band.x > 0], np.quantile(slopes, 0.975) * band.x[band.x > 0], rtol=1e-9)
    point = cv.with_grid(spark.range(1)).select(F.lit("s").alias("site"), F.lit(3).alias("round"), "x", (0.3 * F.col("x") + 1.7).alias("f"))
    early = point.withColumn("round", F.lit(0))
    out = cv.attach_band(point.unionByName(early), cv.percentile_band(bs.replicate_curves(reps))).toPandas()
    assert out[out["round"] == 0].f_lo.isna().all()
    last = out[out["round"] == 3].sort_values("x")
    np.testing.assert_allclose(last.f_lo - 1.7, band.lo, atol=1e-9)


def test_parameters_read_off_a_known_curve(spark):
    c = cv.with_grid(spark.range(1).withColumn("id", F.lit("a"))).select("id", "x", (0.3 * F.col("x") + 0.15 * F.col("x") ** 2 + 2).alias("f"))
    t = cv.read_parameters(c, ["id"], True).first()
    assert abs(t["theta_1"] - 0.3) < 1e-12 and abs(t["theta_2"] - 0.15) < 1e-12
    assert cv.rmse_to_truth(cv.anchor(c, ["id"]), "quadratic", F.lit(0.3), F.lit(0.15), ["id"]).first()["rmse_truth"] < 1e-12


def test_logistic_fit_zeroes_its_gradient(mr, pdf):
    rows, names = cf.design(mr.drop("y").withColumnRenamed("yb", "y"), "naive", 2)
    fit = {r["term"]: r["beta"] for r in cf.fit_binary(rows, names).collect()}
    x, y = pdf.x.to_numpy(), pdf.yb.to_numpy()
    eta = fit["b1"] * x + fit["b2"] * x * x
    grad = np.zeros(2)
    for s in pdf.site.unique():
        m = (pdf.site == s).to_numpy()
        a = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a + eta[m])))
            a += (y[m] - p).sum() / (p * (1 - p)).sum()
        grad += [(x[m] * (y[m] - p)).sum(), (x[m] ** 2 * (y[m] - p)).sum()]
    assert np.abs(grad).max() < 1e-5
    with pytest.raises(ValueError, match="method"):
        cf.design(mr, "3sls")


def test_logistic_fit_leaves_out_sites_of_one_class_and_says_when_it_fails(spark, mr):
    rows, names = cf.design(mr.drop("y").withColumnRenamed("yb", "y"), "naive", 1)
    want = cf.fit_binary(rows.where("site <> 2"), names).first()
    got = cf.fit_binary(rows.withColumn("y", F.when(F.col("site") == 2, 1).otherwise(F.col("y"))), names).first()
    assert abs(got["beta"] - want["beta"]) < 1e-9 and abs(got["se"] - want["se"]) < 1e-9
    with pytest.raises(ArithmeticError, match="convergence"):
        cf.fit_binary(rows, names, max_iter=2)
    with pytest.raises(ArithmeticError, match="intercept"):
        cf.calibrate_intercept(mr, "x", 0.2, lo=5.0, hi=6.0)


def test_residual_inclusion_equals_two_stage_slope(mr):
    rows = cf.first_stage(mr, mr, ["snp0", "snp1"])
    slopes = {}
    for method in ("2sri", "2sps"):
        r, names = cf.design(rows, method, 1)
        slopes[method] = cf.fit_continuous(r, names).first()["coef"][0]
    assert abs(slopes["2sri"] - slopes["2sps"]) < 1e-10


def test_prevalence_and_liability(mr, pdf):
    a = cf.calibrate_intercept(mr, "x", 0.2)
    assert abs((1 / (1 + np.exp(-(a + pdf.x)))).mean() - 0.2) < 1e-6
    lab = cf.liability_labels(mr, "y", 0.1).agg(F.avg("label")).first()[0]
    z = (pdf.y - pdf.y.mean()) / pdf.y.std(ddof=0)
    assert abs(lab - (z > np.quantile(z, 0.9)).mean()) < 1e-12


def test_poisson_replicates_are_weighted_moments(mr, pdf):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"]
    m = bs.replicate_moments(mr, ["x", "y"], ids, 3, 5)
    hashes = mr.select(F.xxhash64(F.lit(5), *ids).alias("h"), "site", "x", "y").toPandas()
    w = bs.poisson_weights(hashes.h.to_numpy().view(np.uint64), np.arange(3))
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.08
    for row in m.collect():
        k = (hashes.site == row["site"]).to_numpy()
        ww, x, y = w[row["rep"]][k], hashes.x[k], hashes.y[k]
        mx, my = np.average(x, weights=ww), np.average(y, weights=ww)
        assert row["n"] == ww.sum() and abs(row["m_x"] - mx) < 1e-10
        assert abs(row[mo.s_name("x", "y")] - (ww * (x - mx) * (y - my)).sum()) < 1e-7
    again = bs.replicate_moments(mr.repartition(7), ["x", "y"], ids, 3, 5)
    assert {(r["rep"], r["site"]): r["n"] for r in again.collect()} == {(r["rep"], r["site"]): r["n"] for r in m.collect()}


def exact_draws(spark, mr, n_boot, seed):
    rows = bs.multinomial_counts(mr, IDS, n_boot, seed).toPandas()
    return {(r.site, r.row): np.array(r.times) for r in rows.itertuples()}, rows


IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"]


def test_multinomial_replicates_draw_exactly_n(spark, mr, monkeypatch):
    monkeypatch.setattr(bs, "LEAF_ROWS", 64)
    times, rows = exact_draws(spark, mr, 40, 9)
    n = {r["site"]: r["count"] for r in mr.groupBy("site").count().collect()}
    w = np.stack(rows.times)
    for s in n:
        own = w[(rows.site == s).to_numpy()]
        assert len(own) == n[s] and (own.sum(0) == n[s]).all()
        # counts of a multinomial: mean 1, variance 1 - 1/n, rows uncorrelated but for the fixed total
        assert abs(own.var() - 1) < 0.05
        half = own[:n[s] // 2].sum(0)
        assert abs(half.mean() - n[s] // 2) < 4 * np.sqrt(n[s] / 4 / 40) and 0.4 < half.var() / (n[s] / 4) < 1.9
    again, _ = exact_draws(spark, mr.repartition(7), 40, 9)
    assert all((again[k] == v).all() for k, v in times.items())
    other, _ = exact_draws(spark, mr, 40, 10)
    assert not all((other.get(k, np.zeros(40)) == v).all() for k, v in times.items())
    assert bs.draws(mr.limit(0), IDS, 3).collect() == []
    assert {(r["rep"], r["site"], r["draws"]) for r in bs.draws(mr, IDS, 3).collect()} == {(b, s, k) for b in range(3) for s, k in n.items()}


@pytest.mark.parametrize("method", cf.METHODS)
@pytest.mark.parametrize("degree, knots", [(1, ()), (2, ()), (1, (2.5,))])
def test_curved_replicates_are_weighted_two_stage_fits(spark, mr, method, degree, knots, monkeypatch):
    monkeypatch.setattr(bs, "LEAF_ROWS", 256)
    times, _ = exact_draws(spark, mr, 3, 4)
    p = mr.select("site", "snp0", "snp1", "x", "y", F.xxhash64(F.lit(4), *IDS).alias("h")).toPandas()
    w = np.stack([times[s, h] for s, h in zip(p.site, p.h)])
    got = {r["rep"]: r["coef"] for r in bs.curve_replicates(mr, ["snp0", "snp1"], IDS, 3, method, degree, knots, 4).collect()}
    for rep in range(3):
        a, c = 0.0, 0.0
        for s in p.site.unique():
            k = (p.site == s).to_numpy()
            own, q = np.sqrt(w[k, rep])[:, None], p[k]
            z = np.column_stack([np.ones(len(q)), q.snp0, q.snp1])
            xhat = z @ np.linalg.lstsq(z * own, q.x * own[:, 0], rcond=None)[0]
            src = xhat if method == "2sps" else q.x.to_numpy()
            d = np.column_stack([*(src ** j for j in range(1, degree + 1)), *(np.maximum(src - t, 0) for t in knots), *([q.x - xhat] if method == "2sri" else [])])
            mean = lambda v: (w[k, rep] @ v) / w[k, rep].sum()
            d, y = d - mean(d), q.y - mean(q.y)
            a, c = a + (d * own).T @ (d * own), c + (d * own).T @ (y * own[:, 0])
        np.testing.assert_allclose(got[rep], np.linalg.solve(a, c), rtol=1e-6, atol=1e-9)


def test_methods_share_the_rows_and_their_draws(mr, monkeypatch):
    calls = []
    for name in ("leaves", "_summed"):
        def counted(*args, _name=name, _run=getattr(bs, name)):
            calls.append(_name)
            return _run(*args)
        monkeypatch.setattr(bs, name, counted)
    together = bs.curves_by_method(mr, ["snp0", "snp1"], IDS, 3, degree=2, seed=4)
    assert calls.count("leaves") == 1 and calls.count("_summed") == 2
    for method, fits in together.items():
        alone = {r["rep"]: r["coef"] for r in bs.curve_replicates(mr, ["snp0", "snp1"], IDS, 3, method, 2, (), 4).collect()}
        got = {r["rep"]: r["coef"] for r in fits.collect()}
        assert sorted(got) == sorted(alone) == [0, 1, 2]
        for rep in got:
            np.testing.assert_allclose(got[rep], alone[rep], rtol=1e-9)
