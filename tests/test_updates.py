import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.operators import fedagg as fa
from sitefold.operators import privacy as pv


def frame(spark, u, w, rnd=0):
    return spark.createDataFrame(pd.DataFrame({"round": [rnd] * len(u), "site": [f"s{i:02d}" for i in range(len(u))],
                                               "vec": [list(map(float, v)) for v in u], "weight": np.asarray(w, float)})).withColumn("round", F.col("round").cast("int"))


def vec(long):
    return np.array([r["v"] for r in long.orderBy("j").collect()])


@pytest.fixture(scope="module")
def crowd():
    """Thirteen sites around a slope, the fourth with its sign turned and blown up."""
    rng = np.random.default_rng(17)
    u = np.linspace(-1, 1, 31) + 0.03 * rng.standard_normal((13, 31))
    u[3] *= -40
    return u, 50.0 + 37 * np.arange(13)


@pytest.mark.parametrize("rule", ["median", "trimmed_mean", "krum", "multi_krum", "geometric_median"])
def test_robust_rules_ignore_an_outlier(spark, crowd, rule):
    u, w = crowd
    opts = {"trim": 0.1} if rule == "trimmed_mean" else {}
    got, info = fa.aggregate(frame(spark, u, np.ones(13)), rule, **opts)
    assert np.abs(vec(got) - np.linspace(-1, 1, 31)).max() < 0.15
    flags = {r["site"]: r["flagged"] for r in info.collect()}
    assert flags["s03"]
    mean = vec(fa.aggregate(frame(spark, u, w), "fedavg")[0])
    np.testing.assert_allclose(mean, w @ u / w.sum(), rtol=1e-12)


def test_geometric_median_balances_the_pulls(spark, crowd):
    u, w = crowd
    z, shares = fa.geometric_median(frame(spark, u, w))
    assert brute.pull(u, w, np.array(z.first()["vec"])) < 1e-4
    assert {r["site"]: r["share"] for r in shares.collect()}["s03"] < 0.05


def test_distances_of_slices_and_tiles(spark, crowd, monkeypatch):
    """Several slices and tiles, two rounds of different size, a site alone."""
    monkeypatch.setattr(fa, "SLICE", 7)
    monkeypatch.setattr(fa, "SITE_TILE", 5)
    monkeypatch.setattr(fa, "MERGE_WAYS", 2)
    u, w = crowd
    both = frame(spark, u, w).unionByName(frame(spark, u[:4, :9] + 3, w[:4], 1)).unionByName(frame(spark, u[:1], w[:1], 2)).repartition(5)
    got = {(r["round"], r["site_i"], r["site_j"]): r["d2"] for r in fa.pairwise_distances(both).collect()}
    assert len(got) == 13 * 12 + 4 * 3
    for rnd, v in ((0, u), (1, u[:4, :9])):
        for i in range(len(v)):
            for j in range(len(v)):
                if i != j:
                    want = ((v[i] - v[j]) ** 2).sum()
                    assert abs(got[rnd, f"s{i:02d}", f"s{j:02d}"] - want) < 1e-9 * max(want, 1)
    scores = {(r["round"], r["site"]): r["krum_score"] for r in fa.krum_scores(both, 2).collect()}
    d = ((u[:, None] - u[None]) ** 2).sum(2)
    for i in range(13):
        assert abs(scores[0, f"s{i:02d}"] - np.sort(np.delete(d[i], i))[:9].sum()) < 1e-9 * d[i].max()
    assert len(scores) == 17
    with pytest.raises(Exception, match="differ in length"):
        fa.pairwise_distances(frame(spark, u, w).unionByName(frame(spark, u[:2, :5], w[:2]).withColumn("site", F.concat("site", F.lit("x"))))).collect()


def test_geometric_median_reports_its_steps(spark, crowd):
    u, w = crowd
    both = frame(spark, u, w).unionByName(frame(spark, u[:5], w[:5], 1))
    z, shares, report = fa.geometric_median_steps(both)
    assert all(r["converged"] and 1 < r["steps"] <= 100 and r["move"] < 1e-6 for r in report.collect()) and shares.count() == 18
    for r in z.collect():
        own = (u, w) if r["round"] == 0 else (u[:5], w[:5])
        assert brute.pull(*own, np.array(r["vec"])) < 1e-3
    with pytest.raises(ArithmeticError, match="geometric median"):
        fa.geometric_median(both, max_iter=1)
    assert not fa.geometric_median_steps(both, max_iter=1)[2].first()["converged"]


def test_medians_and_clipping_of_a_few_numbers(spark):
    values, heavy = [[-3.0], [1.0], [4.0], [6.0], [25.0]], [1.0, 1.0, 1.0, 9.0, 1.0]
    assert vec(fa.median(frame(spark, values, heavy)))[0] == 6.0 and vec(fa.median(frame(spark, values, np.ones(5))))[0] == 4.0 and vec(fa.weighted_median(frame(spark, values, heavy)))[0] == 6.0
    assert vec(fa.median(frame(spark, values[:4], np.ones(4))))[0] == 2.5
    got, info = fa.aggregate(frame(spark, values, np.ones(5)), "fedavg", 5.0)
    assert abs(vec(got)[0] - (-3 + 1 + 4 + 5 + 5) / 5) < 1e-12
    assert [r["clipped"] for r in info.orderBy("site").collect()] == [False, False, False, True, True]


def test_secure_sum_equals_weighted_mean_and_hides_messages(spark, crowd):
    u, w = crowd
    u = np.clip(u, -5, 5)
    df = frame(spark, u, w)
    m = pv.masked_messages(df, key=77, bits=24)
    np.testing.assert_allclose(vec(pv.unmask_sum(m)), w @ u / w.sum(), atol=1e-7)
    big = m.select((F.col("message") / F.lit(2.0**64)).alias("p")).toPandas().p.astype(float)
    assert 0.4 < big.mean() < 0.6 and big.max() > 0.95
    with pytest.raises(Exception, match="fixed-point"):
        df.select(sc.fixed_encode(F.col("weight") * 1e15, 40)).collect()


def test_incomplete_round_is_an_error(spark, crowd):
    u, w = crowd
    df = frame(spark, u, w)
    sites = df.select("site", F.col("weight").alias("n"))
    fa.require_complete(df, sites).collect()
    with pytest.raises(Exception, match="12 of 13 sites"):
        fa.require_complete(df.filter("site <> 's03'"), sites).collect()


def test_site_selection(spark):
    s = spark.createDataFrame([(name, size) for name, size in zip("pqrstuv", (40, 7, 93, 12, 55, 93, 1))], "site string, n int")
    assert sorted(r["site"] for r in fa.select_sites(s, 3).collect()) == ["r", "t", "u"]
    assert fa.select_sites(s, 3, "random", 5).collect() == fa.select_sites(s, 3, "random", 5).collect()
    with pytest.raises(ValueError, match="not in this federation"):
        fa.select_sites(s, 1, explicit=["nowhere"])


def test_settings_that_keep_no_promise_are_refused():
    assert fa.check_configuration(8) == [] and fa.withstands("median", 7) == 3
    assert "withstands 1 corrupt updates, not 2" in fa.check_configuration(21, rule="multi_krum", n_malicious=2)[0]
    assert len(fa.check_configuration(4, rule="krum")) == 1 and len(fa.check_configuration(9, dp_mode="distributed")) == 1
    for refused in (dict(rule="median", dp_mode="distributed"), dict(weights="reported", dp_mode="central"), dict(bound="adaptive", secure_sum=True), dict(secure_sum=True, frac_bits=4),
                    dict(rule="trimmed_mean", secure_sum=True), dict(trim=-0.1), dict(n_malicious=6), dict(weights="guessed"), dict(dp_mode="local", delta=1.0), dict(speed=3)):
        with pytest.raises(ValueError):
            fa.check_configuration(6, **refused)


def test_noise_is_repeatable_and_scaled(spark):
    df = frame(spark, np.zeros((4, 5000)), np.ones(4))
    plan = df.select("site").withColumn("client_sd", F.lit(0.5))
    a, b = (pv.add_noise(df.repartition(n), plan, 3).orderBy("site").toPandas().vec for n in (1, 3))
    np.testing.assert_array_equal(np.stack(a), np.stack(b))
    assert abs(np.stack(a).std() - 0.5) < 0.02 and abs(np.corrcoef(np.stack(a))[0, 1]) < 0.05


def test_distributed_noise_adds_up_to_the_central_noise(spark):
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "site string, w double")
    central = pv.noise_plan(w, "central", 2.0, 1.5).first()["server_sd"]
    p = pv.noise_plan(w, "distributed", 2.0, 1.5).toPandas()
    assert abs(np.sqrt(((p.w * p.client_sd) ** 2).sum()) - central) < 1e-12
    with pytest.raises(ValueError, match="mode"):
        pv.noise_plan(w, "none", 1.0, 1.0)


def test_shuffle_keeps_outcomes_paired(spark):
    p = pd.DataFrame({"site": [0] * 400 + [1] * 100, "id": range(500), "time": np.arange(500.0), "event": np.arange(500) % 2})
    got = pv.shuffle_outcomes(spark.createDataFrame(p), ["time", "event"], ["id"], 4).toPandas().sort_values("id")
    assert sorted(got.time) == sorted(p.time) and (got.time % 2 == got.event).all()
    assert (got.time.to_numpy() != p.time.to_numpy()).mean() > 0.9
    assert set(got[got.site == 1].time) == set(p[p.site == 1].time)
