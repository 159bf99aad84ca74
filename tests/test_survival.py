import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.operators import survival as sv


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    n = 260
    p = pd.DataFrame({"site": rng.choice(3, n, p=[0.7, 0.2, 0.1]).astype("int32"), "snp0": rng.integers(0, 3, n).astype("int32"), "x": np.round(rng.normal(size=n), 1),
                      "u": np.round(rng.normal(size=n), 1)})
    t = rng.exponential(np.exp(-0.4 * p.x - 0.3 * p.snp0 - 0.5 * p.u)) * 10
    p["time"] = np.minimum(np.ceil(t), 25.0)
    p["event"] = ((t <= 25) & (rng.random(n) < 0.8)).astype("int32")
    return p


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_hazard_regression_equals_explicit_risk_sets(spark, small, ties):
    df = spark.createDataFrame(small)
    got = {r["term"]: r for r in sv.cox(df, ["x", "u"], ["site"], ties=ties).collect()}
    b, se = brute.cox(small[["x", "u"]], small.time.to_numpy(), small.event.to_numpy(), small.site.to_numpy(), ties)
    for i, c in enumerate(("x", "u")):
        assert abs(got[c]["beta"] - b[i]) < 1e-8 and abs(got[c]["se"] - se[i]) < 1e-8


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_per_instrument_hazards_equal_single_fits(spark, small, ties):
    got = {r["site"]: r for r in sv.cox_gwas(spark.createDataFrame(small), ["snp0"], ties=ties).collect()}
    for s, part in small.groupby("site"):
        b, se = brute.cox(part[["snp0"]], part.time.to_numpy(), part.event.to_numpy(), np.zeros(len(part)), ties)
        assert abs(got[s]["beta"] - b[0]) < 1e-8 and abs(got[s]["se"] - se[0]) < 1e-8


def test_routes_match_their_single_fits(spark, small):
    rows = small.assign(xhat=small.x * 0.5 + small.snp0 * 0.1)
    got = {r["route"]: r["beta"] for r in sv.route_comparison(spark.createDataFrame(rows)).collect()}
    flat = np.zeros(len(rows))
    rows["resid"] = rows.x - rows.xhat
    for name, cols in (("naive", ["x"]), ("2SPS", ["xhat"]), ("2SRI", ["x", "resid"]), ("oracle", ["x", "u"])):
        b, _ = brute.cox(rows[cols], rows.time.to_numpy(), rows.event.to_numpy(), flat, "efron")
        assert abs(got[name] - b[0]) < 1e-7, name


def test_partial_likelihood_and_no_events(spark, small):
    p = small.assign(h=0.3 * small.x)
    t, e, h = p.time.to_numpy(), p.event.to_numpy(), p.h.to_numpy()
    want = -np.mean([h[i] - np.log(np.exp(h[t >= t[i]]).sum()) for i in np.flatnonzero(e)])
    assert abs(sv.partial_likelihood(spark.createDataFrame(p), "h").first()["loss"] - want) < 1e-10
    assert sv.partial_likelihood(spark.createDataFrame(p.assign(event=0)), "h").first()["loss"] == 0.0


def test_concordance_counts_every_comparable_pair(spark, small):
    t, e, h = small.time.to_numpy(), small.event.to_numpy(), small.x.to_numpy()
    comp = (e[:, None] == 1) & ((t[None, :] > t[:, None]) | ((t[None, :] == t[:, None]) & (e[None, :] == 0)))
    good = (comp & (h[:, None] > h[None, :])).sum() + 0.5 * (comp & (h[:, None] == h[None, :])).sum()
    got = sv.concordance(spark.createDataFrame(small), "x").first()
    assert got["pairs"] == comp.sum() and abs(got["c_index"] - good / comp.sum()) < 1e-12


def test_unknown_tie_rule(spark, small):
    with pytest.raises(ValueError, match="ties"):
        sv.cox(spark.createDataFrame(small), ["x"], ties="exact")


def test_one_huge_tie_is_summed_exactly():
    """Efron sums of ties far larger than the explicit part, up to everyone at risk failing at once."""
    cases = ((1, 5.0, 0.4), (17, 40.0, 12.0), (500, 900.0, 430.0), (4000, 3111.0, 3111.0), (30000, 2.0e7, 1.9e4))
    got = sv.tie_sums(*(np.array(c) for c in zip(*cases)), "efron")
    for k, (d, s0, e0) in enumerate(cases):
        q = s0 - np.arange(d) / d * e0
        np.testing.assert_allclose([g[k] for g in got], [(1 / q).sum(), (1 / q**2).sum(), np.log(q).sum()], rtol=1e-11)


def test_heavily_tied_times(spark):
    rng = np.random.default_rng(8)
    n = 400
    p = pd.DataFrame({"x": rng.normal(size=n).round(2), "snp0": rng.integers(0, 3, n), "site": 0})
    p["time"] = np.where(rng.random(n) < 0.5, 3.0, rng.integers(1, 6, n)).astype(float)
    p["event"] = (rng.random(n) < 0.8).astype(int)
    b, se = brute.cox(p[["x"]], p.time.to_numpy(), p.event.to_numpy(), np.zeros(n), "efron")
    got = sv.cox(spark.createDataFrame(p), ["x"]).first()
    assert abs(got["beta"] - b[0]) < 1e-9 and abs(got["se"] - se[0]) < 1e-9
    b, se = brute.cox(p[["snp0"]], p.time.to_numpy(), p.event.to_numpy(), np.zeros(n), "efron")
    got = sv.cox_gwas(spark.createDataFrame(p), ["snp0"]).first()
    assert abs(got["beta"] - b[0]) < 1e-9 and abs(got["se"] - se[0]) < 1e-9


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_imputed_dosages_and_missing_ones(spark, small, ties, monkeypatch):
    """Any dosage, as columns or packed, with rows that lack one, over several passes and many partitions."""
    rng = np.random.default_rng(9)
    p = small.assign(a=small.snp0 + rng.normal(size=len(small)) * 0.2, flat=1.0)
    missing = rng.random(len(p)) < 0.2
    df = spark.createDataFrame(p.assign(id=range(len(p)))).withColumn("b", F.when(~F.col("id").isin(np.flatnonzero(missing).tolist()), F.col("a") * F.col("u")))
    monkeypatch.setattr(sv, "MODELS", 2)
    got = {(r["site"], r["snp"]): r for r in sv.cox_gwas(df, ["a", "b", "flat"], ties=ties).collect()}
    packed = {(r["site"], r["snp"]): r for r in sv.cox_gwas(df.withColumn("g", F.array("a", "b")), 2, ties=ties).collect()}
    assert len(got) == 9 and len(packed) == 6
    for s, part in p.groupby("site"):
        b, se = brute.cox(part[["a"]], part.time.to_numpy(), part.event.to_numpy(), np.zeros(len(part)), ties)
        some = part[~missing[part.index]]
        c, sc = brute.cox((some.a * some.u).to_frame(), some.time.to_numpy(), some.event.to_numpy(), np.zeros(len(some)), ties)
        for name, want, err, k in (("a", b[0], se[0], 0), ("b", c[0], sc[0], 1)):
            for r in (got[s, name], packed[s, f"snp{k}"]):
                assert r["converged"] and abs(r["beta"] - want) < 1e-8 and abs(r["se"] - err) < 1e-8
        assert got[s, "flat"]["beta"] is None and got[s, "flat"]["se"] is None


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ties_and_strata_that_span_partitions(spark, parts, monkeypatch):
    """One time holds half of the rows, one stratum most of them; packs of few rows."""
    rng = np.random.default_rng(parts)
    n = 500
    p = pd.DataFrame({"x": rng.normal(size=n).round(3), "u": rng.normal(size=n).round(3), "site": rng.choice(4, n, p=[.85, .05, .05, .05]), "id": range(n)})
    p["time"] = np.where(rng.random(n) < 0.5, 3.0, rng.integers(1, 6, n)).astype(float)
    p["event"] = (rng.random(n) < 0.6).astype(int)
    monkeypatch.setattr(sv.od, "bucket_count", lambda df: parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(p)
        rows = sv._dealt(df, F.array("x"), 1 << 20, ["site"], "time", "event")
        assert rows.count() > 20
        for strata, codes in (([], np.zeros(n)), (["site"], p.site.to_numpy())):
            for ties in sv.TIES:
                b, se = brute.cox(p[["x", "u"]], p.time.to_numpy(), p.event.to_numpy(), codes, ties)
                got = {r["term"]: r for r in sv.cox(df, ["x", "u"], strata, ties=ties).collect()}
                assert all(abs(got[c]["beta"] - b[i]) < 1e-8 and abs(got[c]["se"] - se[i]) < 1e-8 for i, c in enumerate(("x", "u")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_loss_of_any_spread(spark, small):
    """Log hazards 2,000 apart: what is at risk late is tiny beside what was at risk early."""
    three = spark.createDataFrame([(1.0, 1, 1000.0), (2.0, 1, 0.0), (3.0, 0, 1.0)], "time double, event int, h double")
    want = -np.mean([0.0, 0.0 - np.log(np.exp(0.0) + np.exp(1.0))])
    assert abs(sv.partial_likelihood(three, "h").first()["loss"] - want) < 1e-12
    rng = np.random.default_rng(1)
    p = small.assign(h=rng.uniform(-1000, 1000, len(small)))
    for strata in ([], ["site"]):
        want = []
        for i in np.flatnonzero(p.event):
            at = (p.time >= p.time[i]) & ((p.site == p.site[i]) if strata else True)
            want.append(np.logaddexp.reduce(p.h[at]) - p.h[i])
        got = sv.partial_likelihood(spark.createDataFrame(p), "h", strata).first()
        assert abs(got["loss"] - np.mean(want)) < 1e-9 * np.mean(want) and got["events"] == len(want)


def test_loss_of_large_hazards_and_a_fit_that_does_not_converge(spark, small):
    df = spark.createDataFrame(small)
    plain = sv.partial_likelihood(df, "x", ["site"]).first()["loss"]
    assert abs(sv.partial_likelihood(df.withColumn("big", F.col("x") + 900.0), "big", ["site"]).first()["loss"] - plain) < 1e-9
    with pytest.raises(ArithmeticError, match="convergence"):
        sv.cox(df, ["x"], ["site"], max_iter=1)
