import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.operators import iv
from sitefold.operators import moments as mo
from sitefold.plans import fixtures as fx
from sitefold.sources import sites as src

SNPS = ["snp0", "snp1"]


def by_term(run):
    return {r["term"]: r for r in run.estimates().collect()}


def close(a, b, tol=1e-10):
    assert abs(a - b) < tol * max(1.0, abs(b)), (a, b)


def test_shared_linear_with_covariate_equals_stacked_rows(mr, pdf):
    d = brute.dummies(pdf.site.to_numpy())
    z = np.column_stack([pdf[SNPS], pdf[["c1"]], d]).astype(float)
    w = np.column_stack([pdf[["x", "c1"]], d]).astype(float)
    theta, se, rob = brute.tsls(z, w, pdf.y.to_numpy())
    got = by_term(iv.shared_instruments(mr, SNPS, ["c1"]))
    for i, t in enumerate(("x", "c1")):
        close(got[t]["theta"], theta[i])
        close(got[t]["se"], se[i])
        close(got[t]["robust_se"], rob[i])


@pytest.mark.parametrize("basis", ["linear", "quadratic"])
@pytest.mark.parametrize("covariates", [[], ["c1"]])
def test_local_first_stages_equal_stacked_rows(mr, pdf, basis, covariates):
    d = brute.dummies(pdf.site.to_numpy())
    xh = brute.xhat_by_site(pdf, SNPS + covariates)
    x = pdf.x.to_numpy()
    zc = [xh] if basis == "linear" else [xh, xh**2]
    wc = [x] if basis == "linear" else [x, x**2]
    extra = [pdf[c].to_numpy() for c in covariates]
    theta, se, rob = brute.tsls(np.column_stack(zc + extra + [d]), np.column_stack(wc + extra + [d]), pdf.y.to_numpy())
    got = by_term(iv.local_first_stages(mr, SNPS, covariates, basis=basis))
    for i, t in enumerate(["x", "x2"][: len(wc)] + covariates):
        close(got[t]["theta"], theta[i], 1e-8 if basis == "quadratic" else 1e-10)
        close(got[t]["se"], se[i], 1e-8)
        close(got[t]["robust_se"], rob[i], 1e-8)


def test_shared_quadratic_uses_one_global_first_stage(mr, pdf):
    d = brute.dummies(pdf.site.to_numpy())
    zz = np.column_stack([pdf[SNPS].to_numpy(float), d])
    xh = zz @ np.linalg.lstsq(zz, pdf.x.to_numpy(), rcond=None)[0]
    x = pdf.x.to_numpy()
    theta, se, _ = brute.tsls(np.column_stack([xh, xh**2, d]), np.column_stack([x, x**2, d]), pdf.y.to_numpy())
    got = by_term(iv.shared_instruments(mr, SNPS, basis="quadratic", robust=False))
    close(got["x"]["theta"], theta[0], 1e-8)
    close(got["x2"]["se"], se[1], 1e-8)


@pytest.mark.parametrize("basis", ["linear", "quadratic"])
def test_local_crossfit_predicts_each_fold_from_the_others(mr, pdf, basis):
    xh = np.empty(len(pdf))
    for s in pdf.site.unique():
        for f in range(5):
            tr = ((pdf.site == s) & (pdf.fold != f)).to_numpy()
            te = ((pdf.site == s) & (pdf.fold == f)).to_numpy()
            z = np.column_stack([np.ones(tr.sum()), pdf.loc[tr, SNPS]])
            c = np.linalg.lstsq(z, pdf.x[tr].to_numpy(), rcond=None)[0]
            xh[te] = np.column_stack([np.ones(te.sum()), pdf.loc[te, SNPS]]) @ c
    d, x = brute.dummies(pdf.site.to_numpy()), pdf.x.to_numpy()
    zc, wc = ([xh], [x]) if basis == "linear" else ([xh, xh**2], [x, x**2])
    theta, se, rob = brute.tsls(np.column_stack(zc + [d]), np.column_stack(wc + [d]), pdf.y.to_numpy())
    got = by_term(iv.local_first_stages(mr, SNPS, basis=basis, crossfit=5))
    close(got["x"]["theta"], theta[0], 1e-8)
    close(got["x"]["se"], se[0], 1e-8)
    close(got["x"]["robust_se"], rob[0], 1e-8)


def test_shared_crossfit_solves_its_estimating_equation(mr):
    run = iv.shared_instruments(mr, SNPS, crossfit=5, robust=False)
    theta = run.estimates().first()["theta"]
    assert run.rounds == 2 and iv.shared_instruments(mr, SNPS, crossfit=5).rounds == 3
    m = mo.moments(mr, [*SNPS, "x"], ("site", "fold"))
    rows = iv.predict_rows(mr, iv.leave_fold_out_shared(m, SNPS).checkpoint(), SNPS, ("site", "fold"))
    u = iv.residual_orthogonality(rows, theta).first()["xhat"]
    scale = rows.agg(F.sum(F.abs(F.col("xhat") * F.col("y")))).first()[0]
    assert abs(u) < 1e-10 * scale


def test_first_stage_f_is_the_nested_regression_f(mr, pdf):
    d = brute.dummies(pdf.site.to_numpy())
    x = pdf.x.to_numpy()
    full = np.column_stack([pdf[SNPS].to_numpy(float), d])

    def rss(z):
        return float(((x - z @ np.linalg.lstsq(z, x, rcond=None)[0]) ** 2).sum())

    f = ((rss(d) - rss(full)) / 2) / (rss(full) / (len(x) - full.shape[1]))
    got = iv.shared_instruments(mr, SNPS, robust=False).fitted.select("iv.fs_f", "iv.fs_df2").first()
    close(got["fs_f"][0], f, 1e-9)
    assert got["fs_df2"] == len(x) - 2 - 5


def test_result_does_not_depend_on_partitioning_or_site_order(mr):
    a = iv.local_first_stages(mr, SNPS, robust=False).estimates().first()["theta"]
    shuffled = mr.repartition(13).sortWithinPartitions(F.col("y").desc())
    assert abs(iv.local_first_stages(shuffled, SNPS, robust=False).estimates().first()["theta"] - a) < 1e-12


def test_moment_table_round_trip(mr, spark, tmp_path):
    d = iv.shared_design(SNPS)
    m = mo.moments(mr, d.columns)
    src.write_moments(m, str(tmp_path / "m"))
    a = iv.tidy(iv.fit(mo.combine(m), d), d).first()["theta"]
    back = src.read_moments(spark, str(tmp_path / "m"))
    assert abs(iv.tidy(iv.fit(mo.combine(back), d), d).first()["theta"] - a) < 1e-13


def test_expression_shifted_and_blocked_moments_agree(mr):
    cols = ["snp0", "snp1", "x", "y", "c1", "u"]
    a = mo.moments(mr, cols).orderBy("site").toPandas()
    b = mo.moments_blocked(mr, cols).orderBy("site").toPandas()
    c = mo.moments(mr, cols, origin=mo.centres(mo.moments(mr, cols))).orderBy("site").toPandas()
    for name in a.columns:
        np.testing.assert_allclose(b[name], a[name], rtol=1e-10, atol=1e-9)
        np.testing.assert_allclose(c[name], a[name], rtol=1e-10, atol=1e-9)


def test_oracle_columns_are_refused(mr):
    with pytest.raises(ValueError, match="oracle"):
        iv.shared_design(SNPS, ["u"])
    with pytest.raises(ValueError, match="oracle"):
        src.select_covariates(mr, ["u"])


def test_under_identified_and_collinear_designs_say_why(mr):
    d = iv.Design(("snp0",), ("x", "x2"))
    rows = mr.withColumn("x2", F.col("x") * F.col("x")).withColumn("copy", F.col("snp0") * 2)
    assert "under-identified" in iv.fit(mo.combine(mo.moments(rows, d.columns)), d).first()["iv"]["status"]
    d = iv.shared_design(["snp0", "copy"])
    fitted = iv.fit(mo.combine(mo.moments(rows, d.columns)), d)
    assert "rank" in fitted.first()["iv"]["status"]
    with pytest.raises(Exception, match="rank"):
        iv.require_identified(fitted).select("iv.theta").collect()
    with pytest.raises(ValueError, match="basis"):
        iv.generated_design("cubic")
    with pytest.raises(ValueError, match="'site' or 'shared'"):
        iv.estimate(mr, SNPS, "global")


def test_roles_may_not_conflict_between_sites():
    assert mo.check_roles([{"x": "endogenous"}, {"z": "instrument", "x": "endogenous"}]) == {"x": "endogenous", "z": "instrument"}
    with pytest.raises(ValueError, match="endogenous"):
        mo.check_roles([{"x": "endogenous"}, {"x": "exogenous"}])


def test_hot_site_gives_the_same_answer(mr, pdf):
    """Nine rows in ten at one site."""
    hot = mr.withColumn("site", F.when(F.col("l_orderkey") % 10 == 0, F.col("site")).otherwise(0))
    p = hot.toPandas()
    xh, d = brute.xhat_by_site(p, SNPS), brute.dummies(p.site.to_numpy())
    theta, _, _ = brute.tsls(np.column_stack([xh, d]), np.column_stack([p.x, d]), p.y.to_numpy())
    close(iv.local_first_stages(hot, SNPS, robust=False).estimates().first()["theta"], theta[0])
    assert fx.SNPS == tuple(SNPS)


def test_many_packed_instruments_equal_stacked_rows(mr, pdf):
    width = 24
    levels = [F.when(F.pmod(F.xxhash64(F.lit(j), "l_orderkey", "l_partkey", "y"), F.lit(3)) == 0, F.col("snp0") + j % 2).otherwise(F.lit(j % 3)).cast("double") for j in range(width)]
    rows = mr.select("site", "x", "y", F.array(*levels).alias("g")).checkpoint()
    p = rows.toPandas()
    g = np.stack(p.g)
    xh = np.empty(len(p))
    for s in p.site.unique():
        m = (p.site == s).to_numpy()
        xh[m] = brute.fitted(g[m], p.x[m].to_numpy())
    d = brute.dummies(p.site.to_numpy())
    theta, se, _ = brute.tsls(np.column_stack([xh, d]), np.column_stack([p.x, d]), p.y.to_numpy())
    design = iv.generated_design("linear")
    got = iv.tidy(iv.fit(mo.combine(iv.packed_first_stages(rows.repartition(6), "g", width)), design), design).first()
    close(got["theta"], theta[0], 1e-9)
    close(got["se"], se[0], 1e-9)


def test_identity_gate_fails_loudly(spark):
    t = spark.createDataFrame([("a", 1e-3), ("b", 0.5)], "estimator string, abs_diff_from_pooled double")
    assert iv.require_identity(t, F.col("estimator") == "none").count() == 2
    with pytest.raises(Exception, match="differs from the pooled fit"):
        iv.require_identity(t, F.col("estimator") == "a").collect()


def test_comparison_tables_have_every_column_and_keep_the_identities(mr):
    from sitefold.operators import comparison as cmp

    local = {r["estimator"]: r for r in cmp.comparison_table(mr, ["snp0", "snp1"], curved=True).collect()}
    assert len(local) == 10
    for name in ("own first stages", "own first stages, quadratic"):
        r = local[name]
        assert r["abs_diff_from_pooled"] < 1e-10 and r["rounds"] == 2 and r["first_stage_F"] > 0 and r["generated_instrument_F"] > 0 and 0 < r["partial_r2"] < 1 and r["robust_se1"] > 0
    assert local["own first stages"]["theta2"] is None and local["own first stages, quadratic"]["robust_se2"] > 0
    assert abs(local["all rows"]["se1"] - local["own first stages"]["se1"]) < 1e-9
    shared = {r["estimator"]: r for r in cmp.comparison_table(mr, ["snp0", "snp1"], shared=True).collect()}
    assert shared["shared instruments"]["abs_diff_from_pooled"] < 1e-10 and shared["all rows, own first stages"]["abs_diff_from_pooled"] is None
    assert abs(shared["all rows, own first stages"]["theta1"] - local["all rows"]["theta1"]) < 1e-12
    with pytest.raises(Exception, match="pooled"):
        cmp.comparison_table(mr, ["snp0", "snp1"], tol=0.0).collect()


def test_curve_of_a_run_takes_the_robust_band(mr):
    from sitefold.operators import comparison as cmp
    from sitefold.operators import iv

    run = iv.local_first_stages(mr, ["snp0", "snp1"], basis="quadratic")
    t = {r["term"]: r for r in run.estimates().collect()}
    row = {round(r["x"], 6): r for r in cmp.run_curve(run).collect()}[2.0]
    assert abs(row["f"] - (2 * t["x"]["theta"] + 4 * t["x2"]["theta"])) < 1e-9
    assert abs((row["f_hi"] - row["f"]) - 1.96 * (4 * t["x"]["robust_se"] ** 2 + 16 * t["x2"]["robust_se"] ** 2) ** 0.5) < 1e-9
    plain = {round(r["x"], 6): r for r in cmp.run_curve(run, robust=False, full_covariance=True).collect()}[2.0]
    assert abs(plain["f_hi"] - row["f_hi"]) > 1e-9 and row["site"] == "all" and row["round"] == run.rounds
