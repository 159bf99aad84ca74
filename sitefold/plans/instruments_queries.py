"""Two-stage least squares: protocols, bases, cross-fitting, benchmarks and the comparison table."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import comparison as cmp
from sitefold.operators import curves as cv
from sitefold.operators import gwas as gw
from sitefold.operators import iv
from sitefold.operators import meta as ma
from sitefold.operators import moments as mo
from sitefold.operators import sensitivity as se
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.aggregates_queries import BUNDLE_CTES, CROSSFIT, GW, LOCAL_CF, MEAT, QUAD_SITES, SHARED_FIT, T2, Y2, quad_fit
from sitefold.plans.joins_queries import TRUTH_SQL, truth
from sitefold.plans.registry import query
from sitefold.plans.scalars_queries import GLOBAL_FS
from sitefold.plans.windows_queries import LIN, LIN_BASE
from sitefold.runtime import cut, scalar_row, scratch_path

SE_CLASSIC = "sqrt((s_y__y - 2e0*theta*s_x__y + theta*theta*s_x__x)/(n - 1 - k)/info)"
HC0 = "sqrt((p0*p0*h00 + 2e0*p0*p1*h01 + p1*p1*h11)/(info*info))"


def estimates(run):
    return run.estimates().select("term", r("theta").alias("theta"), r("se").alias("se"), r("robust_se").alias("robust_se"))


@query("two_stage_moments_iv1", "IV1 UDF1", q.select(SHARED_FIT, f"SELECT 'x' AS term, {q.rnd('theta')} AS theta, {q.rnd(SE_CLASSIC)} AS se, {q.rnd('s_y__y - 2e0*theta*s_x__y + theta*theta*s_x__x', 3)} AS rss, CAST(n - 1 - k AS BIGINT) AS df_resid FROM th"))
def two_stage_moments(spark, d):
    design = iv.shared_design(fx.SNPS)
    fitted = cut(iv.require_identified(iv.fit(mo.combine(mo.moments(fx.mr_rows(spark, d), design.columns)), design)))
    return fitted.select(F.lit("x").alias("term"), r(F.col("iv.theta")[0]).alias("theta"), r(F.sqrt(F.col("iv.cov")[0])).alias("se"),
                         r("iv.rss", 3).alias("rss"), F.col("iv.df_resid").alias("df_resid"))


SHARED_ROBUST = q.select([*SHARED_FIT, MEAT, "h AS (SELECT sum(uu*uu*z0*z0) AS h00, sum(uu*uu*z0*z1) AS h01, sum(uu*uu*z1*z1) AS h11 FROM rowsu)"],
                         f"SELECT 'x' AS term, {q.rnd('theta')} AS theta, {q.rnd(SE_CLASSIC)} AS se, {q.rnd(HC0)} AS robust_se FROM th, h")


@query("robust_covariance_iv2", "IV2", SHARED_ROBUST)
def robust_covariance(spark, d):
    return estimates(iv.shared_instruments(fx.mr_rows(spark, d), fx.SNPS))


@query("first_stage_f_iv3", "IV3", q.select([*SHARED_FIT, "f AS (SELECT *, s_x__x - (p0*s_snp0__x + p1*s_snp1__x) AS full_rss FROM th)"],
       f"SELECT {q.rnd('((s_x__x - full_rss)/2e0)/(full_rss/(n - 2 - k))', 3)} AS f, {q.rnd('(s_x__x - full_rss)/s_x__x')} AS partial_r2, 2 AS df1, CAST(n - 2 - k AS BIGINT) AS df2 FROM f"))
def first_stage_f(spark, d):
    run = iv.shared_instruments(fx.mr_rows(spark, d), fx.SNPS, robust=False)
    return run.fitted.select(r(F.col("iv.fs_f")[0], 3).alias("f"), r(F.col("iv.fs_r2")[0]).alias("partial_r2"), F.col("iv.fs_df1").alias("df1"), F.col("iv.fs_df2").alias("df2"))


@query("local_first_stage_f_iv3b", "IV3 AGG8", "WITH " + q.local_rows() + f""",
f AS (SELECT site, sum(resid*resid) AS full_rss, var_pop(x)*count(*) AS red, count(*) AS n FROM xh GROUP BY site), t AS (SELECT sum(full_rss) AS fr, sum(red) AS red, sum(n) AS n, count(*) AS k FROM f)
SELECT {q.rnd('((red-fr)/(2e0*k))/(fr/(n - 3*k))', 3)} AS first_stage_f, {q.rnd('(red-fr)/red')} AS partial_r2, CAST(2*k AS BIGINT) AS df1, CAST(n - 3*k AS BIGINT) AS df2 FROM t""")
def local_first_stage_f(spark, d):
    run = iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, robust=False)
    f = run.fitted.select(*iv.local_first_stage_f(run.fitted))
    return f.select(r("first_stage_F", 3).alias("first_stage_f"), r("partial_r2").alias("partial_r2"), F.col("df1").cast("bigint").alias("df1"), F.col("df2").cast("bigint").alias("df2"))


@query("identification_status_iv4", "IV4", q.select([q.MR], "SELECT fold, CASE WHEN fold < 3 THEN 'ok' WHEN fold = 3 THEN 'collinear' ELSE 'under-identified' END AS status, count(*) AS n FROM mr GROUP BY fold"))
def identification_status(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("copy", F.col("snp0") * 2).withColumn("x2", F.col("x") * F.col("x"))

    def status(rows, design):
        m = mo.combine(mo.moments(rows, design.columns, ("fold", "site")), ("fold",))
        return iv.fit(m, design).select("fold", "n", F.when(F.col("iv.status") == "ok", "ok").when(
            F.col("iv.status").contains("rank"), "collinear").otherwise("under-identified").alias("status"))

    ok = status(mr.filter("fold < 3"), iv.shared_design(fx.SNPS))
    col = status(mr.filter("fold = 3"), iv.shared_design(("snp0", "copy")))
    under = status(mr.filter("fold = 4"), iv.Design(("snp0",), ("x", "x2")))
    return ok.unionByName(col).unionByName(under)


C_COLS = ["snp0", "c1", "x", "y"]
ZC0, ZC1 = q.solve2(("snp0", "c1"), "x")
# Z = [snp0, c1], W = [x, c1]: just identified, theta = B^-1 c with B = Z'W
COV_FIT = [q.MR, q.mom("mom", C_COLS), q.total("tot", C_COLS, "mom"),
           "th AS (SELECT *, s_snp0__x*s_c1__c1 - s_c1__snp0*s_c1__x AS dt FROM tot)",
           "tb AS (SELECT *, (s_snp0__y*s_c1__c1 - s_c1__snp0*s_c1__y)/dt AS t0, (s_snp0__x*s_c1__y - s_c1__x*s_snp0__y)/dt AS t1 FROM th)"]


@query("shared_with_covariate_iv5", "IV5 PRJ3", q.select(COV_FIT, f"SELECT 'x' AS term, {q.rnd('t0')} AS theta FROM tb UNION ALL SELECT 'c1', {q.rnd('t1')} FROM tb"))
def shared_with_covariate(spark, d):
    run = iv.shared_instruments(fx.mr_rows(spark, d), ("snp0",), ("c1",), robust=False)
    return run.estimates().select("term", r("theta").alias("theta"))


@query("shared_linear_iv5b", "IV5", SHARED_ROBUST)
def shared_linear(spark, d):
    return estimates(iv.estimate(fx.mr_rows(spark, d), fx.SNPS, "shared"))


Q7 = ["x", "x2", "xhat", "xhat2", "y"]


def quad_sql(ctes):
    return q.select([*ctes, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"), quad_fit("xt", "qf")],
                    f"SELECT 'x' AS term, {q.rnd('theta_1')} AS theta, {q.rnd('sqrt(v_1_1)')} AS se FROM qf UNION ALL SELECT 'x2', {q.rnd('theta_2')}, {q.rnd('sqrt(v_2_2)')} FROM qf")


def plain(run):
    return run.estimates().select("term", r("theta").alias("theta"), r("se").alias("se"))


LOCAL_CTES = [q.MR, q.mom("mom", ["snp0", "snp1", "x", "y"]), q.fs(), q.XH]


@query("shared_quadratic_iv6", "IV6", quad_sql(GLOBAL_FS))
def shared_quadratic(spark, d):
    return plain(iv.shared_instruments(fx.mr_rows(spark, d), fx.SNPS, basis="quadratic", robust=False))


CF_ROWS = """cfi AS (SELECT a.site, f.fold, f.p0, f.p1, avg(a.x) - f.p0*avg(a.snp0) - f.p1*avg(a.snp1) AS a0 FROM mr a JOIN fp f ON a.fold <> f.fold GROUP BY a.site, f.fold, f.p0, f.p1),
xh AS (SELECT mr.*, mr.x*mr.x AS x2, a0 + p0*mr.snp0 + p1*mr.snp1 AS xhat, (a0 + p0*mr.snp0 + p1*mr.snp1)*(a0 + p0*mr.snp0 + p1*mr.snp1) AS xhat2 FROM mr JOIN cfi USING (site, fold))"""
LIN_XT = ["xl AS (SELECT n, k, s_xhat__y AS a, s_x__xhat AS b, s_xhat__xhat AS qq, s_y__y AS f, s_x__y AS e, s_x__x AS d FROM xt)", f"fit AS ({LIN.format(src='xl')})"]


def lin_sql(ctes):
    return q.select([*ctes, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"), *LIN_XT], f"SELECT 'x' AS term, {q.rnd('theta')} AS theta, {q.rnd('se')} AS se FROM fit")


@query("shared_crossfit_iv7", "IV7", lin_sql([*CROSSFIT, CF_ROWS]))
def shared_crossfit(spark, d):
    return plain(iv.shared_instruments(fx.mr_rows(spark, d), fx.SNPS, crossfit=5, robust=False))


@query("shared_crossfit_quadratic_iv7b", "IV7 IV6", quad_sql([*CROSSFIT, CF_ROWS]))
def shared_crossfit_quadratic(spark, d):
    return plain(iv.shared_instruments(fx.mr_rows(spark, d), fx.SNPS, basis="quadratic", crossfit=5, robust=False))


@query("local_linear_iv8", "IV8", lin_sql(LOCAL_CTES))
def local_linear(spark, d):
    return plain(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, robust=False))


@query("packed_instruments_iv8c", "IV8 SRC2", lin_sql(LOCAL_CTES))
def packed_instruments(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("g", F.array(*[F.col(s).cast("double") for s in fx.SNPS]))
    design = iv.generated_design("linear")
    fitted = iv.fit(mo.combine(iv.packed_first_stages(mr, "g", 2)), design)
    return iv.tidy(fitted, design).select("term", r("theta").alias("theta"), r("se").alias("se"))


RU = "ru AS (SELECT site, xhat - avg(xhat) OVER w AS zc, (y - avg(y) OVER w) - theta*(x - avg(x) OVER w) AS uu FROM xh, (SELECT theta, b AS info_b FROM fit) WINDOW w AS (PARTITION BY site))"


@query("local_linear_robust_iv8b", "IV8 IV2", q.select([*LOCAL_CTES, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"), *LIN_XT, RU, "hh AS (SELECT sum(uu*uu*zc*zc) AS h FROM ru)"],
       f"SELECT 'x' AS term, {q.rnd('theta')} AS theta, {q.rnd('se')} AS se, {q.rnd('sqrt(h/(b*b))')} AS robust_se FROM fit, hh"))
def local_linear_robust(spark, d):
    return estimates(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS))


@query("local_quadratic_iv9", "IV9", quad_sql(LOCAL_CTES))
def local_quadratic(spark, d):
    return plain(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, basis="quadratic", robust=False))


LCF_ROWS = "xh AS (SELECT mr.*, mr.x*mr.x AS x2, a0 + p0*mr.snp0 + p1*mr.snp1 AS xhat, (a0 + p0*mr.snp0 + p1*mr.snp1)*(a0 + p0*mr.snp0 + p1*mr.snp1) AS xhat2 FROM mr JOIN lf ON mr.site = lf.site AND mr.fold = lf.held)"


@query("local_crossfit_iv10", "IV10", lin_sql([*LOCAL_CF, LCF_ROWS]))
def local_crossfit(spark, d):
    return plain(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, crossfit=5, robust=False))


@query("local_crossfit_quadratic_iv10b", "IV10 IV9", quad_sql([*LOCAL_CF, LCF_ROWS]))
def local_crossfit_quadratic(spark, d):
    return plain(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, basis="quadratic", crossfit=5, robust=False))


@query("protocol_by_manifest_iv11", "IV11", q.select(SHARED_FIT, f"SELECT 'shared' AS protocol, {q.rnd('theta')} AS theta FROM th UNION ALL SELECT 'site' AS protocol, theta FROM (" + lin_sql(LOCAL_CTES) + ")"))
def protocol_by_manifest(spark, d):
    mr = fx.mr_rows(spark, d)
    out = None
    for name, manifest in (("shared", {"shared_snps": True}), ("site", {"shared_snps": False})):
        e = iv.protocol_for(manifest)(mr, fx.SNPS, robust=False).estimates().select(F.lit(name).alias("protocol"), r("theta").alias("theta"))
        out = e if out is None else out.unionByName(e)
    return out


# stacked fits written out on rows instead of moments
PDUM = """pc AS (SELECT site, xhat - avg(xhat) OVER w AS h, x - avg(x) OVER w AS xc, y - avg(y) OVER w AS yc FROM xh WINDOW w AS (PARTITION BY site)),
pt AS (SELECT sum(h*yc)/sum(h*h) AS theta, sum(h*h) AS hh, sum(xc*yc)/sum(xc*xc) AS naive, count(*) AS n, count(DISTINCT site) AS k FROM pc)"""


@query("pooled_benchmark_iv12", "IV12", "WITH " + ",\n".join([*LOCAL_CTES, PDUM]) + f"\nSELECT {q.rnd('max(theta)')} AS theta, {q.rnd('sqrt(sum((yc-theta*xc)*(yc-theta*xc))/(max(n) - max(k) - 1)/max(hh))')} AS se, {q.rnd('max(naive)')} AS naive, TRUE AS identity_holds FROM pc, pt")
def pooled_benchmark(spark, d):
    mr = fx.mr_rows(spark, d)
    run = iv.local_first_stages(mr, fx.SNPS, robust=False)
    rows = mo.centre_within(fx.local_rows(mr), ["xhat", "x", "y"])
    h = F.col("xhat_c")
    stacked = rows.agg((F.sum(h * F.col("y_c")) / F.sum(h * h)).alias("stacked"), (F.sum(F.col("x_c") * F.col("y_c")) / F.sum(F.col("x_c") * F.col("x_c"))).alias("naive"))
    e = run.estimates().withColumn("_d", scalar_row(stacked))
    return e.select(r("theta").alias("theta"), r("se").alias("se"), r("_d.naive").alias("naive"), (F.abs(F.col("theta") - F.col("_d.stacked")) < 1e-10).alias("identity_holds"))


@query("per_site_quadratic_iv13", "IV13 IV15", q.select(QUAD_SITES, f"SELECT site, {q.rnd('theta_1')} AS theta_1, {q.rnd('sqrt(v_1_1)')} AS se_1, {q.rnd('theta_2')} AS theta_2, {q.rnd('sqrt(v_2_2)')} AS se_2 FROM qf"))
def per_site_quadratic(spark, d):
    b = se.site_bundle(fx.mr_rows(spark, d), fx.SNPS)
    f = se.two_sls(se.working(b, "quadratic"), "quadratic")
    return f.select("site", *[r(c).alias(c) for c in ("theta_1", "se_1", "theta_2", "se_2")])


STACK = """st AS (SELECT site, snp0 - avg(snp0) OVER w AS z0, snp1 - avg(snp1) OVER w AS z1, x - avg(x) OVER w AS xc, y - avg(y) OVER w AS yc FROM mr WINDOW w AS (PARTITION BY site)),
sm AS (SELECT sum(z0*z0) AS a, sum(z0*z1) AS b, sum(z1*z1) AS c, sum(z0*xc) AS e, sum(z1*xc) AS f, sum(z0*yc) AS g, sum(z1*yc) AS h FROM st),
sp AS (SELECT *, (e*c-f*b)/(a*c-b*b) AS p0, (f*a-e*b)/(a*c-b*b) AS p1 FROM sm)"""


@query("stacked_shared_iv14", "IV14", q.select([q.MR, STACK], f"SELECT {q.rnd('(p0*g + p1*h)/(p0*e + p1*f)')} AS theta, TRUE AS identity_holds FROM sp"))
def stacked_shared(spark, d):
    mr = fx.mr_rows(spark, d)
    run = iv.shared_instruments(mr, fx.SNPS, robust=False)
    c = mo.centre_within(mr, ["snp0", "snp1", "x", "y"])
    pi = run.site_moments
    fs = iv.global_first_stage(pi, fx.SNPS).select("pi").limit(1)
    p = cut(fs).scalar()
    xh = p[0] * F.col("snp0_c") + p[1] * F.col("snp1_c")
    direct = c.withColumn("_h", xh).agg((F.sum(F.col("_h") * F.col("y_c")) / F.sum(F.col("_h") * F.col("x_c"))).alias("direct"))
    return run.estimates().withColumn("_d", direct.scalar()).select(r("theta").alias("theta"), (F.abs(F.col("theta") - F.col("_d")) < 1e-10).alias("identity_holds"))


@query("per_site_fits_iv15", "IV15 ROB16", q.select([*LIN_BASE, f"fo AS ({LIN.format(src='lb')})"], f"SELECT site, {q.rnd('theta')} AS tsls, {q.rnd('se')} AS tsls_se, {q.rnd('e/d')} AS ols, {q.rnd('sqrt((f - e*e/d)/greatest(n-2, 1)/d)')} AS ols_se FROM fo"))
def per_site_fits(spark, d):
    w = se.working(se.linear_bundle(fx.mr_rows(spark, d), fx.SNPS), "linear")
    a = se.two_sls(w, "linear").select("site", r("theta_1").alias("tsls"), r("se_1").alias("tsls_se"))
    return a.join(se.ols(w, "linear").select("site", r("theta_1").alias("ols"), r("se_1").alias("ols_se")), "site")


@query("pooled_estimand_iv16", "IV16", q.select([*SHARED_FIT, TRUTH_SQL, "w AS (SELECT sum(s_snp0__x*avg_slope) AS b0, sum(s_snp1__x*avg_slope) AS b1 FROM mom JOIN truth USING (site))"], f"SELECT {q.rnd('(p0*b0 + p1*b1)/(p0*s_snp0__x + p1*s_snp1__x)')} AS estimand FROM th, w"))
def pooled_estimand(spark, d):
    m = mo.moments(fx.mr_rows(spark, d), [*fx.SNPS, "x"])
    return iv.pooled_estimand(m, truth(spark, d).withColumnRenamed("avg_slope", "theta"), fx.SNPS).select(r("estimand").alias("estimand"))


def comparison(mr, snps=fx.SNPS):
    """Every estimator of the linear effect in one table, with its distance from the pooled fit.

    One scan yields the (site, fold) moments behind all of them; the pooled benchmark and the two
    robust covariances each need the rows once more.
    """
    fold_moments = cut(mo.moments(mr, [*snps, "x", "y"], ("site", "fold")))
    site = mo.total_scatter(fold_moments, ["site"]).drop("sites")
    design = iv.generated_design("linear")
    fs = cut(iv.local_first_stage(site, snps))
    own = cut(iv.add_xhat_moments(fs, snps, ["x", "y"]).withColumn("m_xhat", mo.M("x")))
    rows = iv.predict_rows(mr, fs, snps, ("site",))
    fitted = iv.with_robust(iv.fit(mo.combine(own, extra=iv.FS_SUMS), design), rows, own, design)
    local = fitted.select(F.lit("local first stages").alias("estimator"), F.col("iv.theta")[0].alias("theta1"), F.sqrt(F.col("iv.cov")[0]).alias("se1"),
                          F.sqrt(F.col("robust_cov")[0]).alias("robust_se1"), *iv.local_first_stage_f(fitted)[:2])
    coefs = cut(iv.leave_fold_out_local(fold_moments, list(snps)))
    cf_moments = cut(iv.crossfit_site_moments(fold_moments, coefs, snps, design))
    cf_fit = iv.with_robust(iv.fit(mo.combine(cf_moments), design), iv.predict_rows(mr, coefs, snps, ("site", "fold")), cf_moments, design)
    cross = iv.tidy(cf_fit, design).select(F.lit("cross-fitted").alias("estimator"), F.col("theta").alias("theta1"), F.col("se").alias("se1"), F.col("robust_se").alias("robust_se1"))
    site_iv = iv.tidy(iv.fit(own.withColumn("absorbed", F.lit(1)), design, ("site",)), design, ("site",))
    meta = ma.inverse_variance(site_iv).select(F.lit("site meta-analysis").alias("estimator"), F.col("meta").alias("theta1"), F.col("meta_se").alias("se1"))
    ivw = gw.ivw(se.bundle_gwas(own, snps)).select(F.col("ivw").alias("theta"), F.col("ivw_se").alias("se"))
    ss = ma.inverse_variance(ivw).select(F.lit("summary statistics").alias("estimator"), F.col("meta").alias("theta1"), F.col("meta_se").alias("se1"))
    centred = iv._with_site_means(rows, own, ["xhat", "x", "y"], "site")
    h, x, y = (F.col(c) - F.col(f"_m_{c}") for c in ("xhat", "x", "y"))
    pooled = cut(centred.agg((F.sum(h * y) / F.sum(h * h)).alias("theta1"), (F.sum(x * y) / F.sum(x * x)).alias("naive")))
    out = pooled.select(F.lit("pooled rows").alias("estimator"), "theta1")
    for part in (local, cross, meta, ss, pooled.select(F.lit("naive").alias("estimator"), F.col("naive").alias("theta1"))):
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.withColumn("abs_diff_from_pooled", F.abs(F.col("theta1") - pooled.select("theta1").scalar()))
    return iv.require_identity(out, F.col("estimator") == "local first stages")


CMP = [*LOCAL_CTES, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"), *LIN_XT, RU, "hh AS (SELECT sum(uu*uu*zc*zc) AS h FROM ru)", PDUM,
       "sf AS (SELECT site, sum(resid*resid) AS full_rss, var_pop(x)*count(*) AS red, count(*) AS n FROM xh GROUP BY site)", "ts AS (SELECT sum(full_rss) AS fr, sum(red) AS red, sum(n) AS n, count(*) AS k FROM sf)",
       "lb AS (SELECT site, n, 1 AS k, s_xhat__y AS a, s_x__xhat AS b, s_xhat__xhat AS qq, s_y__y AS f, s_x__y AS e, s_x__x AS d FROM xm)", f"so AS ({LIN.format(src='lb')})", *GW[1:],
       "cfr AS (" + q.select([*LOCAL_CF[1:], LCF_ROWS.replace("xh AS", "xc5 AS"), q.mom("xm5", Q7, ("site",), "xc5"), q.total("xt5", Q7, "xm5"), "xl5 AS (SELECT n, k, s_xhat__y AS a, s_x__xhat AS b, s_xhat__xhat AS qq, s_y__y AS f, s_x__y AS e, s_x__x AS d FROM xt5)",
            f"f5 AS ({LIN.format(src='xl5')})", "ru5 AS (SELECT xhat - avg(xhat) OVER w AS zc, (y - avg(y) OVER w) - theta*(x - avg(x) OVER w) AS uu FROM xc5, (SELECT theta FROM f5) WINDOW w AS (PARTITION BY site))"],
            "SELECT max(theta) AS theta, max(se) AS se, sqrt(sum(uu*uu*zc*zc))/max(b) AS rse FROM f5, ru5") + ")",
       """al AS (SELECT 'pooled rows' AS estimator, theta AS theta1, NULL::DOUBLE AS se1, NULL::DOUBLE AS robust_se1, NULL::DOUBLE AS ff, NULL::DOUBLE AS r2 FROM pt
 UNION ALL SELECT 'local first stages', theta, se, sqrt(h/(b*b)), ((red-fr)/(2e0*ts.k))/(fr/(ts.n-3*ts.k)), (red-fr)/red FROM fit, hh, ts
 UNION ALL SELECT 'cross-fitted', theta, se, rse, NULL, NULL FROM cfr
 UNION ALL SELECT 'site meta-analysis', sum(theta/(se*se))/sum(1e0/(se*se)), sqrt(1e0/sum(1e0/(se*se))), NULL, NULL, NULL FROM so
 UNION ALL SELECT 'summary statistics', sum(ivw/(ivw_se*ivw_se))/sum(1e0/(ivw_se*ivw_se)), sqrt(1e0/sum(1e0/(ivw_se*ivw_se))), NULL, NULL, NULL FROM iw
 UNION ALL SELECT 'naive', naive, NULL, NULL, NULL, NULL FROM pt)"""]


@query("estimator_comparison_iv17", "IV17 SET1", q.select(CMP, f"SELECT estimator, {q.rnd('theta1')} AS theta1, {q.rnd('se1')} AS se1, {q.rnd('robust_se1')} AS robust_se1, {q.rnd('ff', 3)} AS first_stage_f, {q.rnd('r2')} AS partial_r2, {q.rnd('abs(al.theta1 - pt.theta)')} AS abs_diff_from_pooled FROM al, pt"))
def estimator_comparison(spark, d):
    c = comparison(fx.mr_rows(spark, d))
    return c.select("estimator", *[r(v).alias(v) for v in ("theta1", "se1", "robust_se1")], r("first_stage_F", 3).alias("first_stage_f"), r("partial_r2").alias("partial_r2"), r("abs_diff_from_pooled").alias("abs_diff_from_pooled"))


def robust_quad(ctes, name):
    """CTE `name`: the quadratic fit of rows xh with classical and robust variances."""
    s = {k: q.s(*v) for k, v in dict(b11=("xhat", "x"), b12=("xhat", "x2"), b21=("xhat2", "x"), b22=("xhat2", "x2")).items()}
    return f"{name} AS (" + q.select([*ctes, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"), quad_fit("xt", "qf"),
        "rq AS (SELECT xhat - avg(xhat) OVER w AS z1, xhat2 - avg(xhat2) OVER w AS z2, (y - avg(y) OVER w) - t1*(x - avg(x) OVER w) - t2*(x2 - avg(x2) OVER w) AS uu FROM xh, (SELECT theta_1 AS t1, theta_2 AS t2 FROM qf) WINDOW w AS (PARTITION BY site))",
        "hq AS (SELECT sum(uu*uu*z1*z1) AS h11, sum(uu*uu*z1*z2) AS h12, sum(uu*uu*z2*z2) AS h22 FROM rq)",
        f"bq AS (SELECT qf.*, {', '.join(f'{c} AS {k}' for k, c in s.items())} FROM qf)"],
        "SELECT theta_1, theta_2, v_1_1, v_2_2, (b22*b22*h11 - 2e0*b22*b12*h12 + b12*b12*h22)/pow(b11*b22 - b12*b21, 2) AS r_1_1, (b21*b21*h11 - 2e0*b21*b11*h12 + b11*b11*h22)/pow(b11*b22 - b12*b21, 2) AS r_2_2 FROM bq, hq") + ")"


QUAD_TABLE = [q.MR, robust_quad(LOCAL_CTES[1:], "ql"), robust_quad([*LOCAL_CF[1:], LCF_ROWS], "qc"),
              "qm AS (" + q.select(["ml AS (SELECT * FROM (" + q.select([*QUAD_SITES, "ww AS (SELECT theta_1, theta_2, v_2_2/dv AS a, -v_1_2/dv AS b, v_1_1/dv AS c FROM (SELECT *, v_1_1*v_2_2-v_1_2*v_1_2 AS dv FROM qf))"], "SELECT * FROM ww") + "))",
                                    "sm AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(a*theta_1+b*theta_2) AS e, sum(b*theta_1+c*theta_2) AS f FROM ml)"],
                                   "SELECT (c*e-b*f)/(a*c-b*b) AS theta_1, (a*f-b*e)/(a*c-b*b) AS theta_2, sqrt(c/(a*c-b*b)) AS se_1, sqrt(a/(a*c-b*b)) AS se_2 FROM sm") + ")",
              """qa AS (SELECT 'all rows, quadratic' AS estimator, theta_1, sqrt(v_1_1) AS se1, NULL::DOUBLE AS rse1, theta_2, sqrt(v_2_2) AS se2, NULL::DOUBLE AS rse2, NULL::DOUBLE AS gap, NULL::INT AS rounds FROM ql
 UNION ALL SELECT 'own first stages, quadratic', theta_1, sqrt(v_1_1), sqrt(r_1_1), theta_2, sqrt(v_2_2), sqrt(r_2_2), 0e0, 2 FROM ql
 UNION ALL SELECT 'own first stages, quadratic, 5 folds', c.theta_1, sqrt(c.v_1_1), sqrt(c.r_1_1), c.theta_2, sqrt(c.v_2_2), sqrt(c.r_2_2), greatest(abs(c.theta_1 - l.theta_1), abs(c.theta_2 - l.theta_2)), 2 FROM qc c, ql l
 UNION ALL SELECT 'meta-analysis of sites, quadratic', m.theta_1, se_1, NULL, m.theta_2, se_2, NULL, greatest(abs(m.theta_1 - l.theta_1), abs(m.theta_2 - l.theta_2)), NULL FROM qm m, ql l)"""]


@query("quadratic_comparison_iv17b", "IV17 IV9 IV10 IV12", q.select(QUAD_TABLE, f"SELECT estimator, {q.rnd('theta_1')} AS theta1, {q.rnd('se1')} AS se1, {q.rnd('rse1')} AS robust_se1, {q.rnd('theta_2')} AS theta2, {q.rnd('se2')} AS se2, {q.rnd('rse2')} AS robust_se2, {q.rnd('gap')} AS abs_diff_from_pooled, coalesce(rounds, 0) AS rounds FROM qa"))
def quadratic_comparison(spark, d):
    t = cmp.comparison_table(fx.mr_rows(spark, d), fx.SNPS, curved=True).where("estimator like '%quadratic%'")
    return t.select("estimator", *[r(c).alias(c) for c in ("theta1", "se1", "robust_se1", "theta2", "se2", "robust_se2", "abs_diff_from_pooled")], F.coalesce("rounds", F.lit(0)).alias("rounds"))


@query("shared_comparison_iv17c", "IV17 IV5 IV14")
def shared_comparison(spark, d):
    """Shared instruments: the benchmark has one first stage, and one with own first stages stands beside it for contrast."""
    return cmp.comparison_table(fx.mr_rows(spark, d), fx.SNPS, shared=True)


FS_RECORD = [*LOCAL_CTES, q.mom("xm", Q7, ("site",), "xh"), q.total("xt", Q7, "xm"),
             "sf AS (SELECT site, sum(resid*resid) AS full_rss, var_pop(x)*count(*) AS red, count(*) AS n FROM xh GROUP BY site)", "ts AS (SELECT sum(full_rss) AS fr, sum(red) AS red, sum(n) AS n, count(*) AS k FROM sf)",
             "ge AS (SELECT n, k, s_x__x AS xx, s_x2__x2 AS ww, s_x__xhat*s_x__xhat/s_xhat__xhat AS el, (s_x__xhat*s_x__xhat*s_xhat2__xhat2 - 2e0*s_x__xhat*s_x__xhat2*s_xhat__xhat2 + s_x__xhat2*s_x__xhat2*s_xhat__xhat)/(s_xhat__xhat*s_xhat2__xhat2 - s_xhat__xhat2*s_xhat__xhat2) AS ex, (s_x2__xhat*s_x2__xhat*s_xhat2__xhat2 - 2e0*s_x2__xhat*s_x2__xhat2*s_xhat__xhat2 + s_x2__xhat2*s_x2__xhat2*s_xhat__xhat)/(s_xhat__xhat*s_xhat2__xhat2 - s_xhat__xhat2*s_xhat__xhat2) AS e2 FROM xt)"]
OWN_F = "((red-fr)/(2e0*ts.k))/(fr/(ts.n-3*ts.k)) AS f, (red-fr)/red AS r2, CAST(2*ts.k AS BIGINT) AS df1, CAST(ts.n-3*ts.k AS BIGINT) AS df2, TRUE AS conditional, 'first stages of the sites' AS source"


@query("first_stage_record_iv3c", "IV3 AGG8", q.select([*FS_RECORD, f"""al AS (SELECT 'linear' AS basis, 'x' AS endogenous, {OWN_F}, el/((xx - el)/(ge.n - 1 - ge.k)) AS gf FROM ts, ge
 UNION ALL SELECT 'quadratic', 'x', {OWN_F}, (ex/2e0)/((xx - ex)/(ge.n - 2 - ge.k)) FROM ts, ge
 UNION ALL SELECT 'quadratic', 'x2', (e2/2e0)/((ww - e2)/(n - 2 - k)), e2/ww, CAST(2 AS BIGINT), CAST(n - 2 - k AS BIGINT), FALSE, 'excluded instruments', NULL FROM ge)"""],
       f"SELECT basis, endogenous, {q.rnd('f', 3)} AS f, {q.rnd('r2')} AS partial_r2, df1, df2, conditional, source, {q.rnd('gf', 3)} AS generated_instrument_f FROM al"))
def first_stage_record(spark, d):
    out = None
    for basis in iv.BASES:
        run = iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, basis=basis, robust=False)
        part = cmp.first_stage_record(run).select(F.lit(basis).alias("basis"), "endogenous", r("F", 3).alias("f"), r("partial_r2").alias("partial_r2"), "df1", "df2", "conditional", "source", r("generated_instrument_F", 3).alias("generated_instrument_f"))
        out = part if out is None else out.unionByName(part)
    return out


@query("curve_band_robust_iv18b", "IV18 IV2", q.select([q.MR, robust_quad(LOCAL_CTES[1:], "ql"), q.GRID61],
       f"SELECT 'all' AS site, 2 AS round, k, {q.rnd('theta_1*x + theta_2*x*x')} AS f, {q.rnd('theta_1*x + theta_2*x*x - 1.96e0*sqrt(x*x*r_1_1 + x*x*x*x*r_2_2)')} AS f_lo, {q.rnd('theta_1*x + theta_2*x*x + 1.96e0*sqrt(x*x*r_1_1 + x*x*x*x*r_2_2)')} AS f_hi FROM ql, grid"))
def curve_band_robust(spark, d):
    c = cmp.run_curve(iv.local_first_stages(fx.mr_rows(spark, d), fx.SNPS, basis="quadratic"))
    return c.select("site", "round", "k", *[r(v).alias(v) for v in ("f", "f_lo", "f_hi")])


@query("site_files_iv11b", "IV11 SRC1 SRC4", q.select(SHARED_FIT, f"SELECT 'shared' AS protocol, {q.rnd('theta')} AS theta, CAST(5 AS BIGINT) AS sites, CAST(n AS BIGINT) AS n FROM th UNION ALL SELECT 'site' AS protocol, f.theta, CAST(5 AS BIGINT), CAST(t.n AS BIGINT) FROM (" + lin_sql(LOCAL_CTES) + ") f, th t"))
def site_files(spark, d):
    """Two data sets written as a file per site with a manifest beside them, read back, and fitted by what their manifest says. A data set's files
    are written in one pass over the rows, and one over what was written counts the rows of its sites."""
    import json

    from sitefold.sources import sites as src

    rows = fx.mr_rows(spark, d)
    names = [x["site"] for x in rows.select("site").distinct().collect()]  # one folder per site
    out = None
    for name, shared in (("shared", True), ("site", False)):
        folder = scratch_path(spark, f"{name}-set")
        src.write_table(rows.select(*fx.SNPS, "x", "y", F.format_string("site%02d.csv", F.col("site") + 1).alias("file")), folder, "csv", ["file"])
        doc = json.dumps({"shape": "linear", "shared_snps": shared, "sites": [{"site_id": f"site{int(s) + 1:02d}"} for s in names]})
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
        df = src.scan_sites(spark, f"{folder}/file=site*.csv", "csv", rows.select(*fx.SNPS, "x", "y").schema, folders=True)
        df = df.withColumn("site", F.substring_index("site", "=", -1))  # Spark's folder is file=site01.csv
        counted = cut(df.groupBy("site").agg(F.count(F.lit(1)).alias("n")))
        run = iv.from_manifest(src.read_manifest(spark, f"{folder}/manifest.json"), df, fx.SNPS, counted, robust=False)
        e = run.estimates().select(F.lit(name).alias("protocol"), r("theta").alias("theta"))
        size = counted.agg(F.count("site").alias("sites"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        e = e.crossJoin(size)  # one row and one row
        out = e if out is None else out.unionByName(e)
    return out


BAND = [*QUAD_SITES[:-2], "bk AS (SELECT sum(n) AS n, count(*) AS k, " + ", ".join(f"sum({q.s(a, b)}) AS {q.s(a, b)}" for a, b in q.pairs(Q7)) + " FROM bun)", quad_fit("bk", "qf"), q.GRID61]


@query("curve_band_iv18", "IV18", q.select(BAND, f"""SELECT CAST(k2 AS INT) AS k, {q.rnd('f')} AS f, {q.rnd('f - 1.96e0*sqrt(vf)')} AS lo_full, {q.rnd('f + 1.96e0*sqrt(vf)')} AS hi_full, {q.rnd('f - 1.96e0*sqrt(vd)')} AS lo_diag
 FROM (SELECT grid.k AS k2, theta_1*x + theta_2*x*x AS f, x*x*v_1_1 + 2e0*x*x*x*v_1_2 + x*x*x*x*v_2_2 AS vf, x*x*v_1_1 + x*x*x*x*v_2_2 AS vd FROM qf, grid)"""))
def curve_band(spark, d):
    b = se.site_bundle(fx.mr_rows(spark, d), fx.SNPS)
    e = cut(se.two_sls(se.pooled(se.working(b, "quadratic")), "quadratic"))
    a = cv.coefficient_curve(e, 2).select("k", r("f").alias("f"), r("f_lo").alias("lo_full"), r("f_hi").alias("hi_full"))
    return a.join(cv.coefficient_curve(e, 2, full_covariance=False).select("k", r("f_lo").alias("lo_diag")), "k")


BLOCK = """bp AS (SELECT *, q0*s_snp0__y + q1*s_snp1__y AS ypy, p0*s_snp0__y + p1*s_snp1__y AS wpy, p0*s_snp0__x + p1*s_snp1__x AS wpw FROM (SELECT *, {p0} AS p0, {p1} AS p1, {q0} AS q0, {q1} AS q1 FROM {src}))"""

BLOCKS = [*BUNDLE_CTES, BLOCK.format(p0=T2[0], p1=T2[1], q0=Y2[0], q1=Y2[1], src="bun"),
          "bs AS (SELECT sum(n) AS n, count(*) AS k, sum(s_y__y) AS cyy, sum(s_x__y) AS cxy, sum(s_x__x) AS cxx, sum(ypy) AS ypy, sum(wpy) AS wpy, sum(wpw) AS wpw FROM bp)"]


@query("block_projection_iv19", "IV19", q.select([*BLOCKS, "tt AS (SELECT *, wpy/wpw AS theta FROM bs)"],
       f"SELECT {q.rnd('theta')} AS theta_1, {q.rnd('sqrt((cyy - 2e0*theta*cxy + theta*theta*cxx)/greatest(n - k - 1, 1)/wpw)')} AS se_1, {q.rnd('ypy', 3)} AS ypy, {q.rnd('wpw', 3)} AS wpw, {q.rnd('ypy - 2e0*theta*wpy + theta*theta*wpw', 4)} AS rpr FROM tt"))
def block_projection(spark, d):
    b = se.linear_bundle(fx.mr_rows(spark, d), fx.SNPS)
    e = se.two_sls(se.pooled(se.working(b, "linear", "snps", fx.SNPS)), "linear")
    return e.select(r("theta_1").alias("theta_1"), r("se_1").alias("se_1"), r("p_y__y", 3).alias("ypy"), r("p_x__x", 3).alias("wpw"),
                    r(se._rss([F.col("theta_1")], ["x"], se._p), 4).alias("rpr"))


@query("single_table_iv20", "IV20", q.select([q.MR, q.mom("mom", ["snp0", "snp1", "x", "y"], ()), q.fs(), "xs AS (SELECT mr.x, mr.y, a0 + p0*snp0 + p1*snp1 AS xhat FROM mr, fs)"],
       f"SELECT {q.rnd('covar_samp(x,y)/var_samp(x)')} AS ols, {q.rnd('covar_samp(xhat,y)/var_samp(xhat)')} AS tsls FROM xs"))
def single_table(spark, d):
    return iv.single_table(fx.mr_rows(spark, d), fx.SNPS).select(r("ols").alias("ols"), r("tsls").alias("tsls"))
