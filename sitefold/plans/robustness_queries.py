"""K-class, penalised, anchored and cross-site robustness queries on the site bundle."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import moments as mo
from sitefold.operators import sensitivity as se
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.aggregates_queries import BUNDLE_CTES, GW, T2, Y2
from sitefold.plans.instruments_queries import BLOCK, BLOCKS
from sitefold.plans.registry import query
from sitefold.plans.windows_queries import LIN, LIN_BASE, LIN_SUMS

LAMBDAS = (0.0, 0.01, 0.1, 0.5, 1.0, 10.0)
GAMMAS = (0.0, 0.5, 1.0, 5.0, 50.0)
# Fixed value: the 0.95 quantile of chi-square with 10 degrees of freedom.
CHI2_10_95 = 18.307038053275146


def bundle(spark, d):
    return se.site_bundle(fx.mr_rows(spark, d), fx.SNPS)


def linear(spark, d):
    return se.linear_bundle(fx.mr_rows(spark, d), fx.SNPS)


def snp_agg(spark, d):
    return se.pooled(se.working(linear(spark, d), "linear", "snps", fx.SNPS))


@query("kclass_rob1", "ROB1", q.select([*BLOCKS, "kp AS (SELECT unnest([0e0, 0.5e0, 1e0]) AS kappa)"], f"SELECT kappa, {q.rnd('((1e0-kappa)*cxy + kappa*wpy)/((1e0-kappa)*cxx + kappa*wpw)')} AS theta_1 FROM bs, kp"))
def kclass(spark, d):
    a = snp_agg(spark, d).withColumn("kappa", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    return se.kclass(a, "linear", F.col("kappa")).select("kappa", r("theta_1").alias("theta_1"))


LIML = ["rm AS (SELECT *, cyy-ypy AS r00, cxy-wpy AS r01, cxx-wpw AS r11 FROM bs)",
        "mm AS (SELECT *, (r11*cyy - r01*cxy)/dt AS m00, (r11*cxy - r01*cxx)/dt AS m01, (r00*cxy - r01*cyy)/dt AS m10, (r00*cxx - r01*cxy)/dt AS m11 FROM (SELECT *, r00*r11-r01*r01 AS dt FROM rm))",
        "li AS (SELECT *, ((m00+m11) - sqrt(greatest((m00+m11)*(m00+m11) - 4e0*(m00*m11-m01*m10), 0e0)))/2e0 AS kl FROM mm)"]


@query("liml_fuller_rob2", "ROB2", q.select([*BLOCKS, *LIML], f"SELECT {q.rnd('kl')} AS liml, {q.rnd('kl - 1e0/greatest(n - 2*k - k, 1)')} AS fuller, {q.rnd('((1e0-kl)*cxy + kl*wpy)/((1e0-kl)*cxx + kl*wpw)')} AS theta_liml FROM li"))
def liml_fuller(spark, d):
    a = se.liml_kappa(snp_agg(spark, d), "linear")
    k = se.kclass(a, "linear", F.col("kappa_liml"))
    return k.select(r("kappa_liml").alias("liml"), r("kappa_fuller").alias("fuller"), r("theta_1").alias("theta_liml"))


PATH = [*BLOCKS, *LIML, "gp AS (SELECT *, g*greatest(1e0, kl)/240e0 AS kappa FROM li, range(241) r(g))",
        "tp AS (SELECT *, ((1e0-kappa)*cxy + kappa*wpy)/((1e0-kappa)*cxx + kappa*wpw) AS theta FROM gp)",
        "te AS (SELECT *, n*(ypy - 2e0*theta*wpy + theta*theta*wpw)/(cyy - 2e0*theta*cxy + theta*theta*cxx) AS test FROM tp)"]


@query("kclass_path_rob3", "ROB3", q.select(PATH, f"SELECT CAST(g AS INT) AS k, {q.rnd('kappa')} AS kappa, {q.rnd('theta')} AS theta_1, {q.rnd('test', 4)} AS test FROM te"))
def kclass_path(spark, d):
    p = se.kclass_path(snp_agg(spark, d), "linear")
    return p.select("k", r("kappa").alias("kappa"), r("theta_1").alias("theta_1"), r("test", 4).alias("test"))


@query("pulse_marks_rob3b", "ROB3 ROB2", q.select([*PATH, f"pu AS (SELECT COALESCE(min(CASE WHEN test <= {CHI2_10_95!r} AND kappa <= 1e0 THEN kappa END), 1e0) AS kp FROM te)",
       "mk AS (SELECT 'OLS' AS estimator, 0e0 AS kappa UNION ALL SELECT 'PULSE', kp FROM pu UNION ALL SELECT '2SLS', 1e0 UNION ALL SELECT 'Fuller(1)', kl - 1e0/greatest(n-3*k,1) FROM li UNION ALL SELECT 'LIML', kl FROM li)"],
       f"SELECT estimator, {q.rnd('kappa')} AS kappa, {q.rnd('((1e0-kappa)*cxy + kappa*wpy)/((1e0-kappa)*cxx + kappa*wpw)')} AS theta_1 FROM mk, bs"))
def pulse_marks(spark, d):
    return se.marks(snp_agg(spark, d), "linear").select("estimator", r("kappa").alias("kappa"), r("theta_1").alias("theta_1"))


@query("ridge_path_rob4", "ROB4", q.select([*BLOCKS, f"la AS (SELECT unnest([{', '.join(f'{v!r}e0' for v in LAMBDAS)}]) AS lam)"], f"SELECT lam, {q.rnd('wpy/(wpw + lam*wpw)')} AS theta_1 FROM bs, la"))
def ridge_path(spark, d):
    return se.ridge_path(snp_agg(spark, d), "linear", LAMBDAS).select("lam", r("theta_1").alias("theta_1"))


def _anchor_sql(reg):
    w, b = f"sum({q.s(reg, reg)})", f"(sum(n*m_{reg}*m_{reg}) - sum(n*m_{reg})*sum(n*m_{reg})/sum(n))"
    wy, by = f"sum({q.s(reg, 'y')})", f"(sum(n*m_{reg}*m_y) - sum(n*m_{reg})*sum(n*m_y)/sum(n))"
    return f"(SELECT {w} AS w, {b} AS b, {wy} AS wy, {by} AS byy FROM bun)"


@query("anchor_path_rob5", "ROB5", q.select([*BUNDLE_CTES, f"ga AS (SELECT unnest([{', '.join(f'{v!r}e0' for v in GAMMAS)}]) AS gamma)", f"an AS {_anchor_sql('xhat')}"],
       f"SELECT gamma, {q.rnd('(wy + gamma*byy)/(w + gamma*b)')} AS theta_1 FROM an, ga UNION ALL SELECT 1e9, {q.rnd('byy/b', 3)} FROM an"))
def anchor_path(spark, d):
    a = se.anchor_path(linear(spark, d), "linear", [*GAMMAS, float("inf")])
    inf = F.col("gamma") == float("inf")
    return a.select(F.when(inf, 1e9).otherwise(F.col("gamma")).alias("gamma"), F.when(inf, r("theta_1", 3)).otherwise(r("theta_1")).alias("theta_1"))


SITE_LIN = [*LIN_BASE, f"fo AS ({LIN.format(src='lb')})"]
SPAN = "sp AS (SELECT min(theta - {w}e0*se) AS lo, max(theta + {w}e0*se) AS hi FROM fo)"


def site_lin(spark, d):
    return se.two_sls(se.working(linear(spark, d), "linear"), "linear")


@query("wald_surface_rob6", "ROB6", q.select([*SITE_LIN, SPAN.format(w=3)], f"SELECT site, CAST(g AS INT) AS k, {q.rnd('(lo + (hi-lo)*g/399e0 - theta)*(lo + (hi-lo)*g/399e0 - theta)/(se*se)', 5)} AS surprise FROM fo, sp, range(400) r(g)"))
def wald_surface(spark, d):
    return se.surprise_surface(site_lin(spark, d)).select("site", "k", r("surprise", 5).alias("surprise"))


@query("minimax_rob7", "ROB7", q.select([*SITE_LIN, SPAN.format(w=4), "sf AS (SELECT g, lo + (hi-lo)*g/4000e0 AS t, max((lo + (hi-lo)*g/4000e0 - theta)*(lo + (hi-lo)*g/4000e0 - theta)/(se*se)) AS worst FROM fo, sp, range(4001) r(g) GROUP BY g, t)"],
       f"SELECT {q.rnd('min_by(t, worst)')} AS theta_1, {q.rnd('min(worst)', 5)} AS worst FROM sf"))
def minimax(spark, d):
    return se.minimax(site_lin(spark, d), "linear").select(r("theta_1").alias("theta_1"), r("worst", 5).alias("worst"))


@query("minimax_two_rob7b", "ROB7")
def minimax_two(spark, d):
    f = se.two_sls(se.working(bundle(spark, d), "quadratic"), "quadratic")
    return se.minimax(f, "quadratic")


@query("excess_risk_rob8", "ROB8", q.select([*SITE_LIN, f"ft AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM lb)')})"], f"SELECT fo.site, {q.rnd('(ft.theta-fo.theta)*(ft.theta-fo.theta)*(fo.b*fo.b/fo.qq)/fo.n', 8)} AS risk FROM fo, ft"))
def excess_risk(spark, d):
    w = se.working(linear(spark, d), "linear")
    full = se.two_sls(se.pooled(w), "linear").select("theta_1").scalar()
    f = se.two_sls(w, "linear").withColumn("_t", full)
    return f.select("site", r(se.excess_risk(f, "linear", [F.col("_t")]), 8).alias("risk"))


@query("vrex_path_rob8b", "ROB8")
def vrex_path(spark, d):
    return se.vrex_path(site_lin(spark, d), [0.0, 1.0, 10.0, 100.0, 1000.0])


@query("vrex_path_two_rob8c", "ROB8")
def vrex_path_two(spark, d):
    f = se.two_sls(se.working(bundle(spark, d), "quadratic"), "quadratic")
    return se.vrex_path(f, [0.0, 1.0, 10.0, 100.0, 1000.0], "quadratic")


# per-site slope precisions on a joint or own noise scale
DIS = [*SITE_LIN, "rs AS (SELECT *, f - 2e0*theta*e + theta*theta*d AS rss, b*b/qq AS h FROM fo)",
       "s2 AS (SELECT *, sum(rss) OVER ()/greatest(sum(n) OVER () - count(*) OVER () - count(*) OVER (), 1) AS joint, rss/greatest(n-2, 1) AS own FROM rs)",
       "pp AS (SELECT *, h/joint AS p FROM s2)",
       "rr AS (SELECT *, sum(p) OVER () - p AS pr, (sum(p*theta) OVER () - p*theta) AS prt, sum(p) OVER () AS pa, sum(p*theta) OVER () AS pat FROM pp)"]


@query("site_disagreement_rob9", "ROB9", q.select(DIS, f"""SELECT site, {q.rnd('theta')} AS theta_1, {q.rnd('(theta - prt/pr)/sqrt(1e0/p + 1e0/pr)', 5)} AS z_joint_1, {q.rnd('pat/pa')} AS theta_joint_1, {q.rnd('sqrt(1e0/pa)')} AS se_joint_1,
 {q.rnd('sum(p*(theta - pat/pa)*(theta - pat/pa)) OVER ()', 5)} AS q, {q.rnd('joint')} AS sigma2_joint, {q.rnd('own')} AS sigma2_site FROM rr"""))
def site_disagreement(spark, d):
    s = se.site_disagreement(se.working(linear(spark, d), "linear"), "linear")
    return s.select("site", r("theta_1").alias("theta_1"), r("z_joint_1", 5).alias("z_joint_1"), r("theta_joint_1").alias("theta_joint_1"), r("se_joint_1").alias("se_joint_1"),
                    r("q", 5).alias("q"), r("sigma2_joint").alias("sigma2_joint"), r("sigma2_site").alias("sigma2_site"))


@query("site_disagreement_own_rob9b", "ROB9", q.select([*DIS[:-2], "pp AS (SELECT *, h/own AS p FROM s2)", DIS[-1]], f"SELECT site, {q.rnd('(theta - prt/pr)/sqrt(1e0/p + 1e0/pr)', 5)} AS z_joint_1, {q.rnd('pat/pa')} AS theta_joint_1 FROM rr"))
def site_disagreement_own(spark, d):
    s = se.site_disagreement(se.working(linear(spark, d), "linear"), "linear", scale="site")
    return s.select("site", r("z_joint_1", 5).alias("z_joint_1"), r("theta_joint_1").alias("theta_joint_1"))


@query("site_disagreement_p_rob9c", "ROB9 UDF3", q.select([*DIS, "qs AS (SELECT sum(p*(theta - pat/pa)*(theta - pat/pa)) AS q, count(*) AS k FROM rr)"],
       f"SELECT {q.rnd('q', 5)} AS q, CAST(k - 1 AS BIGINT) AS df, {q.rnd('exp(-q/2e0)*(1e0 + q/2e0)', 9)} AS p FROM qs"))
def site_disagreement_p(spark, d):
    """Five sites: four degrees of freedom, whose tail has a closed form."""
    s = se.site_disagreement(se.working(linear(spark, d), "linear"), "linear")
    return s.groupBy().agg(F.first("q").alias("q"), F.first("df").alias("df"), F.first("p").alias("p")).select(r("q", 5).alias("q"), F.col("df").cast("bigint").alias("df"), r("p", 9).alias("p"))


@query("pairwise_disagreement_rob9d", "ROB9 JON6", q.select(DIS, f"SELECT a.site AS site_i, b.site AS site_j, {q.rnd('(a.theta - b.theta)/sqrt(1e0/a.p + 1e0/b.p)', 5)} AS z FROM rr a JOIN rr b ON a.site <> b.site"))
def pairwise_disagreement(spark, d):
    s = se.site_disagreement(se.working(linear(spark, d), "linear"), "linear")
    return se.pairwise_disagreement(s, "linear").select("site_i", "site_j", r("z", 5).alias("z"))


@query("leave_two_out_rob10", "ROB10 JON9", q.select([*LIN_BASE, "dr AS (SELECT x.site AS i, z.site AS j, " + ", ".join(f"t.{c} - x.{c} - z.{c} AS {c}" for c in ("n", "k", "a", "b", "qq", "f", "e", "d")) + f" FROM lb x JOIN lb z ON x.site < z.site, (SELECT {LIN_SUMS} FROM lb) t)", f"fd AS ({LIN.format(src='dr')})"],
       f"SELECT i, j, CAST(n AS BIGINT) AS n, {q.rnd('theta')} AS theta_1, {q.rnd('se')} AS se_1 FROM fd"))
def leave_two_out(spark, d):
    o = se.leave_out(se.working(linear(spark, d), "linear"), "linear", 2)
    return o.select(F.col("dropped")[0].alias("i"), F.col("dropped")[1].alias("j"), "n", r("theta_1").alias("theta_1"), r("se_1").alias("se_1"))


@query("leave_one_out_naive_rob10b", "ROB10 UDF2", q.select([*LIN_BASE, "t AS (SELECT sum(n) AS n, count(*) AS k, sum(e) AS e, sum(d) AS d FROM lb)"], f"SELECT lb.site, {q.rnd('(t.e-lb.e)/(t.d-lb.d)')} AS theta_1 FROM lb, t"))
def leave_one_out_naive(spark, d):
    o = se.leave_out(se.working(linear(spark, d), "linear"), "linear", 1, estimator="ols")
    return o.select(F.col("dropped")[0].alias("site"), r("theta_1").alias("theta_1"))


CERT = [*BUNDLE_CTES, BLOCK.format(p0=T2[0], p1=T2[1], q0=Y2[0], q1=Y2[1], src="bun"),
        "ce AS (SELECT *, rpr/s2 AS j, wpw/s2 AS h FROM (SELECT *, (s_y__y - 2e0*theta*s_x__y + theta*theta*s_x__x)/greatest(n-2, 1) AS s2, ypy - 2e0*theta*wpy + theta*theta*wpw AS rpr FROM (SELECT *, wpy/wpw AS theta FROM bp)))",
        "cs AS (SELECT sum(h*theta)/sum(h) AS th, sqrt(1e0/sum(h)) AS se, sum(j) AS within, count(*) AS k FROM ce)"]


@query("moment_certificate_rob11", "ROB11", q.select(CERT, f"SELECT {q.rnd('max(th)')} AS theta_1, {q.rnd('max(cs.se)')} AS se_1, {q.rnd('max(within)', 5)} AS within, CAST(max(k) AS BIGINT) AS df_within, {q.rnd('sum(h*(theta-th)*(theta-th))', 5)} AS between, CAST(max(k) - 1 AS BIGINT) AS df_between FROM ce, cs"))
def moment_certificate(spark, d):
    c = se.certificate(se.working(linear(spark, d), "linear", "snps", fx.SNPS), "linear")
    return c.select(r("theta_1").alias("theta_1"), r("se_1").alias("se_1"), r("within", 5).alias("within"), "df_within", r("between", 5).alias("between"), "df_between")


@query("snp_invariance_rob12", "ROB12", q.select([*CERT, *GW[1:]], f"SELECT snp, {q.rnd('sum((beta_y - th*beta_x)*(beta_y - th*beta_x)/(se_y*se_y + th*th*se_x*se_x))', 5)} AS t, count(*) AS df FROM gw, cs GROUP BY snp"))
def snp_invariance(spark, d):
    b = linear(spark, d)
    theta = se.certificate(se.working(b, "linear", "snps", fx.SNPS), "linear").select("theta_1").scalar()
    g = se.bundle_gwas(b, fx.SNPS).withColumn("_th", theta)
    return se.snp_invariance(g, F.col("_th")).select("snp", r("T", 5).alias("t"), "df")


@query("instrument_search_rob13", "ROB13")
def instrument_search(spark, d):
    mr = se.perturb(fx.mr_rows(spark, d), ["snp1"], 1.5, [0, 2])
    b = se.linear_bundle(mr, ("snp0", "snp1", "snp2"))
    return se.invariant_instrument_search(b, ("snp0", "snp1", "snp2"))


def _icp_sql():
    """F statistics per site for the sets {}, {x}, {u} and {x, u} from row-level sums."""
    parts = []
    for who, src in (("e", "ev"), ("r", "rv"), ("a", "av")):
        parts.append(f"{who}s AS (SELECT {'site, ' if who != 'a' else ''}n, syy, syy - sxy*sxy/sxx AS rx, syy - suy*suy/suu AS ru, syy - (sxy*(sxy*suu - suy*sxu) + suy*(suy*sxx - sxy*sxu))/(sxx*suu - sxu*sxu) AS rxu FROM {src})")
    agg = "count(*) AS n, var_pop(y)*count(*) AS syy, var_pop(x)*count(*) AS sxx, var_pop(u)*count(*) AS suu, covar_pop(x,y)*count(*) AS sxy, covar_pop(u,y)*count(*) AS suy, covar_pop(x,u)*count(*) AS sxu"
    base = [q.MR, f"ev AS (SELECT site, {agg} FROM mr GROUP BY site)", f"rv AS (SELECT s.site, {agg} FROM (SELECT DISTINCT site FROM mr) s JOIN mr ON mr.site <> s.site GROUP BY s.site)", f"av AS (SELECT {agg} FROM mr)", *parts]
    rows = []
    for name, col, k in (("", "syy", 1), ("x", "rx", 2), ("u", "ru", 2), ("x+u", "rxu", 3)):
        chow = f"((a.{col} - e.{col} - r.{col})/{k})/((e.{col} + r.{col})/(a.n - 2*{k}))"
        var = f"(e.{col}/(e.n-{k}))/(r.{col}/(r.n-{k}))"
        rows.append(f"SELECT '{name}' AS predictors, e.site, {q.rnd(chow, 4)} AS f_chow, {q.rnd(var)} AS f_var FROM es e JOIN rs r ON e.site = r.site, \"as\" a".replace('"as"', "aall"))
    base[-1] = base[-1].replace("as AS (", "aall AS (", 1)
    return q.select(base, " UNION ALL ".join(rows))


@query("invariant_prediction_rob14", "ROB14", _icp_sql())
def invariant_prediction(spark, d):
    t = se.invariant_prediction(mo.moments(fx.mr_rows(spark, d), ["y", "x", "u"]), ("x", "u"))
    return t.select("predictors", "site", r("f_chow", 4).alias("f_chow"), r("f_var").alias("f_var"))


@query("accepted_predictors_rob14b", "ROB14 SET3")
def accepted_predictors(spark, d):
    rows = fx.mr_rows(spark, d).withColumn("x2", F.col("x") * F.col("x"))
    return se.accepted_sets(se.invariant_prediction(mo.moments(rows, ["y", "x", "x2", "u"])))


@query("iv_invariance_rob15", "ROB15", q.select([*LIN_BASE, f"ft AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM lb)')})",
       "rz AS (SELECT bun.site, bun.n, s_y__y - 2e0*theta*s_x__y + theta*theta*s_x__x AS rr, s_xhat__y - theta*s_x__xhat AS z0, s_xhat2__y - theta*s_x__xhat2 AS z1, s_xhat__xhat AS q00, s_xhat__xhat2 AS q01, s_xhat2__xhat2 AS q11 FROM bun, ft)",
       "ex AS (SELECT *, (z0*(q11*z0 - q01*z1) + z1*(q00*z1 - q01*z0))/(q00*q11 - q01*q01) AS ss FROM rz)"], f"SELECT 'linear' AS model, site, {q.rnd('(ss/2e0)/greatest(rr-ss, 1e-12)*(n-3)', 5)} AS f, CAST(n-3 AS BIGINT) AS df2 FROM ex"))
def iv_invariance(spark, d):
    return se.iv_invariance(bundle(spark, d), "linear").select("model", "site", r("f", 5).alias("f"), "df2")


IV_P = [*LIN_BASE, f"ft AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM lb)')})",
        "rz AS (SELECT bun.site, bun.n, s_y__y - 2e0*theta*s_x__y + theta*theta*s_x__x AS rr, s_xhat__y - theta*s_x__xhat AS z0, s_xhat2__y - theta*s_x__xhat2 AS z1, s_xhat__xhat AS q00, s_xhat__xhat2 AS q01, s_xhat2__xhat2 AS q11 FROM bun, ft)",
        "ex AS (SELECT *, (z0*(q11*z0 - q01*z1) + z1*(q00*z1 - q01*z0))/(q00*q11 - q01*q01) AS ss FROM rz)",
        "tp AS (SELECT site, pow(1e0 + 2e0*((ss/2e0)/greatest(rr-ss, 1e-12)*(n-3))/(n-3), -(n-3)/2e0) AS p FROM ex)"]


@query("iv_invariance_p_rob15b", "ROB15 UDF3", q.select(IV_P, f"SELECT site, {q.rnd('p', 9)} AS p FROM tp"))
def iv_invariance_p(spark, d):
    return se.iv_invariance(bundle(spark, d), "linear").select("site", r("p", 9).alias("p"))


@query("iv_invariant_sets_rob15c", "ROB15 SET3", q.select(IV_P, f"SELECT 'linear' AS model, 'x' AS predictors, {q.rnd('least(1e0, count(*)*min(p))', 8)} AS p, least(1e0, count(*)*min(p)) > 0.05 AS accepted FROM tp"))
def iv_invariant_sets(spark, d):
    return se.iv_invariant_sets(bundle(spark, d), ("linear",)).select("model", "predictors", r("p", 8).alias("p"), "accepted")


@query("iv_invariant_members_rob15d", "ROB15 SET3")
def iv_invariant_members(spark, d):
    """Both curves: what all accepted ones share, told apart from no accepted curve."""
    return se.invariant_members(se.iv_invariant_sets(bundle(spark, d)))


TAILS = """g AS (SELECT l_linenumber AS line, count(*) AS n, avg(y) AS m FROM mr GROUP BY 1),
v AS (SELECT line, m*k/2e0 AS x, 2*k AS df FROM g, (SELECT unnest(range(1, 5)) AS k)),
c AS (SELECT line, df, x, exp(-x/2e0)*list_sum(list_transform(range(0, df//2), lambda j: pow(x/2e0, j)/gamma(j + 1e0))) AS chi2,
  pow(1e0 + 2e0*x/(df + 5), -(df + 5)/2e0) AS f FROM v)"""


@query("even_tails_udf3c", "UDF3", q.select([q.MR, TAILS], f"SELECT line, CAST(df AS INT) AS df, {q.rnd('chi2', 10)} AS chi2, {q.rnd('f', 10)} AS f FROM c"))
def even_tails(spark, d):
    """Tails with an even number of degrees of freedom, which have closed forms, at statistics of the fact table."""
    from sitefold.functions import tails

    g = fx.mr_rows(spark, d).groupBy(F.col("l_linenumber").alias("line")).agg(F.avg("y").alias("m"))
    v = g.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("line", (F.col("m") * F.col("k") / 2.0).alias("x"), (2 * F.col("k")).cast("int").alias("df"))
    df = F.col("df").cast("double")
    return v.select("line", "df", r(tails.chi2_sf("x", df), 10).alias("chi2"), r(tails.f_sf("x", F.lit(2.0), df + 5), 10).alias("f"))


@query("dumbbell_rob16", "ROB16", q.select([*SITE_LIN, "fs1 AS (SELECT sum(theta/(se*se))/sum(1e0/(se*se)) AS fe FROM fo)"], f"SELECT site, {q.rnd('e/d')} AS naive, {q.rnd('theta')} AS iv, {q.rnd('1e0/se', 4)} AS precision, {q.rnd('theta - fe')} AS funnel FROM fo, fs1"))
def dumbbell(spark, d):
    from sitefold.operators import meta as ma

    w = se.working(linear(spark, d), "linear")
    f = se.two_sls(w, "linear")
    fe = ma.inverse_variance(f.select(F.col("theta_1").alias("theta"), F.col("se_1").alias("se"))).select("meta").scalar()
    o = se.ols(w, "linear").select("site", F.col("theta_1").alias("naive"))
    j = f.withColumn("_fe", fe).join(o, "site")
    return j.select("site", r("naive").alias("naive"), r("theta_1").alias("iv"), r(1.0 / F.col("se_1"), 4).alias("precision"), r(F.col("theta_1") - F.col("_fe")).alias("funnel"))


@query("random_effects_p_udf3", "UDF3 AGG14")
def random_effects_p(spark, d):
    from sitefold.operators import meta as ma
    from sitefold.plans.aggregates_queries import site_ivw

    return ma.random_effects(site_ivw(spark, d))


@query("certificate_p_udf3b", "UDF3 ROB11")
def certificate_p(spark, d):
    return se.with_p_values(se.certificate(se.working(linear(spark, d), "linear", "snps", fx.SNPS), "linear"))
