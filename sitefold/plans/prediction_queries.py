"""Control-function curves, federated averaging rounds, bootstrap and prediction metrics."""

from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.functions.scalars import r
from sitefold.operators import bootstrap as bs
from sitefold.operators import controlfn as cf
from sitefold.operators import curves as cv
from sitefold.operators import fedagg as fa
from sitefold.operators import metrics as me
from sitefold.operators import ordered as od
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query

ROW_ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y")

# fold 4 is the test split here, so both engines hold out the same rows
SPLIT_FS = [q.MR, "trn AS (SELECT * FROM mr WHERE fold < 4)", q.mom("mom", ["snp0", "snp1", "x"], ("site",), "trn"), q.fs(),
            "xh AS (SELECT mr.*, a0 + p0*mr.snp0 + p1*mr.snp1 AS xhat, x - (a0 + p0*mr.snp0 + p1*mr.snp1) AS resid FROM mr JOIN fs USING (site))"]


def split_rows(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("is_test", F.col("fold") == 4)
    return cf.first_stage(mr.filter(~F.col("is_test")), mr, fx.SNPS)


def _two(cols, name, src):
    """Within-site regression of y on two columns, as SQL."""
    a, b = cols
    items = ", ".join(f"sum({q.s(u, v)}) AS {q.s(u, v)}" for u, v in q.pairs([a, b, "y"]))
    t0, t1 = q.solve2((a, b), "y")
    return [q.mom(f"{name}m", [a, b, "y"], ("site",), src), f"{name} AS (SELECT {t0} AS t0, {t1} AS t1 FROM (SELECT {items} FROM {name}m))"]


@query("control_function_cf1", "CF1", q.select([*SPLIT_FS, "tr AS (SELECT site, y, x AS b1, x*x AS b2, xhat AS h1, xhat*xhat AS h2, resid FROM xh WHERE fold < 4)", *_two(("b1", "b2"), "nv", "tr"), *_two(("h1", "h2"), "sp", "tr"), *_two(("b1", "resid"), "ri", "tr")],
       f"SELECT 'naive' AS method, 1 AS j, {q.rnd('t0')} AS coef FROM nv UNION ALL SELECT 'naive', 2, {q.rnd('t1')} FROM nv UNION ALL SELECT '2sps', 1, {q.rnd('t0')} FROM sp UNION ALL SELECT '2sps', 2, {q.rnd('t1')} FROM sp UNION ALL SELECT '2sri', 1, {q.rnd('t0')} FROM ri UNION ALL SELECT '2sri', 2, {q.rnd('t1')} FROM ri"))
def control_function(spark, d):
    train = split_rows(spark, d).filter(~F.col("is_test"))
    out = None
    for method, degree in (("naive", 2), ("2sps", 2), ("2sri", 1)):
        rows, names = cf.design(train, method, degree)
        part = cf.fit_continuous(rows, names).select(F.lit(method).alias("method"), F.posexplode("coef").alias("j", "coef"))
        out = part if out is None else out.unionByName(part)
    return out.select("method", (F.col("j") + 1).alias("j"), r("coef").alias("coef"))


@query("hinge_curves_cf1b", "CF1", None)
def hinge_curves(spark, d):
    train = split_rows(spark, d).filter(~F.col("is_test"))
    rows, names = cf.design(train, "2sri", 1, (1.5, 2.5, 3.5))
    fit = cf.fit_continuous(rows, names)
    return cf.curve_from_coef(fit, 4, 1, (1.5, 2.5, 3.5))


@query("hinge_fit_cf1d", "CF1", q.select([*SPLIT_FS, "tr AS (SELECT site, y, x AS b1, greatest(x - 2.5e0, 0e0) AS b2 FROM xh WHERE fold < 4)", *_two(("b1", "b2"), "nv", "tr"), q.GRID61],
       f"SELECT k, {q.rnd('t0*x + t1*greatest(x - 2.5e0, 0e0)')} AS f FROM nv, grid"))
def hinge_fit(spark, d):
    rows, names = cf.design(split_rows(spark, d).filter(~F.col("is_test")), "naive", 1, (2.5,))
    return cf.curve_from_coef(cf.fit_continuous(rows, names), 2, 1, (2.5,)).select("k", r("f").alias("f"))


@query("first_stage_quality_cf2", "CF2", q.select([*SPLIT_FS, "tm AS (SELECT site, avg(x) AS m FROM mr WHERE fold = 4 GROUP BY site)"], f"""SELECT site, {q.rnd('1e0 - sum(CASE WHEN fold = 4 THEN resid*resid END)/sum(CASE WHEN fold = 4 THEN (x-m)*(x-m) END)')} AS fs_r2,
 {q.rnd('stddev_samp(CASE WHEN fold < 4 THEN xhat END)')} AS xhat_sd, count(*) FILTER (fold < 4) AS n_train, count(*) FILTER (fold = 4) AS n_test FROM xh JOIN tm USING (site) GROUP BY site"""))
def first_stage_quality(spark, d):
    g = cf.first_stage_quality(split_rows(spark, d))
    return g.select("site", r("fs_r2").alias("fs_r2"), r("xhat_sd").alias("xhat_sd"), "n_train", "n_test")


def irls_sql(steps: int = 7) -> str:
    """Unrolled reweighted least squares: two regressors and site intercepts."""
    ctes = [*SPLIT_FS, "d0 AS (SELECT site, CAST(yb AS DOUBLE) AS y, x AS b1, resid AS b2 FROM xh WHERE fold < 4)", "p0x AS (SELECT site, 0e0 AS a, 0e0 AS c1, 0e0 AS c2 FROM d0 GROUP BY site)"]
    for i in range(steps):
        ctes.append(f"e{i} AS (SELECT site, b1, b2, a, c1, c2, y - mu AS g, mu*(1e0-mu) AS w FROM (SELECT d0.*, a, c1, c2, 1e0/(1e0+exp(-(a + c1*b1 + c2*b2))) AS mu FROM d0 JOIN p{i}x USING (site)))")
        ctes.append(f"s{i} AS (SELECT site, max(a) AS a, max(c1) AS c1, max(c2) AS c2, sum(w) AS w, sum(g) AS g, sum(w*b1) AS w1, sum(w*b2) AS w2, sum(g*b1) AS g1, sum(g*b2) AS g2, sum(w*b1*b1) AS w11, sum(w*b1*b2) AS w12, sum(w*b2*b2) AS w22 FROM e{i} GROUP BY site)")
        ctes.append(f"h{i} AS (SELECT sum(w11-w1*w1/w) AS a, sum(w12-w1*w2/w) AS b, sum(w22-w2*w2/w) AS c, sum(g1-w1*g/w) AS e, sum(g2-w2*g/w) AS f FROM s{i})")
        ctes.append(f"z{i} AS (SELECT (c*e-b*f)/(a*c-b*b) AS z1, (a*f-b*e)/(a*c-b*b) AS z2, c/(a*c-b*b) AS v1, a/(a*c-b*b) AS v2 FROM h{i})")
        ctes.append(f"p{i + 1}x AS (SELECT site, s.a + (g - w1*z1 - w2*z2)/w AS a, c1 + z1 AS c1, c2 + z2 AS c2 FROM s{i} s, z{i})")
    last = steps - 1
    return q.select(ctes, f"SELECT 'b1' AS term, {q.rnd('max(c1)')} AS beta, {q.rnd('sqrt(max(v1))')} AS se FROM p{steps}x, z{last} UNION ALL SELECT 'resid', {q.rnd('max(c2)')}, {q.rnd('sqrt(max(v2))')} FROM p{steps}x, z{last}")


@query("logistic_second_stage_cf3", "CF3 CF1", irls_sql())
def logistic_second_stage(spark, d):
    rows, names = cf.design(split_rows(spark, d).filter(~F.col("is_test")), "2sri", 1)
    return cf.fit_binary(rows.drop("y").withColumnRenamed("yb", "y"), names).select("term", r("beta").alias("beta"), r("se").alias("se"))


@query("federated_average_cf4", "CF4 AGR1", q.select([q.UPD], f"SELECT round, j, {q.rnd('sum(weight*v)/sum(weight)')} AS v FROM upd GROUP BY round, j"))
def federated_average(spark, d):
    return fa.weighted_mean(fx.updates(spark, d)).select("round", "j", r("v").alias("v"))


# three rounds of local gradient steps on y ~ b x + c x2 within centred sites, averaged by site size
GD = [q.MR, "mq AS (SELECT *, x*x AS x2 FROM mr)", q.mom("mom", ["x", "x2", "y"], ("site",), "mq"), "g0 AS (SELECT 0e0 AS b, 0e0 AS c)"]
for _i in range(3):
    GD.append(f"u{_i} AS (SELECT n, b + 0.02e0*(s_x__y - b*s_x__x - c*s_x__x2)/n AS b, c + 0.02e0*(s_x2__y - b*s_x__x2 - c*s_x2__x2)/n AS c FROM mom, g{_i})")
    GD.append(f"g{_i + 1} AS (SELECT sum(n*b)/sum(n) AS b, sum(n*c)/sum(n) AS c FROM u{_i})")


@query("federated_rounds_cf4b", "CF4 AGR7", q.select(GD, " UNION ALL ".join(f"SELECT {i + 1} AS round, {q.rnd('b')} AS b, {q.rnd('c')} AS c FROM g{i + 1}" for i in range(3))))
def federated_rounds(spark, d):
    history, _ = gradient_rounds(spark, d)
    return history.select("round", r(F.col("vec")[0]).alias("b"), r(F.col("vec")[1]).alias("c"))


def gradient_rounds(spark, d, rounds: int = 3):
    """Local gradient steps on y ~ b x + c x2 within centred sites, averaged by site size; the loss of every global vector at every site."""
    from sitefold.operators import moments as mo
    from sitefold.runtime import cut

    m = cut(mo.moments(fx.mr_rows(spark, d).withColumn("x2", F.col("x") * F.col("x")), ["x", "x2", "y"]))
    b, c = F.col("g")[0], F.col("g")[1]

    def message(at, vec):
        db = 0.02 * (mo.S("x", "y") - b * mo.S("x", "x") - c * mo.S("x", "x2")) / F.col("n")
        dc = 0.02 * (mo.S("x2", "y") - b * mo.S("x", "x2") - c * mo.S("x2", "x2")) / F.col("n")
        return m.withColumn("g", vec.scalar()).select(F.lit(at).alias("round"), "site", F.array(db, dc).alias("vec"), F.col("n").cast("double").alias("weight"))

    def evaluate(at, vec):
        rss = mo.S("y", "y") - 2 * (b * mo.S("x", "y") + c * mo.S("x2", "y")) + b * b * mo.S("x", "x") + 2 * b * c * mo.S("x", "x2") + c * c * mo.S("x2", "x2")
        return m.withColumn("g", vec.scalar()).select(F.lit(at).alias("round"), "site", "n", (rss / F.col("n")).alias("mse"))

    return fa.run_rounds(m.select("site", F.col("n").alias("n")), m.limit(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("vec")), message, rounds, evaluate)


@query("federated_evaluation_cf4c", "CF4 AGG17", q.select(GD, " UNION ALL ".join(f"SELECT {i} AS round, site, n, {q.rnd('(s_y__y - 2e0*(b*s_x__y + c*s_x2__y) + b*b*s_x__x + 2e0*b*c*s_x__x2 + c*c*s_x2__x2)/n')} AS mse FROM mom, g{i}" for i in range(4))))
def federated_evaluation(spark, d):
    """The last pass only evaluates: four vectors for three rounds."""
    return gradient_rounds(spark, d)[1].select("round", "site", "n", r("mse").alias("mse"))


@query("bootstrap_band_cf5", "CF5 AGG22")
def bootstrap_band(spark, d):
    train = fx.mr_rows(spark, d).filter("fold < 4")
    m = bs.replicate_moments(train, ["snp0", "snp1", "x", "y"], ROW_ID, 50, 1)
    return cv.percentile_band(bs.replicate_curves(bs.two_stage(m, fx.SNPS, "2sri")))


@query("bootstrap_interval_cf5b", "CF5 AGG24")
def bootstrap_interval(spark, d):
    train = fx.mr_rows(spark, d).filter("fold < 4")
    m = bs.replicate_moments(train, ["snp0", "snp1", "x", "y"], ROW_ID, 50, 1)
    return cv.parameter_interval(bs.two_stage(m, fx.SNPS, "2sps"))


@query("bootstrap_draws_cf5c", "CF5", q.select([q.MR], "SELECT CAST(rep AS INT) AS rep, site, count(*) AS draws FROM mr, (SELECT unnest(range(200)) AS rep) WHERE fold < 4 GROUP BY rep, site"))
def bootstrap_draws(spark, d):
    return bs.draws(fx.mr_rows(spark, d).filter("fold < 4"), ROW_ID, 200, 1)


@query("bootstrap_curved_cf5d", "CF5 AGG22 CF1")
def bootstrap_curved(spark, d):
    """Bands of quadratic curves by the three methods, 200 exact replicates each."""
    train, out = fx.mr_rows(spark, d).filter("fold < 4"), None
    for method, fits in bs.curves_by_method(train, fx.SNPS, ROW_ID, 200, cf.METHODS, 2, (), 1).items():
        band = cv.percentile_band(cf.curve_from_coef(fits, 2, 2, (), ("rep",))).withColumn("method", F.lit(method))
        out = band if out is None else out.unionByName(band)
    return out


@query("regression_metrics_met1", "MET1", q.select([q.MR], f"SELECT site, {q.rnd('avg((y-0.9e0*x)*(y-0.9e0*x))')} AS mse, {q.rnd('avg(abs(y-0.9e0*x))')} AS mae, {q.rnd('1e0 - sum((y-0.9e0*x)*(y-0.9e0*x))/(var_pop(y)*count(*))')} AS r2 FROM mr GROUP BY site"))
def regression_metrics(spark, d):
    p = fx.mr_rows(spark, d).withColumn("pred", 0.9 * F.col("x"))
    return me.regression(p, "pred", "y", ("site",)).select("site", r("mse").alias("mse"), r("mae").alias("mae"), r("r2").alias("r2"))


PRED = [q.MR, "mx AS (SELECT avg(x) AS m FROM mr)", "pd AS (SELECT site, yb, 1e0/(1e0+exp(-(x-m))) AS p FROM mr, mx)"]


def pred(spark, d):
    mr = fx.mr_rows(spark, d)
    return mr.withColumn("_m", mr.agg(F.avg("x")).scalar()).withColumn("p", sc.expit(F.col("x") - F.col("_m")))


@query("classification_metrics_met2", "MET2", q.select([*PRED, "c AS (SELECT site, count(*) AS n, count(*) FILTER (p>=0.5e0 AND yb=1) AS tp, count(*) FILTER (p>=0.5e0 AND yb=0) AS fp, count(*) FILTER (p<0.5e0 AND yb=1) AS fn FROM pd GROUP BY site)"],
       f"SELECT site, n, {q.rnd('(n-fp-fn)*1e0/n')} AS accuracy, {q.rnd('CASE WHEN tp+fp>0 THEN tp*1e0/(tp+fp) ELSE 0 END')} AS precision, {q.rnd('CASE WHEN tp+fn>0 THEN tp*1e0/(tp+fn) ELSE 0 END')} AS recall, {q.rnd('2e0*tp/(2*tp+fp+fn)')} AS f1 FROM c"))
def classification_metrics(spark, d):
    c = me.classification(pred(spark, d), "p", "yb", ("site",))
    return c.select("site", "n", *[r(v).alias(v) for v in ("accuracy", "precision", "recall", "f1")])


@query("auc_overall_met3", "MET3 WIN7", q.select([q.MR, "rk AS (SELECT yb, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2e0 AS rr FROM mr)"],
       f"SELECT CAST(sum(yb) AS BIGINT) AS n_pos, {q.rnd('(sum(CASE WHEN yb=1 THEN rr END) - sum(yb)*(sum(yb)+1)/2e0)/(sum(yb)*1e0*(count(*)-sum(yb)))')} AS auc FROM rk"))
def auc_overall(spark, d):
    return od.auc(pred(spark, d), "x", "yb").select("n_pos", r("auc").alias("auc"))


MIA = [q.MR, "sl AS (SELECT site, CAST(fold < 4 AS INT) AS m, (0.3e0*x - y)*(0.3e0*x - y) - (0.9e0*x - y)*(0.9e0*x - y) AS s FROM mr)", "rk AS (SELECT site, m, rank() OVER (PARTITION BY site ORDER BY s) + (count(*) OVER (PARTITION BY site, s) - 1)/2e0 AS rr FROM sl)"]


@query("membership_auc_met4", "MET4 PRV4", q.select(MIA, f"SELECT site, {q.rnd('(sum(CASE WHEN m=1 THEN rr END) - sum(m)*(sum(m)+1)/2e0)/(sum(m)*1e0*(count(*)-sum(m)))')} AS auc FROM rk GROUP BY site"))
def membership_auc(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("member", (F.col("fold") < 4).cast("int"))
    a = me.membership_auc(mr, 0.3 * F.col("x"), 0.9 * F.col("x"), "y", "member", False, ("site",))
    return a.select("site", r("auc").alias("auc"))
