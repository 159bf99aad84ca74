"""Projections and scalar expressions over rows, vectors and curve grids."""

from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.functions.scalars import r
from sitefold.operators import controlfn as cf
from sitefold.operators import curves as cv
from sitefold.operators import fedagg as fa
from sitefold.operators import iv
from sitefold.operators import moments as mo
from sitefold.operators import privacy as pv
from sitefold.operators import sensitivity as se
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query
from sitefold.runtime import cut
from sitefold.plans.scans_queries import CURVES
from sitefold.operators import metrics as me


@query("centre_within_prj1", "PRJ1", q.select([q.MR, "m AS (SELECT site, avg(x) AS mx, avg(y) AS my FROM mr GROUP BY site)"],
       f"""SELECT site, count(*) AS n, {q.rnd('sum((x-mx)*(x-mx))', 4)} AS sxx, {q.rnd('sum((x-mx)*(y-my))', 4)} AS sxy, {q.rnd('abs(sum(x-mx))', 4)} AS zero
  FROM mr JOIN m USING (site) GROUP BY site"""))
def centre_within(spark, d):
    c = mo.centre_within(fx.mr_rows(spark, d).select("site", "x", "y"), ["x", "y"])
    return c.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x_c") * F.col("x_c")), 4).alias("sxx"),
                                 r(F.sum(F.col("x_c") * F.col("y_c")), 4).alias("sxy"), r(F.abs(F.sum("x_c")), 4).alias("zero"))


@query("basis_expansion_prj2", "PRJ2", "WITH " + q.local_rows() + f"""
SELECT site, {q.rnd('avg(x2)')} AS x2, {q.rnd('avg(xhat)')} AS xhat, {q.rnd('avg(xhat2)')} AS xhat2, {q.rnd('covar_pop(xhat2, x2)')} AS c FROM xh GROUP BY site""")
def basis_expansion(spark, d):
    rows = fx.local_rows(fx.mr_rows(spark, d))
    iv.generated_design("quadratic")
    return rows.groupBy("site").agg(r(F.avg("x2")).alias("x2"), r(F.avg("xhat")).alias("xhat"), r(F.avg("xhat2")).alias("xhat2"),
                                    r(F.covar_pop("xhat2", "x2")).alias("c"))


SHARED = ["snp0", "snp1", "c1", "x", "y"]
LONG_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {q.rnd(q.s(a, b), 4)} AS sxy FROM tot" for a, b in q.pairs(SHARED))


@query("shared_design_prj3", "PRJ3 AGG4", q.select([q.MR, q.mom("mom", SHARED), q.total("tot", SHARED, "mom")], LONG_SQL))
def shared_design(spark, d):
    design = iv.shared_design(fx.SNPS, ["c1"])
    long = mo.to_long(mo.moments(fx.mr_rows(spark, d), design.columns))
    return mo.sum_long(long).select("a", "b", r("sxy", 4).alias("sxy"))


def _xh(body):
    return "WITH " + q.local_rows() + "\n" + body


@query("linear_prediction_prj4", "PRJ4", _xh(f"SELECT site, {q.rnd('avg(xhat)')} AS mean_xhat, {q.rnd('var_pop(xhat)')} AS var_xhat, {q.rnd('covar_pop(xhat, y)')} AS cov_y FROM xh GROUP BY site"))
def linear_prediction(spark, d):
    rows = fx.local_rows(fx.mr_rows(spark, d))
    return rows.groupBy("site").agg(r(F.avg("xhat")).alias("mean_xhat"), r(F.var_pop("xhat")).alias("var_xhat"), r(F.covar_pop("xhat", "y")).alias("cov_y"))


GLOBAL_FS = [q.MR, q.mom("mom", ["snp0", "snp1", "x"]), q.total("tot", ["snp0", "snp1", "x"], "mom"),
             f"pi AS (SELECT {q.solve2(('snp0', 'snp1'), 'x')[0]} AS p0, {q.solve2(('snp0', 'snp1'), 'x')[1]} AS p1 FROM tot)",
             "fs AS (SELECT site, p0, p1, m_x - p0*m_snp0 - p1*m_snp1 AS a0 FROM mom, pi)", q.XH]


@query("global_prediction_prj4b", "PRJ4 AGG6", q.select(GLOBAL_FS, f"SELECT site, {q.rnd('avg(xhat)')} AS mean_xhat, {q.rnd('var_pop(xhat)')} AS var_xhat, {q.rnd('covar_pop(xhat, x)')} AS cov_x FROM xh GROUP BY site"))
def global_prediction(spark, d):
    mr = fx.mr_rows(spark, d)
    fs = cut(iv.global_first_stage(mo.moments(mr, [*fx.SNPS, "x"]), fx.SNPS))
    rows = iv.predict_rows(mr, fs, fx.SNPS, ("site",))
    return rows.groupBy("site").agg(r(F.avg("xhat")).alias("mean_xhat"), r(F.var_pop("xhat")).alias("var_xhat"), r(F.covar_pop("xhat", "x")).alias("cov_x"))


@query("first_stage_residual_prj5", "PRJ5", _xh(f"SELECT site, {q.rnd('sum(resid*resid)', 4)} AS rss, {q.rnd('sum(resid*y)', 4)} AS ry FROM xh GROUP BY site"))
def first_stage_residual(spark, d):
    rows = fx.local_rows(fx.mr_rows(spark, d))
    return rows.groupBy("site").agg(r(F.sum(F.col("resid") * F.col("resid")), 4).alias("rss"), r(F.sum(F.col("resid") * F.col("y")), 4).alias("ry"))


@query("perturbed_outcome_prj6", "PRJ6", q.select([q.MR, "g AS (SELECT site, avg(snp0) AS m0 FROM mr GROUP BY site)",
       """p AS (SELECT site, x, y + CASE WHEN site IN (0, 1) THEN 0.4e0*(snp0 - m0) ELSE 0e0 END + CASE WHEN site = 2 THEN 0.25e0*x ELSE 0e0 END
   + CASE WHEN site = 3 THEN 5e0 ELSE 0e0 END + CASE WHEN site = 4 THEN 1.5e0*u ELSE 0e0 END AS y FROM mr JOIN g USING (site))"""],
       f"SELECT site, {q.rnd('avg(y)')} AS my, {q.rnd('regr_slope(y, x)')} AS slope FROM p GROUP BY site"))
def perturbed_outcome(spark, d):
    p = se.perturb(fx.mr_rows(spark, d), ["snp0"], 0.4, [0, 1], 2, 0.25, 3, 5.0, 4, 1.5)
    return p.groupBy("site").agg(r(F.avg("y")).alias("my"), r(F.regr_slope("y", "x")).alias("slope"))


@query("dose_response_prj7", "PRJ7", q.select([*CURVES, "sh AS (SELECT unnest(['linear', 'quadratic', 'threshold']) AS shape)"], f"""
SELECT site, round, shape, k, {q.rnd("CASE shape WHEN 'quadratic' THEN t1*x + t2*x*x WHEN 'threshold' THEN t1*least(x, t2) ELSE t1*x END")} AS f,
  CASE WHEN site = 0 THEN NULL ELSE {q.rnd('t1*x')} END AS f_if_not_binary FROM params, grid, sh"""))
def dose_response(spark, d):
    p = fx.curve_params(fx.mr_rows(spark, d)).withColumn("shape", F.explode(F.array(*[F.lit(s) for s in ("linear", "quadratic", "threshold")])))
    g = cv.with_grid(p)
    f = sc.dose_response(F.col("shape"), F.col("x"), F.col("t1"), F.col("t2"))
    nb = sc.dose_response("linear", F.col("x"), F.col("t1"), F.col("t2"), F.col("site") == 0)
    return g.select("site", "round", "shape", "k", r(f).alias("f"), r(nb).alias("f_if_not_binary"))


@query("x_grids_prj8", "PRJ8", q.select([q.MR, q.GRID61, q.GRID200, "ms AS (SELECT site, avg(x) AS mx FROM mr GROUP BY site)"], f"""
SELECT site, 61 AS points, k, {q.rnd('mx + x')} AS x FROM ms, grid UNION ALL SELECT site, 200, k, {q.rnd('mx + x')} FROM ms, fine"""))
def x_grids(spark, d):
    m = fx.mr_rows(spark, d).groupBy("site").agg(F.avg("x").alias("mx"))
    parts = [cv.with_grid(m, g).select("site", F.lit(g[2]).alias("points"), "k", r(F.col("mx") + F.col("x")).alias("x")) for g in (cv.X_GRID, cv.FINE_GRID)]
    return parts[0].unionByName(parts[1])


@query("interpolate_prj9", "PRJ9 JON11", q.select([*CURVES, q.GRID200, "pts AS (SELECT site, round, x FROM params, fine)",
       "lo AS (SELECT p.site, p.round, p.x, c.x AS x0, c.f AS f0 FROM pts p ASOF LEFT JOIN curves c ON p.site=c.site AND p.round=c.round AND p.x >= c.x)",
       "hi AS (SELECT p.site, p.round, p.x, c.x AS x1, c.f AS f1 FROM pts p ASOF LEFT JOIN curves c ON p.site=c.site AND p.round=c.round AND p.x <= c.x)"],
       f"""SELECT lo.site, lo.round, {q.rnd('lo.x')} AS x, {q.rnd('CASE WHEN x1 = x0 THEN f0 ELSE f0 + (lo.x-x0)/(x1-x0)*(f1-f0) END')} AS f
  FROM lo JOIN hi ON lo.site=hi.site AND lo.round=hi.round AND lo.x=hi.x"""))
def interpolate(spark, d):
    mr = fx.mr_rows(spark, d)
    pts = cv.with_grid(fx.curve_params(mr), cv.FINE_GRID).select("site", "round", "x")
    return cv.interpolate(fx.curves(mr), pts, ("site", "round")).select("site", "round", r("x").alias("x"), r("f").alias("f"))


KNOTS = "kn AS (SELECT site, floor(x*20e0)/20e0 AS x, avg(y) AS f FROM mr GROUP BY 1, 2)"


@query("interpolate_rows_jon11b", "JON11 PRJ9", q.select([q.MR, KNOTS,
       "lo AS (SELECT p.site, p.x, count(*) AS n, max(c.x) AS x0, max(c.f) AS f0 FROM mr p ASOF LEFT JOIN kn c ON p.site=c.site AND p.x >= c.x GROUP BY 1, 2)",
       "hi AS (SELECT p.site, p.x, max(c.x) AS x1, max(c.f) AS f1 FROM mr p ASOF LEFT JOIN kn c ON p.site=c.site AND p.x <= c.x GROUP BY 1, 2)"],
       f"""SELECT lo.site, {q.rnd('lo.x')} AS x, n, {q.rnd('CASE WHEN x1 IS NULL THEN f0 WHEN x1 = x0 THEN f0 ELSE f0 + (lo.x-x0)/(x1-x0)*(f1-f0) END')} AS f
  FROM lo JOIN hi ON lo.site=hi.site AND lo.x=hi.x"""))
def interpolate_rows(spark, d):
    """Every row of the fact table as a point on its site's curve."""
    mr = fx.mr_rows(spark, d)
    knots = mr.groupBy("site", (F.floor(F.col("x") * 20.0) / 20.0).alias("x")).agg(F.avg("y").alias("f"))
    out = cv.interpolate(knots, mr.select("site", "x"), ("site",))
    return out.groupBy("site", "x").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f")).select("site", r("x").alias("x"), "n", r("f").alias("f"))


@query("anchored_curve_prj10", "PRJ10", q.select(CURVES, f"SELECT c.site, c.round, c.k, {q.rnd('c.f - z.f')} AS f FROM curves c JOIN (SELECT * FROM curves WHERE k = 30) z USING (site, round)"))
def anchored_curve(spark, d):
    return cv.anchor(fx.curves(fx.mr_rows(spark, d)), ("site", "round")).select("site", "round", "k", r("f").alias("f"))


@query("range_filter_prj11", "PRJ11", q.select(CURVES, f"SELECT site, count(*) AS n, {q.rnd('sum(f)')} AS total, count(*) FILTER (abs(x) <= 2e0 + 1e-9) AS n_slack FROM curves WHERE abs(x) <= 2e0 + 1e-9 GROUP BY site"))
def range_filter(spark, d):
    c = fx.curves(fx.mr_rows(spark, d)).filter(sc.within_range(F.col("x"), cv.X_MAX, sc.RANGE_SLACK))
    return c.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.sum("f")).alias("total"),
                                 F.count(F.when(sc.within_range(F.col("x"), cv.X_MAX, sc.RANGE_SLACK), 1)).alias("n_slack"))


@query("logit_scale_prj12", "PRJ12", q.select([q.MR], f"""SELECT site, {q.rnd('avg(1e0/(1e0+exp(-(x-3e0))))')} AS expit,
 {q.rnd('avg(ln(least(greatest(yb, 1e-6), 1e0-1e-6)/(1e0-least(greatest(yb, 1e-6), 1e0-1e-6))))')} AS logit,
 {q.rnd('avg(least(greatest(1e0/(1e0+exp(-(ln((u+0.1e0)/(1e0-(u+0.1e0))) + x - 3e0))), 0.02e0), 0.98e0))')} AS shifted FROM mr GROUP BY site"""))
def logit_scale(spark, d):
    mr = fx.mr_rows(spark, d)
    return mr.groupBy("site").agg(r(F.avg(sc.expit(F.col("x") - 3.0))).alias("expit"), r(F.avg(sc.logit(F.col("yb").cast("double")))).alias("logit"),
                                  r(F.avg(sc.shift_frequency(F.col("u") + 0.1, F.col("x") - 3.0))).alias("shifted"))


@query("liability_threshold_prj13", "PRJ13", q.select([q.MR, "st AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM mr)",
       "z AS (SELECT site, (y-m)/s AS z FROM mr, st)", "cut AS (SELECT quantile_cont(z, 0.9e0) AS c FROM z)"],
       f"SELECT site, CAST(sum(CAST(z > c AS INT)) AS BIGINT) AS cases, count(*) AS n, {q.rnd('avg(z)')} AS mean_z FROM z, cut GROUP BY site"))
def liability_threshold(spark, d):
    lab = cf.liability_labels(fx.mr_rows(spark, d), "y", 0.1)
    return lab.groupBy("site").agg(F.sum("label").alias("cases"), F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("mean_z"))


def bisection_sql(steps: int = 40) -> str:
    """Unrolled bisection for the intercept with mean(expit(a + x)) = 0.2."""
    ctes = [q.MR, "b0 AS (SELECT -20e0 AS lo, 20e0 AS hi)"]
    for i in range(steps):
        ctes.append(f"v{i} AS (SELECT max(lo) AS lo, max(hi) AS hi, avg(1e0/(1e0+exp(-((lo+hi)/2e0 + x)))) AS p FROM mr, b{i})")
        ctes.append(f"b{i + 1} AS (SELECT CASE WHEN p < 0.2e0 THEN (lo+hi)/2e0 ELSE lo END AS lo, CASE WHEN p < 0.2e0 THEN hi ELSE (lo+hi)/2e0 END AS hi FROM v{i})")
    return q.select(ctes, f"SELECT {q.rnd('max((lo+hi)/2e0)', 3)} AS intercept, {q.rnd('avg(1e0/(1e0+exp(-((lo+hi)/2e0 + x))))', 5)} AS prevalence FROM mr, b{steps}")


@query("prevalence_intercept_prj14", "PRJ14", bisection_sql())
def prevalence_intercept(spark, d):
    mr = fx.mr_rows(spark, d)
    a = cf.calibrate_intercept(mr, "x", 0.2)
    return mr.agg(r(F.lit(a), 3).alias("intercept"), r(F.avg(sc.expit(F.lit(a) + F.col("x"))), 5).alias("prevalence"))


@query("clip_to_norm_prj15", "PRJ15", q.select([q.EMB, "nv AS (SELECT vec_id, sqrt(sum(v*v)) AS nrm FROM emb GROUP BY vec_id)"],
       f"SELECT vec_id, {q.rnd('nrm')} AS norm, {q.rnd('nrm*least(1e0, 0.75e0/greatest(nrm, 1e-12))')} AS clipped_norm, nrm > 0.75e0 AS clipped FROM nv"))
def clip_to_norm(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    b = F.lit(0.75)
    return e.select("vec_id", r(sc.norm(F.col("vec"))).alias("norm"), r(sc.norm(sc.clip_to_norm(F.col("vec"), b))).alias("clipped_norm"),
                    (sc.norm(F.col("vec")) > b).alias("clipped"))


@query("fixed_point_prj16", "PRJ16", "SELECT l_suppkey, CAST(sum(CAST(round_even(l_tax*l_quantity*16777216e0, 0) AS BIGINT)) AS BIGINT) AS encoded, "
       f"{q.rnd('sum(CAST(round_even(l_tax*l_quantity*16777216e0, 0) AS BIGINT)/16777216e0)')} AS decoded FROM lineitem GROUP BY l_suppkey")
def fixed_point(spark, d):
    e = fx.table(spark, d, "lineitem").select("l_suppkey", sc.fixed_encode(F.col("l_tax") * F.col("l_quantity"), 24).alias("e"))
    return e.groupBy("l_suppkey").agg(F.sum("e").alias("encoded"), r(F.sum(sc.fixed_decode(F.col("e"), 24))).alias("decoded"))


@query("parameter_vector_prj17", "PRJ17", q.select([*CURVES, "p AS (SELECT site, round, t1, t2 FROM params)"],
       f"SELECT site, round, 0 AS j, {q.rnd('t1 + t2')} AS v FROM p UNION ALL SELECT site, round, 1, {q.rnd('t2 + t1')} FROM p UNION ALL SELECT site, round, 2, {q.rnd('t1 + 1e0')} FROM p"))
def parameter_vector(spark, d):
    p = fx.curve_params(fx.mr_rows(spark, d))
    v = sc.flatten_params(F.array("t1", "t2"), F.array("t1"))
    delta = sc.flatten_params(F.array("t2", "t1"), F.array(F.lit(1.0)))
    return p.select("site", "round", F.posexplode(sc.add(v, delta)).alias("j", "v")).select("site", "round", "j", r("v").alias("v"))


@query("update_stress_prj18", "PRJ18", q.select([q.UPD], f"""SELECT 'sign_flip' AS kind, round, site, {q.rnd('sum(-10e0*v)')} AS total, {q.rnd('sqrt(sum(100e0*v*v))')} AS norm FROM upd GROUP BY round, site
 UNION ALL SELECT 'scale', round, site, {q.rnd('sum(3e0*v)')}, {q.rnd('sqrt(sum(9e0*v*v))')} FROM upd GROUP BY round, site"""))
def update_stress(spark, d):
    u = fx.updates(spark, d)
    out = None
    for kind, s in (("sign_flip", 10.0), ("scale", 3.0)):
        p = pv.poison(u, kind, s).select(F.lit(kind).alias("kind"), "round", "site",
                                         r(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b)).alias("total"), r(sc.norm(F.col("vec"))).alias("norm"))
        out = p if out is None else out.unionByName(p)
    return out


@query("outcome_flip_prj19", "PRJ19", q.select([q.MR], f"SELECT site, {q.rnd('regr_slope(-y, x)')} AS slope, {q.rnd('avg(1-yb)')} AS flipped FROM mr GROUP BY site"))
def outcome_flip(spark, d):
    mr = pv.flip_outcome(pv.flip_outcome(fx.mr_rows(spark, d)), "yb", True)
    return mr.groupBy("site").agg(r(F.regr_slope("y", "x")).alias("slope"), r(F.avg("yb")).alias("flipped"))


@query("outcome_shuffle_prj19b", "PRJ19", q.select([q.SURV], f"SELECT site, count(*) AS n, {q.rnd('avg(time)')} AS mean_time, CAST(sum(event) AS BIGINT) AS events, {q.rnd('avg(x)')} AS mean_x, {q.rnd('covar_pop(time, event)', 4)} AS paired FROM sv GROUP BY site"))
def outcome_shuffle(spark, d):
    s = pv.shuffle_outcomes(fx.mr_surv(spark, d), ["time", "event"], ["snp0", "snp1", "snp2", "x", "u"], 7)
    return s.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.avg("time")).alias("mean_time"), F.sum("event").alias("events"),
                                 r(F.avg("x")).alias("mean_x"), r(F.covar_pop("time", "event"), 4).alias("paired"))


@query("cosine_prj20", "PRJ20", q.select([q.UPD, "g AS (SELECT round, j, sum(weight*v)/sum(weight) AS gv FROM upd GROUP BY round, j)"],
       f"SELECT round, site, {q.rnd('sum(v*gv)/(sqrt(sum(v*v))*sqrt(sum(gv*gv)))')} AS cos, NULL::DOUBLE AS with_zero FROM upd JOIN g USING (round, j) GROUP BY round, site"))
def cosine(spark, d):
    u = fx.updates(spark, d)
    g = fa.to_vectors(fa.weighted_mean(u)).withColumnRenamed("vec", "gv")
    return u.join(g, "round").select("round", "site", r(sc.cosine(F.col("vec"), F.col("gv"))).alias("cos"),
                                     sc.cosine(F.col("vec"), sc.scale(F.col("vec"), F.lit(0.0))).alias("with_zero"))


@query("record_loss_prj21", "PRJ21", q.select([q.MR], f"SELECT site, {q.rnd('avg((0.3e0*x-y)*(0.3e0*x-y))')} AS mse, {q.rnd('avg(greatest(x-3e0, 0e0) - (x-3e0)*yb + ln(1e0+exp(-abs(x-3e0))))')} AS bce FROM mr GROUP BY site"))
def record_loss(spark, d):
    mr = fx.mr_rows(spark, d)
    return mr.groupBy("site").agg(r(F.avg(sc.squared_error(0.3 * F.col("x"), F.col("y")))).alias("mse"),
                                  r(F.avg(sc.logistic_loss(F.col("x") - 3.0, F.col("yb").cast("double")))).alias("bce"))


@query("scenario_names_prj22", "PRJ22", f"""WITH t AS (SELECT lower(p_type) || '|' || p_brand || '_z' || CAST(p_size/4e0 AS VARCHAR) AS scenario FROM part)
SELECT split_part(scenario, '|', 1) AS attack, count(*) AS n, {q.rnd("sum(CAST(regexp_extract(scenario, '_z([0-9.]+)$', 1) AS DOUBLE))")} AS levels,
  CAST(sum(CAST(starts_with(scenario, 'eco') AS INT)) AS BIGINT) AS eco FROM t GROUP BY 1""")
def scenario_names(spark, d):
    s = fx.table(spark, d, "part").select(F.concat(F.lower("p_type"), F.lit("|"), F.col("p_brand"), F.lit("_z"), (F.col("p_size") / 4.0).cast("string")).alias("scenario"))
    return s.groupBy(F.split("scenario", "\\|")[0].alias("attack")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(me.scenario_level())).alias("levels"), F.sum(F.startswith("scenario", F.lit("eco")).cast("int")).alias("eco"))


@query("public_weights_prj23", "PRJ23", q.select([q.MR, "n AS (SELECT site, count(*) AS n FROM mr GROUP BY site)"],
       f"SELECT site, {q.rnd('n/(sum(n) OVER ())')} AS registered, {q.rnd('1e0/(count(*) OVER ())')} AS uniform, {q.rnd('n*CASE WHEN site = 0 THEN 5e0 ELSE 1e0 END')} AS reported FROM n"))
def public_weights(spark, d):
    n = fx.mr_rows(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    w = fa.public_weights(n).withColumnRenamed("w", "registered")
    w = fa.public_weights(w, "uniform").withColumnRenamed("w", "uniform")
    return w.select("site", r("registered").alias("registered"), r("uniform").alias("uniform"),
                    r(F.col("n") * F.when(F.col("site") == 0, 5.0).otherwise(1.0)).alias("reported"))


@query("curve_support_prj24", "PRJ24", "WITH " + q.local_rows() + ",\n" + ",\n".join(CURVES[1:]) + f""",
lim AS (SELECT 2e0*max(sd) AS m FROM (SELECT stddev_samp(xhat) AS sd FROM xh GROUP BY site))
SELECT site, round, {q.rnd('max(m)')} AS lim, CAST(sum(CAST(abs(x) <= m AS INT)) AS BIGINT) AS inside, count(*) AS n FROM curves, lim GROUP BY site, round""")
def curve_support(spark, d):
    mr = fx.mr_rows(spark, d)
    sd = fx.local_rows(mr).groupBy("site").agg(F.stddev_samp("xhat").alias("xhat_sd"))
    c = cv.support_flag(fx.curves(mr), sd)
    return c.groupBy("site", "round").agg(r(F.max("limit")).alias("lim"), F.sum(F.col("supported").cast("int")).alias("inside"), F.count(F.lit(1)).alias("n"))
