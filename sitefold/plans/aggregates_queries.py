"""Per-site statistics, their combination, and the scoring tables."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import curves as cv
from sitefold.operators import gwas as gw
from sitefold.operators import iv
from sitefold.operators import meta as ma
from sitefold.operators import metrics as me
from sitefold.operators import moments as mo
from sitefold.operators.ordered import bucket_count
from sitefold.operators import sensitivity as se
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.joins_queries import BAND_SQL, REPS_SQL, TRUTH_SQL, boot, truth
from sitefold.plans.registry import query
from sitefold.plans.scans_queries import CURVES, gwas_sql
from sitefold.runtime import scratch_path
from sitefold.sources import sites

ALL_SNPS = ("snp0", "snp1", "snp2")


def cols(df, names, digits=6, **special):
    return df.select(*[r(n, special.get(n, digits)).alias(n) for n in names])


@query("gwas_agg1", "AGG1", q.select([q.MR, gwas_sql(ALL_SNPS)], f"SELECT site, snp, n, {q.rnd('beta_x')} AS beta_x, {q.rnd('se_x')} AS se_x, {q.rnd('beta_y')} AS beta_y, {q.rnd('se_y')} AS se_y FROM gw"))
def gwas(spark, d):
    g = gw.gwas(fx.mr_rows(spark, d), ALL_SNPS)
    return g.select("site", "snp", "n", *[r(c).alias(c) for c in ("beta_x", "se_x", "beta_y", "se_y")])


@query("gwas_packed_agg1b", "AGG1 SRC2", q.select([q.MR, gwas_sql(ALL_SNPS)], f"SELECT site, snp, n, {q.rnd('beta_x')} AS beta_x, {q.rnd('se_x')} AS se_x, {q.rnd('beta_y')} AS beta_y, {q.rnd('se_y')} AS se_y FROM gw"))
def gwas_packed(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("g", F.array(*[F.col(s).cast("double") for s in ALL_SNPS]))
    g = gw.gwas_long(mr)
    return g.select("site", "snp", "n", *[r(c).alias(c) for c in ("beta_x", "se_x", "beta_y", "se_y")])


@query("naive_slope_agg2", "AGG2", q.select([q.MR], f"SELECT site, count(*) AS n, {q.rnd('covar_samp(x,y)/var_samp(x)')} AS naive FROM mr GROUP BY site"))
def naive_slope(spark, d):
    return gw.naive_slope(fx.mr_rows(spark, d)).select("site", "n", r("naive").alias("naive"))


MCOLS = ["snp0", "snp1", "c1", "x", "y"]


@query("site_moments_agg3", "AGG3", q.select([q.MR, q.mom("mom", MCOLS)], "SELECT site, n, " + ", ".join(f"{q.rnd(q.s(a, b), 4)} AS {q.s(a, b)}" for a, b in q.pairs(MCOLS)) + " FROM mom"))
def site_moments(spark, d):
    m = mo.moments(fx.mr_rows(spark, d), MCOLS)
    return m.select("site", "n", *[r(c, 4).alias(c) for c in mo.stat_columns(m)])


@query("wide_moments_agg3b", "AGG3", q.select([q.MR, q.mom("mom", MCOLS)], "SELECT site, n, " + ", ".join(f"{q.rnd(q.s(a, b), 4)} AS {q.s(a, b)}" for a, b in q.pairs(MCOLS)) + " FROM mom"))
def wide_moments(spark, d):
    m = mo.moments_blocked(fx.mr_rows(spark, d), MCOLS)
    return m.select("site", "n", *[r(c, 4).alias(c) for c in mo.stat_columns(m)])


# forty columns of the fact table, each pair of them; five hundred of the customers, where a row total sums a column's products with all
FORTY = [f"({k + 3}*l_partkey + {k * k}*l_linenumber + l_suppkey) % {5 + k % 7}" for k in range(40)]
HUNDREDS = [f"({k + 1}*c_custkey + {k % 17}*c_nationkey) % {k % 29 + 2} + c_acctbal * {k % 3}" for k in range(500)]


@query("forty_columns_agg3c", "AGG3", q.select([f"t AS (SELECT CAST(l_suppkey % 5 AS INT) AS site, row_number() OVER () AS id, [{', '.join(FORTY)}] AS v FROM lineitem)",
       "u AS (SELECT site, id, unnest(range(40)) AS k, CAST(unnest(v) AS DOUBLE) AS x FROM t)", "m AS (SELECT site, k, avg(x) AS m FROM u GROUP BY ALL)",
       "c AS (SELECT site, id, list(x - m ORDER BY k) AS v FROM u JOIN m USING (site, k) GROUP BY ALL)",
       "p AS (SELECT site, unnest(range(40)) AS a, v, unnest(v) AS xa FROM c)", "w AS (SELECT site, a, xa, unnest(range(a, 40)) AS b, unnest(v[a + 1:40]) AS xb FROM p)"],
       f"SELECT site, CAST(a AS INT) AS a, CAST(b AS INT) AS b, count(*) AS n, {q.rnd('sum(xa*xb)', 4)} AS sxy FROM w GROUP BY site, a, b"))
def forty_columns(spark, d):
    rows = fx.table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("site"), *[F.expr(e).alias(str(k)) for k, e in enumerate(FORTY)])
    c = mo.moment_cells(mo.moment_tiles(rows, [str(k) for k in range(40)]), [str(k) for k in range(40)])
    return c.select("site", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n", r("sxy", 4).alias("sxy"))


@query("five_hundred_columns_agg3d", "AGG3", q.select([f"t AS (SELECT CAST(c_nationkey % 3 AS INT) AS site, [{', '.join(HUNDREDS)}] AS v FROM customer)",
       "u AS (SELECT site, unnest(range(500)) AS k, unnest(v) AS x, list_sum(v) AS total FROM t)"],
       f"SELECT site, CAST(k AS INT) AS k, count(*) AS n, {q.rnd('avg(x)', 3)} AS mean, round(covar_pop(x, x)*count(*) / 1e3) + 0e0 AS own, round(covar_pop(x, total)*count(*) / 1e6) + 0e0 AS row_total FROM u GROUP BY site, k"))
def five_hundred_columns(spark, d):
    # few bytes become five hundred numbers: more tasks than the file has splits
    customers = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").repartition(bucket_count(spark.range(0)))
    rows = customers.select((F.col("c_nationkey") % 3).cast("int").alias("site"), F.array(*[F.expr(e).cast("double") for e in HUNDREDS]).alias("v"))
    c = mo.moment_cells(mo.moment_tiles(rows, [], array="v", width=500), [str(k) for k in range(500)])
    both = c.select("site", F.col("a").alias("k"), "n", F.col("mean_a").alias("mean"), "sxy", (F.col("a") == F.col("b")).alias("own")).unionByName(
        c.where("a <> b").select("site", F.col("b").alias("k"), "n", F.col("mean_b").alias("mean"), "sxy", F.lit(False).alias("own")))
    out = both.groupBy("site", "k").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.when(F.col("own"), F.col("sxy"))).alias("own"), F.sum("sxy").alias("row_total"))
    return out.select("site", F.col("k").cast("int").alias("k"), "n", r("mean", 3).alias("mean"), r(F.col("own") / 1e3, 0).alias("own"), r(F.col("row_total") / 1e6, 0).alias("row_total"))


@query("gwas_of_embeddings_agg1c", "AGG1 SRC2", q.select(["t AS (SELECT label AS site, vec_id % 7 + embedding[1]*2e0 AS x, vec_id % 11 - embedding[2]*3e0 AS y, embedding FROM embeddings)",
       "u AS (SELECT site, x, y, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS g FROM t)",
       "s AS (SELECT site, k, count(*) AS n, regr_sxx(x, g) AS gg, regr_sxy(x, g) AS gx, regr_syy(x, g) AS xx, regr_sxy(y, g) AS gy, regr_syy(y, g) AS yy FROM u GROUP BY site, k)"],
       f"SELECT site, 'snp' || k AS snp, n, {q.rnd('gx/gg')} AS beta_x, {q.rnd('sqrt((xx - gx*gx/gg)/(n-2)/gg)')} AS se_x, {q.rnd('gy/gg')} AS beta_y, {q.rnd('sqrt((yy - gy*gy/gg)/(n-2)/gg)')} AS se_y FROM s"))
def gwas_of_embeddings(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("label").alias("site"), (F.col("vec_id") % 7 + F.get("embedding", F.lit(0)).cast("double") * 2.0).alias("x"),
                                                (F.col("vec_id") % 11 - F.get("embedding", F.lit(1)).cast("double") * 3.0).alias("y"), F.col("embedding").alias("g"))
    return gw.gwas_long(e).select("site", "snp", "n", *[r(c).alias(c) for c in ("beta_x", "se_x", "beta_y", "se_y")])


@query("federated_sum_agg4", "AGG4", q.select([q.MR, q.mom("mom", MCOLS), q.total("tot", MCOLS, "mom")], "SELECT CAST(n AS BIGINT) AS n, k AS absorbed, " + ", ".join(f"{q.rnd(q.s(a, b), 4)} AS {q.s(a, b)}" for a, b in q.pairs(MCOLS)) + " FROM tot"))
def federated_sum(spark, d):
    t = mo.combine(mo.moments(fx.mr_rows(spark, d), MCOLS))
    return t.select("n", "absorbed", *[r(c, 4).alias(c) for c in mo.stat_columns(t)])


@query("moment_table_sink_snk3", "SNK3 AGG4", q.select([q.MR, q.mom("mom", MCOLS), q.total("tot", MCOLS, "mom")], "SELECT CAST(n AS BIGINT) AS n, k AS absorbed, " + ", ".join(f"{q.rnd(q.s(a, b), 4)} AS {q.s(a, b)}" for a, b in q.pairs(MCOLS)) + " FROM tot"))
def moment_table_sink(spark, d):
    path = scratch_path(spark, "moments")
    sites.write_moments(mo.moments(fx.mr_rows(spark, d), MCOLS), path)
    t = mo.combine(sites.read_moments(spark, path))
    return t.select("n", "absorbed", *[r(c, 4).alias(c) for c in mo.stat_columns(t)])


T2 = q.solve2(("snp0", "snp1"), "x")
# shared design with one regressor: theta = B'A^-1 c / B'A^-1 B with projections pi = A^-1 B
SHARED_FIT = [q.MR, q.mom("mom", ["snp0", "snp1", "x", "y"]), q.total("tot", ["snp0", "snp1", "x", "y"], "mom"),
              f"pr AS (SELECT *, {T2[0]} AS p0, {T2[1]} AS p1 FROM tot)",
              "th AS (SELECT *, (p0*s_snp0__y + p1*s_snp1__y)/(p0*s_snp0__x + p1*s_snp1__x) AS theta, p0*s_snp0__x + p1*s_snp1__x AS info FROM pr)"]
MEAT = """rowsu AS (SELECT (mr.snp0 - mom.m_snp0) AS z0, (mr.snp1 - mom.m_snp1) AS z1, (mr.y - mom.m_y) - th.theta*(mr.x - mom.m_x) AS uu FROM mr JOIN mom USING (site), th)"""


@query("robust_meat_agg5", "AGG5", q.select([*SHARED_FIT, MEAT], f"SELECT {q.rnd('sum(uu*uu*z0*z0)', 3)} AS h00, {q.rnd('sum(uu*uu*z0*z1)', 3)} AS h01, {q.rnd('sum(uu*uu*z1*z1)', 3)} AS h11 FROM rowsu"))
def robust_meat(spark, d):
    mr = fx.mr_rows(spark, d)
    run = iv.shared_instruments(mr, fx.SNPS, robust=False)
    theta = run.estimates().first()["theta"]
    h = iv.robust_meat(mr, run.site_moments, run.design, [theta])
    return h.select(r("s_snp0__snp0", 3).alias("h00"), r("s_snp0__snp1", 3).alias("h01"), r("s_snp1__snp1", 3).alias("h11"))


@query("global_first_stage_agg6", "AGG6", q.select([q.MR, q.mom("mom", ["snp0", "snp1", "x"]), q.total("tot", ["snp0", "snp1", "x"], "mom")], f"SELECT CAST(n AS BIGINT) AS n, {q.rnd(T2[0])} AS p0, {q.rnd(T2[1])} AS p1 FROM tot"))
def global_first_stage(spark, d):
    fs = iv.global_first_stage(mo.moments(fx.mr_rows(spark, d), [*fx.SNPS, "x"]), fx.SNPS)
    return fs.groupBy("pi").agg(F.sum("n").alias("n")).select("n", r(F.col("pi")[0]).alias("p0"), r(F.col("pi")[1]).alias("p1"))


FOLD_COLS = ["snp0", "snp1", "x"]
CROSSFIT = [q.MR, q.mom("fm", FOLD_COLS, ("site", "fold")), q.total("ft", FOLD_COLS, "fm", ("fold",)),
            "fr AS (SELECT fold, " + ", ".join(f"sum({q.s(a, b)}) OVER () - {q.s(a, b)} AS {q.s(a, b)}" for a, b in q.pairs(FOLD_COLS)) + " FROM ft)",
            f"fp AS (SELECT fold, {T2[0]} AS p0, {T2[1]} AS p1 FROM fr)"]


@query("leave_fold_out_agg7", "AGG7", q.select(CROSSFIT, f"SELECT fold, {q.rnd('p0')} AS p0, {q.rnd('p1')} AS p1 FROM fp"))
def leave_fold_out(spark, d):
    fm = mo.moments(fx.mr_rows(spark, d), FOLD_COLS, ("site", "fold"))
    out = iv.leave_fold_out_shared(fm, list(fx.SNPS))
    return out.groupBy("fold").agg(r(F.min(F.col("pi")[0])).alias("p0"), r(F.max(F.col("pi")[1])).alias("p1"))


# local variant: everything but fold j of the site, centred on the other folds' joint mean
LOCAL_CF = [q.MR, "tr AS (SELECT a.site, f.fold AS held, a.snp0, a.snp1, a.x FROM mr a JOIN (SELECT DISTINCT fold FROM mr) f ON a.fold <> f.fold)",
            q.mom("lm", FOLD_COLS, ("site", "held"), "tr"), q.fs("lf", "lm")]


@query("leave_fold_out_local_agg7b", "AGG7 IV10", q.select(LOCAL_CF, f"SELECT site, held AS fold, {q.rnd('p0')} AS p0, {q.rnd('p1')} AS p1, {q.rnd('a0')} AS a0 FROM lf"))
def leave_fold_out_local(spark, d):
    fm = mo.moments(fx.mr_rows(spark, d), FOLD_COLS, ("site", "fold"))
    out = iv.leave_fold_out_local(fm, list(fx.SNPS))
    return out.select("site", "fold", r(F.col("pi")[0]).alias("p0"), r(F.col("pi")[1]).alias("p1"), r("fs_intercept").alias("a0"))


@query("local_first_stage_agg8", "AGG8", "WITH " + q.local_rows() + f", rd AS (SELECT site, var_pop(x)*count(*) AS red FROM mr GROUP BY site)\nSELECT site, {q.rnd('sum(resid*resid)', 4)} AS rss_full, {q.rnd('max(red)', 4)} AS rss_reduced, 2 AS n_instruments, 3 AS n_params FROM xh JOIN rd USING (site) GROUP BY site")
def local_first_stage(spark, d):
    fs = iv.local_first_stage(mo.moments(fx.mr_rows(spark, d), [*fx.SNPS, "x"]), fx.SNPS)
    return fs.select("site", r("fs_rss_full", 4).alias("rss_full"), r("fs_rss_reduced", 4).alias("rss_reduced"),
                     F.col("fs_n_instruments").alias("n_instruments"), F.col("fs_n_params").alias("n_params"))


# the sensitivity bundle: reduced forms of x and y on the instruments, then seven columns
Y2 = q.solve2(("snp0", "snp1"), "y")
BUNDLE_CTES = [q.MR, q.mom("mom", ["snp0", "snp1", "x", "y"]), f"cf AS (SELECT *, {T2[0]} AS p0, {T2[1]} AS p1, {Y2[0]} AS q0, {Y2[1]} AS q1 FROM mom)",
               """bx AS (SELECT mr.site, mr.y, mr.x, mr.x*mr.x AS x2, mr.u, mr.snp0, mr.snp1, m_x - p0*m_snp0 - p1*m_snp1 + p0*mr.snp0 + p1*mr.snp1 AS xhat,
   m_y - q0*m_snp0 - q1*m_snp1 + q0*mr.snp0 + q1*mr.snp1 AS yhat FROM mr JOIN cf USING (site))""",
               "br AS (SELECT *, xhat*xhat AS xhat2 FROM bx)", q.mom("bun", ["y", "x", "x2", "u", "xhat", "xhat2", "yhat", "snp0", "snp1"], ("site",), "br")]
SHOW = [("y", "y"), ("x", "y"), ("x2", "y"), ("u", "y"), ("xhat", "y"), ("xhat2", "y"), ("yhat", "y"), ("xhat", "xhat2"), ("x2", "xhat2"), ("x", "xhat"), ("yhat", "yhat"), ("snp0", "x2"), ("snp0", "snp1")]


@query("site_bundle_agg9", "AGG9", q.select(BUNDLE_CTES, "SELECT site, n, " + ", ".join(f"{q.rnd('m_' + c)} AS m_{c}" for c in ("y", "x2", "xhat2", "yhat")) + ", " + ", ".join(f"{q.rnd(q.s(a, b), 3)} AS {q.s(a, b)}" for a, b in SHOW) + " FROM bun"))
def site_bundle(spark, d):
    b = se.site_bundle(fx.mr_rows(spark, d), fx.SNPS)
    return b.select("site", "n", *[r("m_" + c).alias("m_" + c) for c in ("y", "x2", "xhat2", "yhat")], *[r(mo.S(x, y), 3).alias(mo.s_name(x, y)) for x, y in SHOW])


IVW_SQL = """iw AS (SELECT site, max(n) AS n, sum(beta_x*beta_y/(se_y*se_y))/sum(beta_x*beta_x/(se_y*se_y)) AS ivw, sqrt(1e0/sum(beta_x*beta_x/(se_y*se_y))) AS ivw_se,
  avg(beta_x*beta_x/(se_x*se_x)) AS mean_f FROM gw GROUP BY site)"""
GW = [q.MR, gwas_sql(), IVW_SQL]


@query("ivw_agg10", "AGG10", q.select(GW, f"SELECT site, n, {q.rnd('ivw')} AS ivw, {q.rnd('ivw_se')} AS ivw_se FROM iw"))
def ivw(spark, d):
    return gw.ivw(gw.gwas(fx.mr_rows(spark, d), fx.SNPS)).select("site", "n", r("ivw").alias("ivw"), r("ivw_se").alias("ivw_se"))


@query("mean_f_agg11", "AGG11", q.select(GW, f"SELECT site, {q.rnd('mean_f', 3)} AS mean_f FROM iw"))
def mean_f(spark, d):
    return gw.ivw(gw.gwas(fx.mr_rows(spark, d), fx.SNPS)).select("site", r("mean_F", 3).alias("mean_f"))


META_SQL = "me AS (SELECT count(*) AS sites, sum(ivw/(ivw_se*ivw_se))/sum(1e0/(ivw_se*ivw_se)) AS meta, sqrt(1e0/sum(1e0/(ivw_se*ivw_se))) AS meta_se FROM iw)"


def site_ivw(spark, d):
    return gw.ivw(gw.gwas(fx.mr_rows(spark, d), fx.SNPS)).select("site", "n", F.col("ivw").alias("theta"), F.col("ivw_se").alias("se"))


@query("meta_analysis_agg12", "AGG12", q.select([*GW, META_SQL], f"SELECT sites, {q.rnd('meta')} AS meta, {q.rnd('meta_se')} AS meta_se, {q.rnd('meta - 1.96e0*meta_se')} AS lo, {q.rnd('meta + 1.96e0*meta_se')} AS hi FROM me"))
def meta_analysis(spark, d):
    return ma.inverse_variance(site_ivw(spark, d)).select("sites", *[r(c).alias(c) for c in ("meta", "meta_se", "lo", "hi")])


@query("cochran_q_agg13", "AGG13", q.select([*GW, META_SQL], f"SELECT {q.rnd('sum((ivw-meta)*(ivw-meta)/(ivw_se*ivw_se))')} AS q, count(*) - 1 AS df FROM iw, me"))
def cochran_q(spark, d):
    return ma.cochran_q(site_ivw(spark, d)).select(r("q").alias("q"), "df")


DL = [*GW, META_SQL, "qq AS (SELECT sum((ivw-meta)*(ivw-meta)/(ivw_se*ivw_se)) AS q, count(*)-1 AS df, sum(1e0/(ivw_se*ivw_se)) AS sw, sum(1e0/pow(ivw_se, 4)) AS sw2, max(meta) AS fe, max(meta_se) AS fe_se FROM iw, me)",
      "t AS (SELECT *, greatest(0e0, (q-df)/(sw - sw2/sw)) AS tau2 FROM qq)"]


@query("random_effects_agg14", "AGG14", q.select(DL, f"""SELECT {q.rnd('max(fe)')} AS fe, {q.rnd('max(fe_se)')} AS fe_se, {q.rnd('sum(ivw/(ivw_se*ivw_se+tau2))/sum(1e0/(ivw_se*ivw_se+tau2))')} AS re,
 {q.rnd('sqrt(1e0/sum(1e0/(ivw_se*ivw_se+tau2)))')} AS re_se, {q.rnd('max(q)')} AS q, {q.rnd('max(tau2)', 8)} AS tau2, {q.rnd('max(greatest(0e0, (q-df)/q))')} AS i2, {q.rnd('sqrt(max(tau2))')} AS tau FROM iw, t"""))
def random_effects(spark, d):
    return cols(ma.random_effects(site_ivw(spark, d), with_p=False), ["fe", "fe_se", "re", "re_se", "q", "tau2", "i2", "tau"], tau2=8)


# per-site quadratic fits give two coefficients and a covariance each
def quad_fit(src: str, name: str) -> str:
    """CTE with theta_1, theta_2 and v_1_1, v_1_2, v_2_2 of the (xhat, xhat2) 2SLS from moments in src."""
    q00, q01, q11 = "s_xhat__xhat", "s_xhat__xhat2", "s_xhat2__xhat2"
    d00, d01, d10, d11 = "s_x__xhat", "s_x2__xhat", "s_x__xhat2", "s_x2__xhat2"
    a0, a1 = "s_xhat__y", "s_xhat2__y"
    return f"""{name}_p AS (SELECT *, {q00}*{q11}-{q01}*{q01} AS dq, {d00}*{d11}-{d01}*{d10} AS dd FROM {src}),
{name}_t AS (SELECT *, ({a0}*{d11} - {a1}*{d01})/dd AS theta_1, ({a1}*{d00} - {a0}*{d10})/dd AS theta_2,
  ({d00}*({q11}*{d00}-{q01}*{d10}) + {d10}*({q00}*{d10}-{q01}*{d00}))/dq AS w00,
  ({d00}*({q11}*{d01}-{q01}*{d11}) + {d10}*({q00}*{d11}-{q01}*{d01}))/dq AS w01,
  ({d01}*({q11}*{d01}-{q01}*{d11}) + {d11}*({q00}*{d11}-{q01}*{d01}))/dq AS w11 FROM {name}_p),
{name} AS (SELECT *, s2*w11/dw AS v_1_1, -s2*w01/dw AS v_1_2, s2*w00/dw AS v_2_2 FROM (SELECT *, rss/greatest(n - k - 2, 1) AS s2 FROM (SELECT *, w00*w11-w01*w01 AS dw,
  s_y__y - 2e0*(theta_1*s_x__y + theta_2*s_x2__y) + theta_1*theta_1*s_x__x + 2e0*theta_1*theta_2*s_x__x2 + theta_2*theta_2*s_x2__x2 AS rss FROM {name}_t)))"""


QUAD_SITES = [*BUNDLE_CTES, "bk AS (SELECT *, 1 AS k FROM bun)", quad_fit("bk", "qf")]


def quad_meta(power: str) -> str:
    w = "SELECT theta_1, theta_2, v_2_2/dv AS a, -v_1_2/dv AS b, v_1_1/dv AS c, v_2_2/dv + v_1_1/dv AS tr FROM (SELECT *, v_1_1*v_2_2-v_1_2*v_1_2 AS dv FROM qf)"
    return q.select([*QUAD_SITES, f"ww AS ({w})", f"kk AS (SELECT *, pow(avg(tr) OVER () / tr, 1e0 - {power}) AS kf FROM ww)",
                     "sm AS (SELECT count(*) AS sites, sum(a*kf) AS a, sum(b*kf) AS b, sum(c*kf) AS c, sum((a*theta_1+b*theta_2)*kf) AS e, sum((b*theta_1+c*theta_2)*kf) AS f FROM kk)"],
                    f"SELECT sites, {q.rnd('(c*e-b*f)/(a*c-b*b)')} AS theta_1, {q.rnd('(a*f-b*e)/(a*c-b*b)')} AS theta_2, {q.rnd('sqrt(c/(a*c-b*b))')} AS se_1, {q.rnd('sqrt(a/(a*c-b*b))')} AS se_2 FROM sm")


def quad_sites(spark, d):
    b = se.site_bundle(fx.mr_rows(spark, d), fx.SNPS)
    return se.two_sls(se.working(b, "quadratic"), "quadratic")


@query("matrix_meta_agg15", "AGG15", quad_meta("1e0"))
def matrix_meta(spark, d):
    m = ma.matrix_meta(quad_sites(spark, d), 2)
    return m.select("sites", *[r(c).alias(c) for c in ("theta_1", "theta_2", "se_1", "se_2")])


@query("equal_weight_meta_agg15b", "AGG15", quad_meta("0e0"))
def equal_weight_meta(spark, d):
    m = ma.matrix_meta(quad_sites(spark, d), 2, power=0.0)
    return m.select("sites", *[r(c).alias(c) for c in ("theta_1", "theta_2", "se_1", "se_2")])


@query("target_slope_agg16", "AGG16", q.select([q.MR, "n AS (SELECT site, count(*) AS n FROM mr GROUP BY site)", TRUTH_SQL], f"SELECT {q.rnd('sum(n*avg_slope)/sum(n)')} AS target, CAST(sum(n) AS BIGINT) AS n FROM n JOIN truth USING (site)"))
def target_slope(spark, d):
    n = fx.mr_rows(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return ma.weighted_target(n.join(truth(spark, d), "site")).select(r("target").alias("target"), "n")


METRIC_SQL = """ml AS (SELECT site, fold AS round, CASE WHEN snp1 = 0 THEN 'local' ELSE 'global' END AS stage, count(*) AS n_test, corr(x,y)*corr(x,y) AS r2, avg((y-0.3e0*x)*(y-0.3e0*x)) AS mse FROM mr GROUP BY ALL)"""


def metric_log(spark, d):
    e = F.col("y") - 0.3 * F.col("x")
    c = F.corr("x", "y")
    return fx.mr_rows(spark, d).groupBy("site", F.col("fold").alias("round"), F.when(F.col("snp1") == 0, "local").otherwise("global").alias("stage")).agg(
        F.count(F.lit(1)).alias("n_test"), (c * c).alias("r2"), F.avg(e * e).alias("mse"))


@query("weighted_metrics_agg17", "AGG17", q.select([q.MR, METRIC_SQL], f"SELECT round, stage, {q.rnd('sum(r2*n_test)/sum(n_test)')} AS r2, {q.rnd('sum(mse*n_test)/sum(n_test)')} AS mse FROM ml GROUP BY round, stage"))
def weighted_metrics(spark, d):
    return me.weighted_means(metric_log(spark, d), ["r2", "mse"]).select("round", "stage", r("r2").alias("r2"), r("mse").alias("mse"))


@query("last_round_metrics_win6", "WIN6 AGG17", q.select([q.MR, METRIC_SQL], f"SELECT stage, {q.rnd('sum(r2*n_test)/sum(n_test)')} AS r2 FROM ml WHERE round = (SELECT max(round) FROM ml) GROUP BY stage"))
def last_round_metrics(spark, d):
    last = cv.last_round(metric_log(spark, d))
    return me.weighted_means(last, ["r2"], ["stage"]).select("stage", r("r2").alias("r2"))


@query("scenario_summary_agg18", "AGG18", q.select([q.MR, METRIC_SQL], f"""SELECT stage AS scenario, {q.rnd('avg(r2)')} AS r2_mean, {q.rnd('stddev_samp(r2)')} AS r2_std, {q.rnd('avg(mse)')} AS mse_mean, {q.rnd('stddev_samp(mse)')} AS mse_std,
  min_by(n_test, round*10+site) AS n_test, count(*) AS n_seeds FROM ml GROUP BY stage"""))
def scenario_summary(spark, d):
    log = metric_log(spark, d).withColumn("seed", F.col("round") * 10 + F.col("site")).withColumnRenamed("stage", "scenario")
    s = me.scenario_summary(log, ["r2", "mse"], ["n_test"], ("scenario",))
    return s.select("scenario", *[r(c).alias(c) for c in ("r2_mean", "r2_std", "mse_mean", "mse_std")], "n_test", "n_seeds")


SWEEP_SQL = """sw AS (SELECT CASE WHEN site < 3 THEN 'low' ELSE 'high' END AS level, fold AS seed, site, snp2, regr_slope(y, x) AS est, sqrt((regr_syy(y,x)-regr_sxy(y,x)*regr_sxy(y,x)/regr_sxx(y,x))/(count(*)-2)/regr_sxx(y,x)) AS se,
  0.3e0 + 0.01e0*site AS target, abs(regr_slope(y,x)-0.3e0)*1e-3 AS idd, count(*)*1e0 AS ff FROM mr GROUP BY ALL)"""


def sweep_rows(spark, d):
    n = F.count(F.lit(1))
    sxx, sxy, syy = F.regr_sxx("y", "x"), F.regr_sxy("y", "x"), F.regr_syy("y", "x")
    return fx.mr_rows(spark, d).groupBy("site", "fold", "snp2").agg(
        F.regr_slope("y", "x").alias("est"), F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx).alias("se"),
        (F.abs(F.regr_slope("y", "x") - 0.3) * 1e-3).alias("identity_diff"), n.cast("double").alias("first_stage_F")).select(
        F.lit("sites").alias("axis"), F.when(F.col("site") < 3, "low").otherwise("high").alias("level"), F.lit("naive").alias("estimator"),
        "est", "se", (0.3 + F.lit(0.01) * F.col("site")).alias("target"), "identity_diff", "first_stage_F", "site", "fold", "snp2")


@query("sweep_summary_agg19", "AGG19", q.select([q.MR, SWEEP_SQL], f"""SELECT 'sites' AS axis, level, 'naive' AS estimator, {q.rnd('avg(est-target)')} AS bias, {q.rnd('sqrt(avg((est-target)*(est-target)))')} AS rmse, {q.rnd('avg(se)')} AS mean_se,
 {q.rnd('avg(CASE WHEN abs(est-target) <= 1.96e0*se THEN 1e0 ELSE 0e0 END)')} AS coverage, {q.rnd('max(idd)', 8)} AS identity_max, {q.rnd('avg(ff)')} AS mean_F, count(*) AS seeds FROM sw GROUP BY level"""))
def sweep_summary(spark, d):
    s = me.sweep_summary(sweep_rows(spark, d))
    return s.select("axis", "level", "estimator", *[r(c).alias(c) for c in ("bias", "rmse", "mean_se", "coverage")], r("identity_max", 8).alias("identity_max"), r("mean_F").alias("mean_F"), "seeds")


@query("route_summary_agg20", "AGG20", q.select([q.MR, SWEEP_SQL, "rt AS (SELECT 'sumstats' AS route, est, se FROM sw UNION ALL SELECT 'pooled', est*0.9e0, se*1.1e0 FROM sw)"], f"""SELECT route, {q.rnd('avg(est)')} AS mean, {q.rnd('avg(est-0.3e0)')} AS bias, {q.rnd('stddev_samp(est)')} AS sd,
 {q.rnd('avg(se)')} AS mean_se, {q.rnd('sqrt(avg((est-0.3e0)*(est-0.3e0)))')} AS rmse, {q.rnd('avg(CASE WHEN abs(est-0.3e0) <= 1.96e0*se THEN 1e0 ELSE 0e0 END)')} AS coverage, count(*) AS draws FROM rt GROUP BY route"""))
def route_summary(spark, d):
    rows = sweep_rows(spark, d).select(F.col("est").alias("sumstats"), F.col("se").alias("sumstats_se"), (F.col("est") * 0.9).alias("pooled"), (F.col("se") * 1.1).alias("pooled_se"))
    s = me.route_summary(rows, ["sumstats", "pooled"], 0.3)
    return s.select("route", *[r(c).alias(c) for c in ("mean", "bias", "sd", "mean_se", "rmse", "coverage")], "draws")


@query("events_per_site_agg20b", "AGG20", q.select([q.SURV, "e AS (SELECT site, CAST(sum(event) AS BIGINT) AS events FROM sv GROUP BY site)"], f"SELECT {q.rnd('median(events)')} AS median_events, min(events) AS min_events FROM e"))
def events_per_site(spark, d):
    e = fx.mr_surv(spark, d).groupBy("site").agg(F.sum("event").alias("events"))
    return e.agg(r(F.median("events")).alias("median_events"), F.min("events").alias("min_events"))


# bin edges by integer arithmetic on x shifted to be centred near zero
@query("binned_response_agg21", "AGG21", q.select([q.MR, "b AS (SELECT x - 2.7e0 AS xc, y, yb, CAST(ceil((x - 2.7e0 - -3e0)/0.25e0) AS INT) AS bin FROM mr WHERE x - 2.7e0 > -3e0 AND x - 2.7e0 <= 3e0)"],
       f"""SELECT 'y' AS outcome, bin, {q.rnd('avg(xc)')} AS x, {q.rnd('avg(y)')} AS y, count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 30
 UNION ALL SELECT 'logit', bin, {q.rnd('avg(xc)')}, {q.rnd('ln(least(greatest(avg(yb),1e-6),1e0-1e-6)/(1e0-least(greatest(avg(yb),1e-6),1e0-1e-6)))')}, count(*) FROM b GROUP BY bin HAVING count(*) >= 30"""))
def binned_response(spark, d):
    mr = fx.mr_rows(spark, d).withColumn("xc", F.col("x") - 2.7)
    a = cv.binned_means(mr, "xc", "y").withColumn("outcome", F.lit("y"))
    b = cv.binned_means(mr, "xc", "yb", binary=True).withColumn("outcome", F.lit("logit"))
    return a.unionByName(b).select("outcome", "bin", r("x").alias("x"), r("y").alias("y"), "n")


@query("percentile_band_agg22", "AGG22", q.select([q.MR, q.GRID61, *REPS_SQL, BAND_SQL], f"SELECT {q.rnd('x')} AS x, {q.rnd('lo')} AS lo, {q.rnd('hi')} AS hi, {q.rnd('sd')} AS sd FROM band"))
def percentile_band(spark, d):
    return cols(cv.percentile_band(boot(spark, d)), ["x", "lo", "hi", "sd"])


LSQ = """SELECT {key}, (d*e-b*g)/(a*d-b*b) AS theta_1, (a*g-b*e)/(a*d-b*b) AS theta_2, e/a AS slope FROM (SELECT {key}, sum(x*x) AS a, sum(x*x*x) AS b, sum(x*x*x*x) AS d, sum(x*f) AS e, sum(x*x*f) AS g FROM {src} WHERE abs(x) <= 2e0 + {slack} GROUP BY {key})"""


@query("curve_coefficients_agg23", "AGG23", q.select([*CURVES, "an AS (SELECT c.site, c.round, c.x, c.f - z.f AS f FROM curves c JOIN (SELECT * FROM curves WHERE k = 30) z USING (site, round))", f"ls AS ({LSQ.format(key='site, round', src='an', slack='0e0')})"],
       f"SELECT site, round, {q.rnd('theta_1')} AS theta_1, {q.rnd('theta_2')} AS theta_2, {q.rnd('slope')} AS slope FROM ls"))
def curve_coefficients(spark, d):
    c = fx.curves(fx.mr_rows(spark, d))
    a = cv.read_parameters(c, ("site", "round"), True)
    b = cv.read_parameters(c, ("site", "round"), False).withColumnRenamed("theta_1", "slope")
    return a.join(b, ["site", "round"]).select("site", "round", *[r(v).alias(v) for v in ("theta_1", "theta_2", "slope")])


@query("coefficient_intervals_agg24", "AGG24", q.select([q.MR, q.GRID61, *REPS_SQL, f"ls AS ({LSQ.format(key='rep', src='boot', slack='1e-9')})"], "SELECT count(*) AS replicates, " + ", ".join(
    f"{q.rnd(f'quantile_cont(theta_{i}, 0.025e0)')} AS lo_{i}, {q.rnd(f'quantile_cont(theta_{i}, 0.975e0)')} AS hi_{i}, {q.rnd(f'stddev_samp(theta_{i})')} AS sd_{i}" for i in (1, 2)) + " FROM ls"))
def coefficient_intervals(spark, d):
    p = cv.read_parameters(boot(spark, d), ("rep",), True, anchored=True, slack=1e-9)
    return cv.parameter_interval(p).select("replicates", *[r(f"{a}_{i}").alias(f"{a}_{i}") for i in (1, 2) for a in ("lo", "hi", "sd")])


@query("curve_rmse_agg25", "AGG25", q.select([*CURVES, "an AS (SELECT c.site, c.round, c.x, c.f - z.f AS f FROM curves c JOIN (SELECT * FROM curves WHERE k = 30) z USING (site, round))"],
       f"SELECT site, round, {q.rnd('sqrt(avg((f - (0.3e0*x + 0.15e0*x*x))*(f - (0.3e0*x + 0.15e0*x*x))))')} AS rmse_truth FROM an WHERE abs(x) <= 2e0 GROUP BY site, round"))
def curve_rmse(spark, d):
    c = cv.anchor(fx.curves(fx.mr_rows(spark, d)), ("site", "round"))
    return cv.rmse_to_truth(c, "quadratic", F.lit(0.3), F.lit(0.15), ("site", "round")).select("site", "round", r("rmse_truth").alias("rmse_truth"))


FLAG_SQL = "fl AS (SELECT site, fold AS round, CASE WHEN site IN (1, 3) THEN 1 ELSE 0 END AS malicious, CAST(avg(y) > 3.9e0 AS INT) AS flagged FROM mr GROUP BY site, fold)"


@query("detection_rates_agg26", "AGG26", q.select([q.MR, FLAG_SQL], f"SELECT {q.rnd('avg(CASE WHEN malicious=1 THEN flagged END)')} AS tpr, {q.rnd('avg(CASE WHEN malicious=0 THEN flagged END)')} AS fpr, count(*) AS site_rounds FROM fl WHERE round >= 1"))
def detection_rates(spark, d):
    log = fx.mr_rows(spark, d).groupBy("site", F.col("fold").alias("round")).agg((F.avg("y") > 3.9).cast("int").alias("flagged")).withColumn(
        "malicious", F.col("site").isin(1, 3).cast("int"))
    return me.detection_rates(log, 1).select(r("tpr").alias("tpr"), r("fpr").alias("fpr"), "site_rounds")


@query("manifest_rollup_agg27", "AGG27", q.select([q.SURV, "m AS (SELECT site, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, corr(x, snp0)*corr(x, snp0) AS h, regr_slope(x, u) AS gx, regr_slope(time, u) AS gy FROM sv GROUP BY site)"],
       f"SELECT count(*) AS sites, CAST(sum(n) AS BIGINT) AS n, CAST(sum(events) AS BIGINT) AS events, {q.rnd('avg(h)')} AS h2_x, {q.rnd('avg(gx)')} AS gamma_x, {q.rnd('avg(gy)')} AS gamma_y FROM m"))
def manifest_rollup(spark, d):
    c = F.corr("x", "snp0")
    m = fx.mr_surv(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), (c * c).alias("h2_x"),
                                                  F.regr_slope("x", "u").alias("gamma_x"), F.regr_slope("time", "u").alias("gamma_y"))
    return me.manifest_rollup(m).select("sites", "n", "events", *[r(v).alias(v) for v in ("h2_x", "gamma_x", "gamma_y")])


@query("pooled_naive_agg28", "AGG28", q.select([q.MR, q.mom("mom", ["x", "y"])], f"SELECT {q.rnd('sum(s_x__y)/sum(s_x__x)')} AS naive FROM mom"))
def pooled_naive(spark, d):
    return iv.pooled_naive(mo.moments(fx.mr_rows(spark, d), ["x", "y"])).select(r("naive").alias("naive"))


@query("pivot_matrix_agg29", "AGG29", q.select([q.MR], f"""SELECT CASE site WHEN 0 THEN 'flip' ELSE 'scale' || CAST(site AS VARCHAR) END AS attack, {q.rnd('avg(CASE WHEN fold=0 THEN y END)')} AS median, {q.rnd('avg(CASE WHEN fold=1 THEN y END)')} AS krum FROM mr GROUP BY site"""))
def pivot_matrix(spark, d):
    s = fx.mr_rows(spark, d).filter("fold < 2").groupBy("site", "fold").agg(r(F.avg("y")).alias("v"))
    attack = F.when(F.col("site") == 0, "flip").otherwise(F.concat(F.lit("scale"), F.col("site").cast("string")))
    named = s.select(F.concat(attack, F.lit("|"), F.when(F.col("fold") == 0, "median").otherwise("krum")).alias("scenario"), "v")
    return me.pivot_scenarios(named, "v", ["median", "krum"])


DEFENSES = ("median", "krum", "trimmed_mean", "geometric_median", "fedavg")


@query("pivot_all_agg29b", "AGG29", q.select([q.MR], "SELECT CASE site WHEN 0 THEN 'flip' ELSE 'scale' || CAST(site AS VARCHAR) END AS attack, " + ", ".join(f"{q.rnd(f'avg(CASE WHEN fold={k} THEN y END)')} AS {name}" for k, name in enumerate(DEFENSES)) + " FROM mr GROUP BY site"))
def pivot_all(spark, d):
    """Every fold is a defense, every site an attack."""
    s = fx.mr_rows(spark, d).groupBy("site", "fold").agg(r(F.avg("y")).alias("v"))
    attack = F.when(F.col("site") == 0, "flip").otherwise(F.concat(F.lit("scale"), F.col("site").cast("string")))
    named = s.select(F.concat(attack, F.lit("|"), F.element_at(F.array(*[F.lit(x) for x in DEFENSES]), F.col("fold") + 1)).alias("scenario"), "v")
    return me.pivot_scenarios(named, "v", DEFENSES)


@query("explained_variance_agg30", "AGG30", q.select([q.MR, gwas_sql(), "fr AS (SELECT site, avg(snp0)/2e0 AS f0, avg(snp1)/2e0 AS f1 FROM mr GROUP BY site)"],
       f"SELECT g.site, {q.rnd('''sum(beta_x*beta_x*2e0*CASE WHEN snp = 'snp0' THEN f0*(1e0-f0) ELSE f1*(1e0-f1) END)''')} AS explained FROM gw g JOIN fr USING (site) GROUP BY g.site"))
def explained_variance(spark, d):
    mr = fx.mr_rows(spark, d)
    return gw.explained_variance(mr, gw.gwas(mr, fx.SNPS), fx.SNPS).select("site", r("explained").alias("explained"))


@query("average_slope_agg31", "AGG31", q.select([q.MR], f"SELECT site, {q.rnd('0.3e0 + 2e0*0.15e0*avg(x)')} AS quadratic, {q.rnd('0.3e0*avg(CASE WHEN x < 2.5e0 THEN 1e0 ELSE 0e0 END)')} AS threshold FROM mr GROUP BY site"))
def average_slope(spark, d):
    mr = fx.mr_rows(spark, d)
    a = cv.average_slope(mr, "quadratic", F.lit(0.3), F.lit(0.15)).select("site", r("avg_slope").alias("quadratic"))
    b = cv.average_slope(mr, "threshold", F.lit(0.3), F.lit(2.5)).select("site", r("avg_slope").alias("threshold"))
    return a.join(b, "site")
