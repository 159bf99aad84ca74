"""Robust aggregation of update vectors, secure sums, noise plans, the privacy ledger and leakage."""

from pyspark.sql import functions as F

from sitefold.functions import scalars as sc
from sitefold.functions.scalars import r
from sitefold.operators import fedagg as fa
from sitefold.operators import privacy as pv
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query
from sitefold.plans.windows_queries import KRUM, WMED


def long(df):
    return df.select("round", "j", r("v").alias("v"))


@query("weighted_mean_agr1", "AGR1", q.select([q.UPD], f"SELECT round, j, {q.rnd('sum(weight*v)/sum(weight)')} AS v FROM upd GROUP BY round, j"))
def weighted_mean(spark, d):
    return long(fa.aggregate(fx.updates(spark, d), "fedavg")[0])


EQ = "eq AS (SELECT round, site, j, v, 1e0 AS weight FROM upd)"


def equal(spark, d):
    return fx.updates(spark, d).withColumn("weight", F.lit(1.0))


@query("median_equal_agr2", "AGR2", q.select([q.UPD], f"SELECT round, j, {q.rnd('median(v)')} AS v FROM upd GROUP BY round, j"))
def median_equal(spark, d):
    return long(fa.median(equal(spark, d)))


@query("median_weighted_agr2b", "AGR2 WIN4", q.select([q.UPD, WMED], f"SELECT round, j, {q.rnd('min_by(v, c)')} AS v FROM cw WHERE c >= 0.5e0 - 1e-12 GROUP BY round, j"))
def median_weighted(spark, d):
    return long(fa.median(fx.updates(spark, d)))


@query("median_shares_agr2c", "AGR2", q.select([q.UPD, "rk AS (SELECT round, site, j, row_number() OVER (PARTITION BY round, j ORDER BY v, site) - 1 AS r, count(*) OVER (PARTITION BY round, j) AS k FROM upd)",
       "kp AS (SELECT round, site, avg(CASE WHEN r = (k-1)//2 OR r = k//2 THEN 1e0 ELSE 0e0 END) AS kept FROM rk GROUP BY round, site)"], f"SELECT round, site, {q.rnd('kept')} AS kept, {q.rnd('kept/avg(kept) OVER (PARTITION BY round)')} AS share FROM kp"))
def median_shares(spark, d):
    return fa.median_shares(equal(spark, d)).select("round", "site", r("kept").alias("kept"), r("share").alias("share"))


TRIM = [q.UPD, "rk AS (SELECT u.round, u.site, u.j, u.v, u.weight/t.tw AS w, row_number() OVER (PARTITION BY u.round, u.j ORDER BY u.v, u.site) - 1 AS r, count(*) OVER (PARTITION BY u.round, u.j) AS k FROM upd u JOIN (SELECT round, sum(weight) AS tw FROM updw GROUP BY round) t USING (round))",
        "tk AS (SELECT *, r >= floor(0.2e0*k) AND r < k - floor(0.2e0*k) AS used FROM rk)"]


@query("trimmed_mean_agr3", "AGR3", q.select(TRIM, f"SELECT round, j, {q.rnd('sum(w*v)/sum(w)')} AS v FROM tk WHERE used GROUP BY round, j"))
def trimmed_mean(spark, d):
    return long(fa.trimmed_mean(fx.updates(spark, d), 0.2))


@query("trimmed_shares_agr3b", "AGR3", q.select([*TRIM, "ef AS (SELECT *, CASE WHEN used THEN w ELSE 0e0 END/sum(CASE WHEN used THEN w ELSE 0e0 END) OVER (PARTITION BY round, j) AS e FROM tk)"], f"SELECT round, site, {q.rnd('avg(CASE WHEN used THEN 1e0 ELSE 0e0 END)')} AS kept, {q.rnd('avg(e)/max(w)')} AS share FROM ef GROUP BY round, site"))
def trimmed_shares(spark, d):
    return fa.trimmed_shares(fx.updates(spark, d), 0.2).select("round", "site", r("kept").alias("kept"), r("share").alias("share"))


@query("krum_agr4", "AGR4", q.select([q.UPD, KRUM], f"SELECT u.round, u.j, {q.rnd('u.v')} AS v FROM upd u JOIN kr ON u.round=kr.round AND u.site=kr.site AND kr.pos = 1"))
def krum(spark, d):
    return long(fa.krum(fx.updates(spark, d), 2))


@query("multi_krum_agr4b", "AGR4", q.select([q.UPD, KRUM], f"SELECT u.round, u.j, {q.rnd('sum(u.weight*u.v)/sum(u.weight)')} AS v FROM upd u JOIN kr ON u.round=kr.round AND u.site=kr.site AND kr.pos <= kr.kk - 2 GROUP BY 1, 2"))
def multi_krum(spark, d):
    return long(fa.aggregate(fx.updates(spark, d), "multi_krum", f=2)[0])


@query("geometric_median_agr5", "AGR5")
def geometric_median(spark, d):
    return fa.geometric_median(fx.updates(spark, d))[0].select("round", F.posexplode("vec").alias("j", "v"))


# four steps of the fixed point, unrolled: distances from the mean by the present weights, then new weights
WEISZFELD = [q.UPD, "w0 AS (SELECT round, site, weight/sum(weight) OVER (PARTITION BY round) AS w, weight/sum(weight) OVER (PARTITION BY round) AS b FROM updw)"]
for _i in range(4):
    WEISZFELD += [f"z{_i} AS (SELECT u.round, u.j, sum(b*v) AS z FROM upd u JOIN w{_i} b ON u.round=b.round AND u.site=b.site GROUP BY 1, 2)",
                  f"d{_i} AS (SELECT u.round, u.site, greatest(sqrt(sum((u.v-z.z)*(u.v-z.z))), 1e-6) AS d FROM upd u JOIN z{_i} z ON u.round=z.round AND u.j=z.j GROUP BY 1, 2)",
                  f"w{_i + 1} AS (SELECT w.round, w.site, w, (w/d)/sum(w/d) OVER (PARTITION BY w.round) AS b FROM w{_i} w JOIN d{_i} d ON w.round=d.round AND w.site=d.site)"]


@query("geometric_median_steps_agr5b", "AGR5", q.select(WEISZFELD, f"SELECT u.round, u.j, {q.rnd('sum(b*v)')} AS v, 4 AS steps FROM upd u JOIN w4 b ON u.round=b.round AND u.site=b.site GROUP BY 1, 2"))
def geometric_median_four_steps(spark, d):
    z, _, report = fa.geometric_median_steps(fx.updates(spark, d), max_iter=4, tol=0.0)
    return z.select("round", F.posexplode("vec").alias("j", "v")).join(report, "round").select("round", "j", r("v").alias("v"), "steps")


NB = [q.UPD, "nm AS (SELECT round, site, sqrt(sum(v*v)) AS nrm FROM upd GROUP BY round, site)", "bd AS (SELECT round, 0.95e0*median(nrm) AS b FROM nm GROUP BY round)"]


@query("adaptive_norm_bound_agr6", "AGR6 PRJ15", q.select(NB, f"SELECT u.round, u.j, {q.rnd('sum(u.weight*u.v*least(1e0, b/greatest(nrm, 1e-12)))/sum(u.weight)')} AS v FROM upd u JOIN nm ON u.round=nm.round AND u.site=nm.site JOIN bd ON u.round=bd.round GROUP BY u.round, u.j"))
def adaptive_norm_bound(spark, d):
    return long(fa.aggregate(fx.updates(spark, d), "fedavg", "adaptive", 0.95)[0])


@query("norm_bound_flags_agr6b", "AGR6", q.select([*NB, "rk AS (SELECT round, site, j, 1 FROM upd)"], f"SELECT round, site, {q.rnd('nrm')} AS norm, nrm > 0.6e0 AS clipped, nrm > 0.6e0 AS flagged FROM nm"))
def norm_bound_flags(spark, d):
    info = fa.aggregate(fx.updates(spark, d), "fedavg", 0.6)[1]
    return info.select("round", "site", r("norm").alias("norm"), "clipped", "flagged")


@query("round_reduction_agr7", "AGR7", q.select([q.UPD, "nm AS (SELECT round, site, sqrt(sum(v*v)) AS nrm FROM upd GROUP BY round, site)", "sz AS (SELECT label AS site, count(*) AS n FROM embeddings GROUP BY label)"],
       f"SELECT u.round, u.j, {q.rnd('1e0 + sum(sz.n*u.v*least(1e0, 0.7e0/greatest(nrm, 1e-12)))/sum(sz.n)')} AS v FROM upd u JOIN nm ON u.round=nm.round AND u.site=nm.site JOIN sz ON u.site=sz.site GROUP BY u.round, u.j"))
def round_reduction(spark, d):
    u = fx.updates(spark, d)
    sites = fx.table(spark, d, "embeddings").groupBy(F.col("label").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    glob = u.groupBy("round").agg(F.first("vec").alias("v")).select("round", F.transform("v", lambda e: F.lit(1.0)).alias("vec"))
    out = fa.reduce_round(u, sites, glob, "registered", clip=0.7)
    return long(out.select("round", F.posexplode("vec").alias("j", "v")))


WEIGHTS = ["n AS (SELECT label AS site, count(*) AS n FROM embeddings GROUP BY label)", "w AS (SELECT site, n*1e0/sum(n) OVER () AS w FROM n)", "x AS (SELECT site, w, max(w) OVER () AS wm, count(*) OVER () AS k FROM w)"]


@query("noise_plan_prv1", "PRV1", q.select(WEIGHTS, f"SELECT 'central' AS mode, site, {q.rnd('0e0')} AS client_sd, {q.rnd('1.1e0*0.5e0*wm')} AS server_sd FROM x UNION ALL SELECT 'local', site, {q.rnd('1.1e0*0.5e0')}, 0e0 FROM x UNION ALL SELECT 'distributed', site, {q.rnd('1.1e0*0.5e0*wm/(sqrt(k)*w)')}, 0e0 FROM x"))
def noise_plan(spark, d):
    n = fx.table(spark, d, "embeddings").groupBy(F.col("label").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    w = fa.public_weights(n)
    out = None
    for mode in pv.MODES:
        p = pv.noise_plan(w, mode, 0.5, 1.1).select(F.lit(mode).alias("mode"), "site", r("client_sd").alias("client_sd"), r("server_sd").alias("server_sd"))
        out = p if out is None else out.unionByName(p)
    return out


@query("noisy_updates_prv1b", "PRV1")
def noisy_updates(spark, d):
    u = fx.updates(spark, d)
    plan = u.select("site").distinct().withColumn("client_sd", F.lit(0.1))
    return pv.add_noise(u, plan, 5).select("round", "site", sc.norm(F.col("vec")).alias("norm"))


REL = """rel AS (SELECT CASE label % 2 WHEN 0 THEN 'distributed' ELSE 'central' END AS mode, vec_id % 2 = 0 AS secure, vec_id % 3 AS round, label AS site, label <> 2 AS noisy FROM embeddings),
g AS (SELECT mode, secure, count(DISTINCT round) AS t, count(DISTINCT site) AS k, count(DISTINCT CASE WHEN noisy THEN site END) AS h FROM rel GROUP BY mode, secure),
mu AS (SELECT *, sqrt(t*1e0)/1.2e0 AS b FROM g)"""


def releases(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select(F.when(F.col("label") % 2 == 0, "distributed").otherwise("central").alias("mode"), (F.col("vec_id") % 2 == 0).alias("secure"),
                    (F.col("vec_id") % 3).alias("round"), F.col("label").alias("site"), (F.col("label") != 2).alias("noisy"), F.lit(None).cast("int").alias("min_honest"))


@query("privacy_ledger_prv2", "PRV2", q.select([REL], f"""SELECT mode, secure, t AS rounds, k AS sites, h AS noise_adders, {q.rnd("CASE mode WHEN 'central' THEN b ELSE b/sqrt(h*1e0/k) END")} AS mu_aggregate,
 {q.rnd("CASE WHEN mode = 'central' THEN 1e9 WHEN secure THEN b/sqrt(h*1e0/k) ELSE b*sqrt(k*1e0) END")} AS mu_server FROM mu"""))
def privacy_ledger(spark, d):
    g = pv.ledger(releases(spark, d), 1.2, with_epsilon=False)
    srv = F.when(F.col("mu_server") == float("inf"), 1e9).otherwise(F.col("mu_server"))
    return g.select("mode", "secure", "rounds", "sites", "noise_adders", r("mu_aggregate").alias("mu_aggregate"), r(srv).alias("mu_server"))


@query("privacy_epsilon_prv2b", "PRV2 UDF3")
def privacy_epsilon(spark, d):
    return pv.ledger(releases(spark, d), 1.2)


@query("secure_sum_prv3", "PRV3", q.select([q.UPD], f"SELECT round, j, {q.rnd('sum(round_even(weight*v*16777216e0, 0))/16777216e0/sum(weight)')} AS v FROM upd GROUP BY round, j"))
def secure_sum(spark, d):
    m = pv.masked_messages(fx.updates(spark, d), key=1234)
    return long(pv.unmask_sum(m))


@query("leakage_prv4", "PRV4 PRJ20", q.select([q.UPD, "cl AS (SELECT round, site, j, v, CASE WHEN site < 5 THEN -2e0*v ELSE v END AS sv FROM upd)"], f"SELECT round, {q.rnd('avg(c)')} AS honest_cos, count(*) AS sites FROM (SELECT round, site, sum(v*sv)/sqrt(sum(v*v))/sqrt(sum(sv*sv)) AS c FROM cl WHERE site NOT IN (3, 7) GROUP BY round, site) GROUP BY round"))
def leakage(spark, d):
    u = fx.updates(spark, d)
    low = u.select("site").distinct().filter("site < 5")
    seen = pv.poison(u, "sign_flip", 2.0, sites=low)
    bad = u.select("site").distinct().filter(F.col("site").isin(3, 7))
    t = pv.leakage_table(seen, u, bad)
    return t.groupBy("round").agg(r(F.avg("update_cos")).alias("honest_cos"), F.count(F.lit(1)).alias("sites"))
