"""Join shapes: coefficients to rows, estimates to truth, runs to the clean run, pairs and subsets of sites."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import curves as cv
from sitefold.operators import fedagg as fa
from sitefold.operators import gwas as gw
from sitefold.operators import privacy as pv
from sitefold.operators import sensitivity as se
from sitefold.operators import survival as sv
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query
from sitefold.plans.scans_queries import CURVES, gwas_sql
from sitefold.runtime import join_small

NAIVE_SQL = "nv AS (SELECT site, count(*) AS n, covar_samp(x, y)/var_samp(x) AS theta FROM mr GROUP BY site)"


@query("coefficients_to_rows_jon1", "JON1", q.select([q.MR, NAIVE_SQL], f"SELECT fold, site, {q.rnd('avg(y - theta*x)')} AS resid, {q.rnd('var_pop(y - theta*x)')} AS resid_var FROM mr JOIN nv USING (site) GROUP BY fold, site"))
def coefficients_to_rows(spark, d):
    mr = fx.mr_rows(spark, d)
    rows = join_small(mr, gw.naive_slope(mr).select("site", F.col("naive").alias("theta")), ["site"])
    u = F.col("y") - F.col("theta") * F.col("x")
    return rows.groupBy("fold", "site").agg(r(F.avg(u)).alias("resid"), r(F.var_pop(u)).alias("resid_var"))


TRUTH_SQL = "truth AS (SELECT CAST(n_nationkey AS INT) AS site, 0.25e0 + 0.01e0*n_nationkey AS avg_slope FROM nation)"


def truth(spark, d):
    return fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("site"), (0.25 + F.lit(0.01) * F.col("n_nationkey")).alias("avg_slope"))


@query("estimates_to_truth_jon2", "JON2", q.select([q.MR, NAIVE_SQL, TRUTH_SQL], f"SELECT site, n, {q.rnd('theta')} AS naive, {q.rnd('avg_slope')} AS avg_slope, {q.rnd('theta - avg_slope')} AS bias FROM nv JOIN truth USING (site)"))
def estimates_to_truth(spark, d):
    est = gw.naive_slope(fx.mr_rows(spark, d)).join(truth(spark, d), "site")
    return est.select("site", "n", r("naive").alias("naive"), r("avg_slope").alias("avg_slope"), r(F.col("naive") - F.col("avg_slope")).alias("bias"))


SCEN_SQL = "sc AS (SELECT *, CASE site WHEN 0 THEN 'clean' ELSE 'attack' || CAST(site AS VARCHAR) END AS scenario FROM curves)"


def scenario_curves(spark, d):
    c = fx.curves(fx.mr_rows(spark, d))
    name = F.when(F.col("site") == 0, "clean").otherwise(F.concat(F.lit("attack"), F.col("site").cast("string")))
    return c.select(name.alias("scenario"), F.lit("lineitem").alias("dataset"), F.col("round").alias("seed"), "x", "f")


@query("distance_to_clean_jon3", "JON3", q.select([*CURVES, SCEN_SQL, """rm AS (SELECT a.scenario, a.round, sqrt(avg((a.f-b.f)*(a.f-b.f))) AS v FROM sc a JOIN sc b ON a.round=b.round AND a.k=b.k AND b.scenario='clean'
  WHERE abs(a.x) <= 2e0 GROUP BY a.scenario, a.round)""", "runs AS (SELECT DISTINCT scenario, round FROM sc UNION ALL SELECT 'missing', 0)"],
       f"SELECT runs.scenario, 'lineitem' AS dataset, runs.round AS seed, {q.rnd('v')} AS rmse_clean FROM runs LEFT JOIN rm ON runs.scenario=rm.scenario AND runs.round=rm.round"))
def distance_to_clean(spark, d):
    c = scenario_curves(spark, d)
    runs = c.select("scenario", "dataset", "seed").distinct()
    extra = runs.limit(1).select(F.lit("missing").alias("scenario"), F.lit("lineitem").alias("dataset"), F.lit(0).alias("seed"))
    return cv.rmse_to_clean(c, runs.unionByName(extra)).select("scenario", "dataset", "seed", r("rmse_clean").alias("rmse_clean"))


REPS_SQL = ["reps AS (SELECT CAST((l_orderkey*31 + l_partkey*17 + l_linenumber) % 200 AS INT) AS rep, regr_slope(y, x) AS theta_1, regr_slope(y, snp0)/10e0 AS theta_2 FROM mr GROUP BY 1)",
            "boot AS (SELECT rep, k, x, theta_1*x + theta_2*x*x AS f FROM reps, grid)"]
BAND_SQL = "band AS (SELECT k, max(x) AS x, quantile_cont(f, 0.025e0) AS lo, quantile_cont(f, 0.975e0) AS hi, stddev_samp(f) AS sd FROM boot GROUP BY k)"


def boot(spark, d):
    x = F.col("x")
    return cv.with_grid(fx.replicates(fx.mr_rows(spark, d))).select("rep", "k", "x", (F.col("theta_1") * x + F.col("theta_2") * x * x).alias("f"))


@query("attach_band_jon4", "JON4", q.select([*CURVES, *REPS_SQL, BAND_SQL, "z AS (SELECT avg(f) AS f0 FROM curves WHERE round = 4 AND k = 30)"], f"""
SELECT site, round, c.k, {q.rnd('f')} AS f, {q.rnd('lo + f0')} AS f_lo, {q.rnd('hi + f0')} AS f_hi FROM curves c CROSS JOIN z LEFT JOIN band b ON c.k=b.k AND c.round = 4"""))
def attach_band(spark, d):
    c = fx.curves(fx.mr_rows(spark, d))
    out = cv.attach_band(c, cv.percentile_band(boot(spark, d)))
    return out.select("site", "round", "k", r("f").alias("f"), r("f_lo").alias("f_lo"), r("f_hi").alias("f_hi"))


@query("scenario_grid_jon5", "JON5", """WITH a AS (SELECT lower(r_name) AS attack, CAST(r_regionkey + 1 AS DOUBLE) AS scale FROM region),
d AS (SELECT DISTINCT lower(p_type) AS defense FROM part)
SELECT attack || '|' || defense AS scenario, scale, CASE WHEN defense = 'economy' THEN 0.2e0 END AS trim, CASE WHEN attack = 'asia' THEN 1 ELSE 0 END AS start_round FROM a, d""")
def scenario_grid(spark, d):
    attacks = fx.table(spark, d, "region").select(F.lower("r_name").alias("attack"), F.create_map(
        F.lit("scale"), (F.col("r_regionkey") + 1).cast("string"), F.lit("start_round"), F.lit("0")).alias("base"))
    over = F.when(F.col("attack") == "asia", F.create_map(F.lit("start_round"), F.lit("1"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    attacks = attacks.withColumn("over", over)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    defenses = fx.table(spark, d, "part").select(F.lower("p_type").alias("defense")).distinct().withColumn(
        "conf", F.when(F.col("defense") == "economy", F.create_map(F.lit("trim"), F.lit("0.2"))).otherwise(none))
    # the grid repeats each attack once per configured defense
    listed = defenses.agg(F.collect_list(F.struct("defense", "conf")).alias("l")).scalar()
    g = attacks.withColumn("_d", F.explode(listed)).select("attack", "base", "over", "_d.defense", "_d.conf")
    return g.select(sc_name("attack", "defense"), merged("base", "over", "conf")).select(
        "scenario", F.col("c")["scale"].cast("double").alias("scale"), F.try_element_at("c", F.lit("trim")).cast("double").alias("trim"), F.col("c")["start_round"].cast("int").alias("start_round"))


def sc_name(a, b):
    return F.concat(F.col(a), F.lit("|"), F.col(b)).alias("scenario")


def merged(*maps):
    """Later maps override earlier keys."""
    out = F.col(maps[0])
    for m in maps[1:]:
        out = F.map_concat(_without(out, F.col(m)), F.col(m))
    return out.alias("c")


def _without(base, other):
    return F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(other), k))


@query("pairwise_site_z_jon6", "JON6 ROB9", q.select([q.MR, gwas_sql(), """iv AS (SELECT site, max(n) AS n, sum(beta_x*beta_y/(se_y*se_y))/sum(beta_x*beta_x/(se_y*se_y)) AS theta,
   1e0/sum(beta_x*beta_x/(se_y*se_y)) AS v FROM gw GROUP BY site)"""], f"SELECT a.site AS site_i, b.site AS site_j, {q.rnd('(a.theta-b.theta)/sqrt(a.v+b.v)')} AS z FROM iv a JOIN iv b ON a.site <> b.site"))
def pairwise_site_z(spark, d):
    est = gw.ivw(gw.gwas(fx.mr_rows(spark, d), fx.SNPS)).select("site", F.col("ivw").alias("theta_1"), (F.col("ivw_se") * F.col("ivw_se")).alias("v_1_1"))
    return se.pairwise_z(est).select("site_i", "site_j", r("z").alias("z"))


@query("pair_masks_jon7", "JON7", q.select([q.UPD], "SELECT a.round, count(DISTINCT a.site || '-' || b.site) AS pairs, CAST(0 AS BIGINT) AS uncancelled FROM updw a JOIN updw b ON a.round=b.round AND a.site < b.site GROUP BY a.round"))
def pair_masks(spark, d):
    u = fx.updates(spark, d)
    m = pv.pair_masks(u, 99)
    n = u.groupBy("round").agg(F.count(F.lit(1)).alias("k"))
    left = m.groupBy("round", "c").agg(F.sum("mask").cast("decimal(38,0)").alias("s")).withColumn(
        "bad", (F.pmod("s", pv._wide(pv.TWO64)) != 0).cast("bigint"))
    return left.groupBy("round").agg(F.sum("bad").alias("uncancelled")).join(n, "round").select(
        "round", F.floor(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"), "uncancelled")


@query("pairwise_distances_jon8", "JON8", q.select([q.UPD], f"SELECT a.round, a.site AS site_i, b.site AS site_j, {q.rnd('sum((a.v-b.v)*(a.v-b.v))')} AS d2 FROM upd a JOIN upd b ON a.round=b.round AND a.j=b.j AND a.site<>b.site GROUP BY 1, 2, 3"))
def pairwise_distances(spark, d):
    return fa.pairwise_distances(fx.updates(spark, d)).select("round", "site_i", "site_j", r("d2").alias("d2"))


@query("subset_membership_jon9", "JON9 SET5", q.select([q.MR, "s AS (SELECT site, count(*) AS n FROM mr GROUP BY site)", "pr AS (SELECT a.site AS i, b.site AS j, a.n + b.n AS gone FROM s a JOIN s b ON a.site < b.site)"],
       "SELECT i, j, CAST((SELECT sum(n) FROM s) - gone AS BIGINT) AS n_left, (SELECT count(*) FROM s) - 2 AS sites_left FROM pr"))
def subset_membership(spark, d):
    s = fx.mr_rows(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    sets = se.leave_out_sets(s, 2)
    # what is left is the total less the members' own: an equi-join on the members, whatever the number of sites
    gone = sets.select("members", F.explode("members").alias("site")).join(s, "site").groupBy("members").agg(F.sum("n").alias("gone"), F.count(F.lit(1)).alias("k"))
    total = s.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"))
    return gone.select(F.col("members")[0].alias("i"), F.col("members")[1].alias("j"), (total.select("n").scalar() - F.col("gone")).alias("n_left"), (total.select("sites").scalar() - F.col("k")).alias("sites_left"))


@query("honest_and_malicious_jon10", "JON10 TOP1", q.select([q.MR, "s AS (SELECT site, count(*) AS n FROM mr GROUP BY site)", "bad AS (SELECT site FROM s ORDER BY n DESC, site LIMIT 2)"],
       f"SELECT fold, {q.rnd('avg(CASE WHEN site NOT IN (SELECT site FROM bad) THEN y END)')} AS honest_y, {q.rnd('avg(CASE WHEN site IN (SELECT site FROM bad) THEN y END)')} AS malicious_y FROM mr GROUP BY fold"))
def honest_and_malicious(spark, d):
    mr = fx.mr_rows(spark, d).select("site", "fold", "y")
    bad = F.broadcast(fa.select_sites(mr.groupBy("site").agg(F.count(F.lit(1)).alias("n")), 2))
    h = mr.join(bad, "site", "left_anti").groupBy("fold").agg(r(F.avg("y")).alias("honest_y"))
    m = mr.join(bad, "site", "left_semi").groupBy("fold").agg(r(F.avg("y")).alias("malicious_y"))
    return h.join(m, "fold")


@query("comparable_pairs_jon12", "JON12 SRV6", q.select([q.SURV, "c AS (SELECT site, time, event, count(*) AS n FROM sv GROUP BY ALL)"],
       "SELECT a.site, CAST(sum(a.n*b.n) AS BIGINT) AS pairs FROM c a JOIN c b ON a.site=b.site AND a.event=1 AND (b.time > a.time OR (b.time = a.time AND b.event = 0)) GROUP BY a.site"))
def comparable_pairs(spark, d):
    return sv.concordance(fx.mr_surv(spark, d), "x", ("site",)).select("site", F.col("pairs").cast("bigint").alias("pairs"))


@query("prefer_else_fallback_jon13", "JON13", q.select([q.MR, "p AS (SELECT site, regr_slope(y, x) AS t1, regr_slope(y, snp0) AS t2 FROM mr WHERE fold = 0 GROUP BY site)", "f AS (SELECT site, regr_slope(y, x) AS t1, regr_slope(y, snp0) AS t2 FROM mr GROUP BY site)"],
       f"SELECT f.site, {q.rnd('CASE WHEN p.site < 3 AND p.site <> 1 THEN p.t1 ELSE f.t1 END')} AS theta_1, {q.rnd('CASE WHEN p.site < 3 AND p.site <> 1 THEN p.t2 ELSE f.t2 END')} AS theta_2 FROM f LEFT JOIN p USING (site)"))
def prefer_else_fallback(spark, d):
    mr = fx.mr_rows(spark, d)

    def fits(df):
        return df.groupBy("site").agg(F.regr_slope("y", "x").alias("theta_1"), F.regr_slope("y", "snp0").alias("theta_2"))

    # site 1's run lacks the second term, sites 3 and 4 have no run
    run = fits(mr.filter("fold = 0 AND site < 3")).withColumn("theta_2", F.when(F.col("site") != 1, F.col("theta_2")))
    out = prefer(run, fits(mr), ["theta_1", "theta_2"], needs="theta_2")
    return out.select("site", r("theta_1").alias("theta_1"), r("theta_2").alias("theta_2"))


def prefer(run, fallback, cols, needs, key="site"):
    """The run's estimate where it has the needed term, else the fallback's; one source per row."""
    j = fallback.join(run.select(key, F.lit(True).alias("_run"), *[F.col(c).alias(f"_r_{c}") for c in cols]), key, "left")
    use = F.coalesce(F.col("_run"), F.lit(False)) & F.col(f"_r_{needs}").isNotNull()
    return j.select(key, *[F.when(use, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


@query("estimator_rows_set1", "SET1", q.select([q.MR, gwas_sql()], f"""SELECT 'naive' AS estimator, site, {q.rnd('covar_samp(x,y)/var_samp(x)')} AS theta1, NULL::DOUBLE AS se1, NULL::DOUBLE AS mean_F FROM mr GROUP BY site
 UNION ALL SELECT 'ivw', site, {q.rnd('sum(beta_x*beta_y/(se_y*se_y))/sum(beta_x*beta_x/(se_y*se_y))')}, {q.rnd('sqrt(1e0/sum(beta_x*beta_x/(se_y*se_y)))')}, {q.rnd('avg(beta_x*beta_x/(se_x*se_x))', 3)} FROM gw GROUP BY site"""))
def estimator_rows(spark, d):
    mr = fx.mr_rows(spark, d)
    a = gw.naive_slope(mr).select(F.lit("naive").alias("estimator"), "site", r("naive").alias("theta1"))
    b = gw.ivw(gw.gwas(mr, fx.SNPS)).select(F.lit("ivw").alias("estimator"), "site", r("ivw").alias("theta1"), r("ivw_se").alias("se1"), r("mean_F", 3).alias("mean_F"))
    return a.unionByName(b, allowMissingColumns=True)


@query("column_union_set2", "SET2", """SELECT name, min(first_site) AS first_site, count(*) AS sites FROM (
 SELECT 'x' AS name, CAST(l_suppkey % 5 AS INT) AS first_site FROM lineitem GROUP BY 2 UNION ALL
 SELECT 'snp' || CAST(l_partkey % 7 AS VARCHAR), CAST(l_suppkey % 5 AS INT) FROM lineitem GROUP BY 1, 2) GROUP BY name""")
def column_union(spark, d):
    li = fx.table(spark, d, "lineitem")
    site = (F.col("l_suppkey") % 5).cast("int").alias("site")
    names = li.select(F.lit("x").alias("name"), site).distinct().unionByName(
        li.select(F.concat(F.lit("snp"), (F.col("l_partkey") % 7).cast("string")).alias("name"), site).distinct())
    return names.groupBy("name").agg(F.min("site").alias("first_site"), F.count(F.lit(1)).alias("sites"))


@query("accepted_intersection_set3", "SET3", """WITH s AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS site, l_returnflag || l_linestatus AS member FROM lineitem WHERE l_quantity > 30 OR l_suppkey % 5 <> 2 OR l_returnflag <> 'A')
SELECT member FROM s GROUP BY member HAVING count(*) = (SELECT count(DISTINCT site) FROM s)""")
def accepted_intersection(spark, d):
    li = fx.table(spark, d, "lineitem")
    site = (F.col("l_suppkey") % 5).cast("int")
    m = li.filter((F.col("l_quantity") > 30) | (site != 2) | (F.col("l_returnflag") != "A")).select(
        site.alias("site"), F.concat("l_returnflag", "l_linestatus").alias("member")).distinct()
    sets = m.groupBy("site").agg(F.array_sort(F.collect_set("member")).alias("ms")).select(
        F.array_join("ms", "+").alias("predictors"), F.lit(True).alias("accepted"))
    return se.intersect_sets(sets)


@query("name_differences_set4", "SET4", """WITH a AS (SELECT DISTINCT l_linenumber % 5 AS c FROM lineitem), b AS (SELECT DISTINCT CAST(l_partkey % 9 AS INT) AS c FROM lineitem WHERE l_partkey % 9 > 1)
SELECT 'z_only' AS side, CAST(c AS INT) AS c FROM a WHERE c NOT IN (SELECT c FROM b) UNION ALL SELECT 'w_only', c FROM b WHERE c NOT IN (SELECT c FROM a)""")
def name_differences(spark, d):
    li = fx.table(spark, d, "lineitem")
    a = li.select((F.col("l_linenumber") % 5).alias("c")).distinct()
    b = li.select((F.col("l_partkey") % 9).cast("int").alias("c")).filter("c > 1").distinct()
    return (a.exceptAll(b).select(F.lit("z_only").alias("side"), "c")
            .unionByName(b.exceptAll(a).select(F.lit("w_only").alias("side"), "c")))


@query("site_subsets_set5", "SET5", q.select(["s AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS site FROM lineitem)", "m AS (SELECT CAST(k AS INT) AS mask FROM range(32) r(k))"],
       "SELECT mask, count(site) AS size, COALESCE(string_agg(CAST(site AS VARCHAR), ',' ORDER BY site), '') AS members FROM m LEFT JOIN s ON (mask >> site) & 1 = 1 GROUP BY mask"))
def site_subsets(spark, d):
    s = fx.mr_rows(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    all_sites = s.agg(F.array_sort(F.collect_list("site")).alias("sites"))
    masks = all_sites.withColumn("mask", F.explode(F.expr("sequence(0, cast(pow(2, size(sites)) - 1 as int))")))
    chosen = F.filter("sites", lambda v, i: F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    return masks.select("mask", F.bit_count("mask").cast("bigint").alias("size"), F.array_join(F.transform(chosen, lambda v: v.cast("string")), ",").alias("members"))
