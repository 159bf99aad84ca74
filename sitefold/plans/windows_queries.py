"""Cumulative, leave-one-out, rank and median windows, splits and top-k."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import fedagg as fa
from sitefold.operators import gwas as gw
from sitefold.operators import ordered as od
from sitefold.operators import sensitivity as se
from sitefold.operators import survival as sv
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.aggregates_queries import BUNDLE_CTES, FLAG_SQL, GW
from sitefold.plans.registry import query

# one-regressor 2SLS on pooled (xhat) moments
LIN = "SELECT *, a/b AS theta, sqrt(greatest((f - 2e0*(a/b)*e + (a/b)*(a/b)*d)/greatest(n - k - 1, 1)*qq/(b*b), 0e0)) AS se FROM {src}"
LIN_COLS = "n, 1 AS k, s_xhat__y AS a, s_x__xhat AS b, s_xhat__xhat AS qq, s_y__y AS f, s_x__y AS e, s_x__x AS d"
LIN_BASE = [*BUNDLE_CTES, f"lb AS (SELECT site, {LIN_COLS} FROM bun)"]
LIN_SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("n", "k", "a", "b", "qq", "f", "e", "d"))


def lin_work(spark, d):
    return se.working(se.linear_bundle(fx.mr_rows(spark, d), fx.SNPS), "linear")


@query("cumulative_sites_win1", "WIN1", q.select([*LIN_BASE, "cu AS (SELECT site, row_number() OVER o AS step, " + ", ".join(f"sum({c}) OVER o AS {c}" for c in ("n", "k", "a", "b", "qq", "f", "e", "d")) + " FROM lb WINDOW o AS (ORDER BY lb.n DESC, site ROWS UNBOUNDED PRECEDING))",
       f"fit AS ({LIN.format(src='cu')})"], f"SELECT step, site, CAST(n AS BIGINT) AS n, {q.rnd('theta')} AS theta_1, {q.rnd('se')} AS se_1 FROM fit"))
def cumulative_sites(spark, d):
    c = se.cumulative(lin_work(spark, d), "linear", [F.col("n").desc()])
    return c.select(F.col("step").cast("bigint").alias("step"), "site", "n", r("theta_1").alias("theta_1"), r("se_1").alias("se_1"))


DROP1 = "dr AS (SELECT l.site, " + ", ".join(f"t.{c} - l.{c} AS {c}" for c in ("n", "k", "a", "b", "qq", "f", "e", "d")) + f" FROM lb l, (SELECT {LIN_SUMS} FROM lb) t)"


@query("drop_one_influence_win2", "WIN2 ROB16", q.select([*LIN_BASE, DROP1, f"fd AS ({LIN.format(src='dr')})", f"ft AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM lb)')})", f"fo AS ({LIN.format(src='lb')})"],
       f"""SELECT fd.site, CAST(fd.n AS BIGINT) AS n_left, {q.rnd('fd.theta')} AS theta_without, {q.rnd('(ft.theta - fd.theta)/ft.se', 5)} AS shift, {q.rnd('fo.theta')} AS theta_site,
  {q.rnd('(1e0/(fo.se*fo.se)) / (SELECT sum(1e0/(se*se)) FROM fo)')} AS share FROM fd JOIN fo ON fd.site=fo.site, ft"""))
def drop_one_influence(spark, d):
    i = se.influence(lin_work(spark, d), "linear")
    return i.select("site", "n_left", r("theta_without").alias("theta_without"), r("shift", 5).alias("shift"), r("theta_site").alias("theta_site"), r("share").alias("share"))


@query("coordinate_ranks_win3", "WIN3", q.select([q.UPD], "SELECT round, site, j, CAST(row_number() OVER (PARTITION BY round, j ORDER BY v, site) - 1 AS INT) AS rank FROM upd"))
def coordinate_ranks(spark, d):
    return fa.ranked(fx.updates(spark, d)).select("round", "site", "j", "rank")


WMED = """cw AS (SELECT u.round, u.j, u.site, u.v, u.weight/t.tw AS w, sum(u.weight/t.tw) OVER (PARTITION BY u.round, u.j ORDER BY u.v, u.site ROWS UNBOUNDED PRECEDING) AS c
  FROM upd u JOIN (SELECT round, sum(weight) AS tw FROM updw GROUP BY round) t USING (round))"""


@query("weighted_median_win4", "WIN4", q.select([q.UPD, WMED], f"SELECT round, j, {q.rnd('min_by(v, c)')} AS v FROM cw WHERE c >= 0.5e0 - 1e-12 GROUP BY round, j"))
def weighted_median(spark, d):
    return fa.weighted_median(fx.updates(spark, d)).select("round", "j", r("v").alias("v"))


@query("risk_sets_win5", "WIN5", q.select([q.SURV], f"""SELECT DISTINCT site, time, {q.rnd('sum(exp(0.1e0*x)) OVER (PARTITION BY site ORDER BY time DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS s0,
  count(*) OVER (PARTITION BY site ORDER BY time DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk FROM sv"""))
def risk_sets(spark, d):
    rs = sv.risk_sets(fx.mr_surv(spark, d), F.exp(0.1 * F.col("x")))
    return rs.select("site", "time", r("cum_s0", 4).alias("s0"), F.col("cum_at_risk").alias("at_risk"))




@query("auc_win7", "WIN7 MET3", q.select([q.MR, "rk AS (SELECT site, yb, rank() OVER (PARTITION BY site ORDER BY x) + (count(*) OVER (PARTITION BY site, x) - 1)/2e0 AS rr FROM mr)"],
       f"""SELECT site, CAST(sum(yb) AS BIGINT) AS n_pos, CAST(count(*) - sum(yb) AS BIGINT) AS n_neg, {q.rnd('(sum(CASE WHEN yb=1 THEN rr END) - sum(yb)*(sum(yb)+1)/2e0)/(sum(yb)*1e0*(count(*)-sum(yb)))')} AS auc FROM rk GROUP BY site"""))
def auc(spark, d):
    return od.auc(fx.mr_rows(spark, d), "x", "yb", ("site",)).select("site", "n_pos", "n_neg", r("auc").alias("auc"))


@query("stratified_split_win8", "WIN8", q.select([q.MR], "SELECT site, yb, count(*) AS n, CAST(ceil(count(*)*0.2e0) AS BIGINT) AS n_test FROM mr GROUP BY site, yb"))
def stratified_split(spark, d):
    s = od.train_test_split(fx.mr_rows(spark, d), 0.2, ("site",), ("yb",), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"), 3)
    return s.groupBy("site", "yb").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("n_test"))


@query("hashed_folds_win8b", "WIN8", q.select([q.MR, "n AS (SELECT site, count(*) AS n FROM mr GROUP BY site)", "f AS (SELECT CAST(k AS INT) AS fold FROM range(5) r(k))"],
       "SELECT site, fold, CAST(floor((n - fold - 1)/5e0) + 1 AS BIGINT) AS n FROM n, f"))
def hashed_folds(spark, d):
    f = od.fold_ids(fx.mr_rows(spark, d).drop("fold"), 5, ("site",), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"), 11)
    return f.groupBy("site", "fold").agg(F.count(F.lit(1)).alias("n"))


SITES_SQL = "s AS (SELECT l_suppkey AS site, count(*) AS n FROM lineitem GROUP BY l_suppkey)"


@query("site_selection_top1", "TOP1", q.select([SITES_SQL], """SELECT 'largest' AS how, site, n FROM (SELECT * FROM s ORDER BY n DESC, site LIMIT 3) UNION ALL
 SELECT 'smallest', site, n FROM (SELECT * FROM s ORDER BY n, site LIMIT 3) UNION ALL SELECT 'listed', site, n FROM s WHERE site IN (1, 4)"""))
def site_selection(spark, d):
    s = fx.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    parts = [fa.select_sites(s, 3, how).select(F.lit(how).alias("how"), "site", "n") for how in ("largest", "smallest")]
    parts.append(fa.select_sites(s, 2, explicit=[1, 4]).select(F.lit("listed").alias("how"), "site", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KRUM = """d2 AS (SELECT a.round, a.site AS i, b.site AS k, sum((a.v-b.v)*(a.v-b.v)) AS d2 FROM upd a JOIN upd b ON a.round=b.round AND a.j=b.j AND a.site<>b.site GROUP BY 1, 2, 3),
nr AS (SELECT *, row_number() OVER (PARTITION BY round, i ORDER BY d2, k) AS r, count(*) OVER (PARTITION BY round, i) + 1 AS kk FROM d2),
ks AS (SELECT round, i AS site, sum(d2) AS score, max(kk) AS kk FROM nr WHERE r <= kk - 2 - 2 GROUP BY round, i),
kr AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY score, site) AS pos FROM ks)"""


@query("nearest_updates_top2", "TOP2", q.select([q.UPD, KRUM], f"SELECT round, site, {q.rnd('score')} AS score, pos <= kk - 2 AS kept FROM kr"))
def nearest_updates(spark, d):
    s = fa.krum_selection(fx.updates(spark, d), f=2, multi=True)
    return s.select("round", "site", r("krum_score").alias("score"), F.col("sel").alias("kept"))


@query("most_influential_top3", "TOP3", q.select([*LIN_BASE, DROP1, f"fd AS ({LIN.format(src='dr')})", f"ft AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM lb)')})", "sh AS (SELECT fd.site, (ft.theta-fd.theta)/ft.se AS shift FROM fd, ft)"],
       f"SELECT max_by(site, abs(shift)) AS site, {q.rnd('max(abs(shift))', 5)} AS shift FROM sh"))
def most_influential(spark, d):
    i = se.influence(lin_work(spark, d), "linear")
    return i.agg(F.max_by("site", F.abs("shift")).alias("site"), r(F.max(F.abs("shift")), 5).alias("shift"))


@query("subset_sample_top4", "TOP4", """WITH s AS (SELECT l_suppkey % 5 AS site FROM lineitem GROUP BY 1) SELECT least(7, count(*)*(count(*)-1)//2) AS kept FROM s""")
def subset_sample(spark, d):
    s = fx.mr_rows(spark, d).select("site").distinct()
    return se.sample_subsets(se.leave_out_sets(s, 2), 7).agg(F.count(F.lit(1)).alias("kept"))


@query("ordered_preview_top5", "TOP5", q.select([q.MR, FLAG_SQL, "s AS (SELECT CASE malicious WHEN 1 THEN 'attack' ELSE 'clean' END AS scenario, round, sum(flagged) AS flagged FROM fl GROUP BY 1, 2)"],
       "SELECT scenario, round, CAST(flagged AS BIGINT) AS flagged FROM s ORDER BY CASE scenario WHEN 'clean' THEN 0 ELSE 1 END, round LIMIT 7"))
def ordered_preview(spark, d):
    from sitefold.operators.metrics import ordered_scenarios

    log = fx.mr_rows(spark, d).groupBy("site", F.col("fold").alias("round")).agg((F.avg("y") > 3.9).cast("int").alias("flagged"))
    s = log.groupBy(F.when(F.col("site").isin(1, 3), "attack").otherwise("clean").alias("scenario"), "round").agg(F.sum("flagged").alias("flagged"))
    ranked = ordered_scenarios(s, ["clean"])
    return ranked.orderBy(F.col("scenario").desc(), "round").limit(7).select("scenario", "round", "flagged")


@query("weak_instrument_filter_top6", "TOP6", q.select([*LIN_BASE, *GW[1:], "kp AS (SELECT lb.* FROM lb JOIN iw USING (site) WHERE mean_f >= 43000)", f"fit AS ({LIN.format(src=f'(SELECT {LIN_SUMS} FROM kp)')})"],
       f"SELECT CAST(k AS BIGINT) AS sites, {q.rnd('theta')} AS theta_1, {q.rnd('se')} AS se_1 FROM fit"))
def weak_instrument_filter(spark, d):
    b = se.linear_bundle(fx.mr_rows(spark, d), fx.SNPS)
    f = gw.ivw(se.bundle_gwas(b, fx.SNPS)).select("site", "mean_F")
    e = se.weak_filter(se.working(b.join(f, "site"), "linear"), "linear", 43000.0)
    return e.select(F.col("K").cast("bigint").alias("sites"), r("theta_1").alias("theta_1"), r("se_1").alias("se_1"))


@query("exact_quantiles_win4b", "WIN4 PRJ13", q.select([q.MR], f"SELECT site, {q.rnd('quantile_cont(y, 0.05e0)')} AS q05, {q.rnd('quantile_cont(y, 0.5e0)')} AS q50, {q.rnd('quantile_cont(y, 0.95e0)')} AS q95 FROM mr GROUP BY site"))
def exact_quantiles(spark, d):
    e = od.exact_quantiles(fx.mr_rows(spark, d), "y", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, ("site",))
    return e.select("site", *[r(c).alias(c) for c in ("q05", "q50", "q95")])
