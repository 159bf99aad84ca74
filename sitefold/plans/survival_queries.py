"""Hazard regressions, risk sets, partial likelihood and concordance."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import survival as sv
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query

STEPS = 7


def newton_sql(keys: str, x: str, ties: str, src: str, steps: int = STEPS) -> list[str]:
    """Unrolled Newton steps for one slope per key group; risk sets per stratum column `st`.

    src has columns (key columns, st, time, x, event).
    """
    k = f"{keys}, " if keys else ""
    on = f"JOIN b{{i}} USING ({keys})" if keys else ", b{i}"
    ctes = [f"cc AS (SELECT {k}st, time, {x} AS x, count(*) AS n, sum(event) AS d FROM {src} GROUP BY {k}st, time, {x})",
            f"b0 AS (SELECT {k}0e0 AS beta, 0e0 AS info FROM cc GROUP BY {keys})" if keys else "b0 AS (SELECT 0e0 AS beta, 0e0 AS info)"]
    for i in range(steps):
        j = on.format(i=i)
        ctes.append(f"t{i} AS (SELECT {k}st, time, max(beta) AS beta, sum(n*exp(beta*x)) AS s0, sum(n*x*exp(beta*x)) AS s1, sum(n*x*x*exp(beta*x)) AS s2, sum(d*exp(beta*x)) AS e0, sum(d*x*exp(beta*x)) AS e1, sum(d*x*x*exp(beta*x)) AS e2, sum(d) AS d, sum(d*x) AS dx FROM cc {j} GROUP BY {k}st, time)")
        ctes.append(f"r{i} AS (SELECT {k}st, beta, d, dx, e0, e1, e2, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM t{i} WINDOW w AS (PARTITION BY {k}st ORDER BY time DESC ROWS UNBOUNDED PRECEDING))")
        if ties == "breslow":
            terms = f"SELECT {k}beta, dx AS dx, d*s1/s0 AS m, d*(s2/s0 - s1*s1/(s0*s0)) AS v, d*ln(s0) AS l FROM r{i} WHERE d > 0"
        else:
            terms = (f"SELECT {k}beta, dx/d AS dx, (s1-f*e1)/(s0-f*e0) AS m, (s2-f*e2)/(s0-f*e0) - (s1-f*e1)*(s1-f*e1)/((s0-f*e0)*(s0-f*e0)) AS v, ln(s0-f*e0) AS l "
                     f"FROM (SELECT *, l*1e0/d AS f FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM r{i} WHERE d > 0))")
        ctes.append(f"b{i + 1} AS (SELECT {k}max(beta) + sum(dx - m)/sum(v) AS beta, sum(v) AS info FROM ({terms}) {'GROUP BY ' + keys if keys else ''})")
    return ctes


def newton2_sql(x1: str, x2: str, src: str, steps: int = STEPS) -> list[str]:
    """Unrolled Efron Newton steps for two slopes; strata in column st."""
    def cells(weight, prefix):
        e = f"{weight}*exp(b1*x1+b2*x2)"
        return ", ".join(f"sum({e}{f}) AS {prefix}{k}" for k, f in (("0", ""), ("1", "*x1"), ("2", "*x2"), ("11", "*x1*x1"), ("12", "*x1*x2"), ("22", "*x2*x2")))

    ks = ("0", "1", "2", "11", "12", "22")
    ctes = [f"cc AS (SELECT st, time, {x1} AS x1, {x2} AS x2, count(*) AS n, sum(event) AS d FROM {src} GROUP BY ALL)", "b0 AS (SELECT 0e0 AS b1, 0e0 AS b2, 0e0 AS i11, 0e0 AS i12, 0e0 AS i22)"]
    for i in range(steps):
        ctes.append(f"t{i} AS (SELECT st, time, {cells('n', 's')}, {cells('d', 'e')}, sum(d) AS d, sum(d*x1) AS dx1, sum(d*x2) AS dx2 FROM cc, b{i} GROUP BY st, time)")
        ctes.append(f"r{i} AS (SELECT d, dx1, dx2, {', '.join('e' + k for k in ks)}, {', '.join(f'sum(s{k}) OVER w AS s{k}' for k in ks)} FROM t{i} WINDOW w AS (PARTITION BY st ORDER BY time DESC ROWS UNBOUNDED PRECEDING))")
        ctes.append(f"f{i} AS (SELECT dx1/d AS dx1, dx2/d AS dx2, {', '.join(f's{k} - (l*1e0/d)*e{k} AS q{k}' for k in ks)} FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM r{i} WHERE d > 0))")
        ctes.append(f"u{i} AS (SELECT sum(dx1 - q1/q0) AS u1, sum(dx2 - q2/q0) AS u2, sum(q11/q0 - q1*q1/(q0*q0)) AS i11, sum(q12/q0 - q1*q2/(q0*q0)) AS i12, sum(q22/q0 - q2*q2/(q0*q0)) AS i22 FROM f{i})")
        ctes.append(f"b{i + 1} AS (SELECT b1 + (u.i22*u1 - u.i12*u2)/(u.i11*u.i22-u.i12*u.i12) AS b1, b2 + (u.i11*u2 - u.i12*u1)/(u.i11*u.i22-u.i12*u.i12) AS b2, u.i11, u.i12, u.i22 FROM u{i} u, b{i})")
    return ctes


STRAT = "sx AS (SELECT site AS st, time, event, x FROM sv)"
FLAT = "sx AS (SELECT 0 AS st, time, event, x FROM sv)"


def _one(ties, src):
    return q.select([q.SURV, src, *newton_sql("", "x", ties, "sx")], f"SELECT 'x' AS term, {q.rnd(f'b{STEPS}.beta')} AS beta, {q.rnd(f'1e0/sqrt(b{STEPS}.info)')} AS se FROM b{STEPS}")


@query("cox_stratified_srv1", "SRV1", _one("efron", STRAT))
def cox_stratified(spark, d):
    return sv.cox(fx.mr_surv(spark, d), ["x"], ["site"]).select("term", r("beta").alias("beta"), r("se").alias("se"))


@query("cox_breslow_srv1b", "SRV1", _one("breslow", FLAT))
def cox_breslow(spark, d):
    return sv.cox(fx.mr_surv(spark, d), ["x"], ties="breslow").select("term", r("beta").alias("beta"), r("se").alias("se"))


def _gwas(ties):
    long = "sl AS (SELECT site, 'snp0' AS snp, 0 AS st, time, event, snp0 AS g FROM sv UNION ALL SELECT site, 'snp1', 0, time, event, snp1 FROM sv)"
    return q.select([q.SURV, long, *newton_sql("site, snp", "g", ties, "sl")], f"SELECT site, snp, {q.rnd('beta')} AS beta, {q.rnd('1e0/sqrt(info)')} AS se FROM b{STEPS}")


@query("cox_gwas_srv2", "SRV2", _gwas("breslow"))
def cox_gwas(spark, d):
    return sv.cox_gwas(fx.mr_surv(spark, d), fx.SNPS, ties="breslow").select("site", "snp", r("beta").alias("beta"), r("se").alias("se"))


@query("cox_gwas_efron_srv2b", "SRV2", _gwas("efron"))
def cox_gwas_efron(spark, d):
    return sv.cox_gwas(fx.mr_surv(spark, d), fx.SNPS).select("site", "snp", r("beta").alias("beta"), r("se").alias("se"))


# twenty imputed dosages, each a whole number and a fraction
TWENTY = [f"(snp0*{k + 1} + snp1*{k % 5} + snp2*{k % 3 + 1}) % 3 + u*{k % 4 + 1}" for k in range(20)]


@query("cox_gwas_imputed_srv2c", "SRV2", q.select([q.SURV, f"sg AS (SELECT site, time, event, [{', '.join(TWENTY)}] AS v FROM sv)",
       "sl AS (SELECT site, 0 AS st, time, event, 'snp' || unnest(range(20)) AS snp, unnest(v) AS g FROM sg)", *newton_sql("site, snp", "g", "breslow", "sl")],
       f"SELECT site, snp, {q.rnd('beta', 5)} AS beta, {q.rnd('1e0/sqrt(info)', 5)} AS se FROM b{STEPS}"))
def cox_gwas_imputed(spark, d):
    rows = fx.mr_surv(spark, d).withColumn("g", F.array(*[F.expr(e) for e in TWENTY]))
    return sv.cox_gwas(rows, 20, ties="breslow").select("site", "snp", r("beta", 5).alias("beta"), r("se", 5).alias("se"))


def predicted(spark, d):
    """Survival rows with each site's predicted exposure."""
    return fx.local_rows(fx.mr_surv(spark, d))


SXH = [q.SURV, q.mom("mom", ["snp0", "snp1", "x"], ("site",), "sv"), q.fs(), "sh AS (SELECT sv.site, sv.time, sv.event, sv.x, a0 + p0*sv.snp0 + p1*sv.snp1 AS xhat FROM sv JOIN fs USING (site))"]


@query("predictor_substitution_srv3", "SRV3", q.select([*SXH, "sx AS (SELECT site AS st, time, event, xhat FROM sh)", *newton_sql("", "xhat", "efron", "sx")],
       f"SELECT 'xhat' AS term, {q.rnd(f'b{STEPS}.beta')} AS beta, {q.rnd(f'1e0/sqrt(b{STEPS}.info)')} AS se FROM b{STEPS}"))
def predictor_substitution(spark, d):
    return sv.cox(predicted(spark, d), ["xhat"], ["site"]).select("term", r("beta").alias("beta"), r("se").alias("se"))


def _route(name, ctes, beta, se):
    return "SELECT * FROM (" + q.select(ctes, f"SELECT '{name}' AS route, {q.rnd(beta)} AS beta, {q.rnd(se)} AS se FROM b{STEPS}") + ")"


ROUTES = [*SXH[:-1], "sx AS (SELECT 0 AS st, sv.time, sv.event, sv.x, sv.u, a0 + p0*sv.snp0 + p1*sv.snp1 AS xhat, sv.x - (a0 + p0*sv.snp0 + p1*sv.snp1) AS resid FROM sv JOIN fs USING (site))"]
SE2 = "sqrt(i22/(i11*i22-i12*i12))"


@query("hazard_routes_srv4", "SRV4", q.select(ROUTES, " UNION ALL ".join([
    _route("naive", newton_sql("", "x", "efron", "sx"), f"b{STEPS}.beta", "1e0/sqrt(info)"), _route("2SPS", newton_sql("", "xhat", "efron", "sx"), f"b{STEPS}.beta", "1e0/sqrt(info)"),
    _route("2SRI", newton2_sql("x", "resid", "sx"), "b1", SE2), _route("oracle", newton2_sql("x", "u", "sx"), "b1", SE2)])))
def hazard_routes(spark, d):
    return sv.route_comparison(predicted(spark, d)).select("route", r("beta").alias("beta"), r("se").alias("se"))


@query("hazard_control_function_cf1c", "CF1 SRV1", q.select([*SXH[:-1], "sx AS (SELECT site AS st, sv.time, sv.event, sv.x, sv.x - (a0 + p0*sv.snp0 + p1*sv.snp1) AS resid FROM sv JOIN fs USING (site))", *newton2_sql("x", "resid", "sx")],
       f"SELECT 'x' AS term, {q.rnd('b1')} AS beta, {q.rnd(SE2)} AS se FROM b{STEPS} UNION ALL SELECT 'resid', {q.rnd('b2')}, {q.rnd('sqrt(i11/(i11*i22-i12*i12))')} FROM b{STEPS}"))
def hazard_control_function(spark, d):
    return sv.cox(predicted(spark, d), ["x", "resid"], ["site"]).select("term", r("beta").alias("beta"), r("se").alias("se"))


@query("partial_likelihood_srv5", "SRV5", q.select([q.SURV, "t AS (SELECT site, time, sum(exp(0.1e0*x)) AS s0, sum(event) AS d, sum(event*0.1e0*x) AS dh FROM sv GROUP BY site, time)",
       "c AS (SELECT d, dh, sum(s0) OVER (PARTITION BY site ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS cs FROM t)"], f"SELECT {q.rnd('-(sum(dh) - sum(d*ln(cs)))/sum(d)')} AS loss, CAST(sum(d) AS BIGINT) AS events FROM c"))
def partial_likelihood(spark, d):
    s = fx.mr_surv(spark, d).withColumn("h", 0.1 * F.col("x"))
    return sv.partial_likelihood(s, "h", ["site"]).select(r("loss").alias("loss"), "events")


@query("partial_likelihood_wide_srv5b", "SRV5", q.select([q.SURV, "h AS (SELECT site, time, event, 400e0*(x - 5*u) AS h FROM sv)",
       "t AS (SELECT site, time, max(h) AS top, sum(event) AS d, sum(event*h) AS dh FROM h GROUP BY site, time)",
       "s AS (SELECT site, time, top, d, dh, sum(exp(h - top)) AS s FROM h JOIN t USING (site, time) GROUP BY ALL)",
       "m AS (SELECT a.site, a.time, max(b.top) AS m FROM t a JOIN t b ON a.site = b.site AND b.time >= a.time GROUP BY ALL)",
       "c AS (SELECT a.site, a.time, m, sum(b.s*exp(b.top - m)) AS cs FROM m a JOIN s b ON a.site = b.site AND b.time >= a.time GROUP BY ALL)"],
       f"SELECT {q.rnd('-(sum(dh) - sum(d*(m + ln(cs))))/sum(d)')} AS loss, CAST(sum(d) AS BIGINT) AS events FROM t JOIN c USING (site, time)"))
def partial_likelihood_wide(spark, d):
    s = fx.mr_surv(spark, d).withColumn("h", 400.0 * (F.col("x") - 5 * F.col("u")))
    return sv.partial_likelihood(s, "h", ["site"]).select(r("loss").alias("loss"), "events")


CPAIRS = """c AS (SELECT site, time, event, x, count(*) AS n FROM sv GROUP BY ALL),
p AS (SELECT a.site, sum(a.n*b.n) AS pairs, sum(CASE WHEN a.x > b.x THEN a.n*b.n WHEN a.x = b.x THEN a.n*b.n/2e0 ELSE 0e0 END) AS good
 FROM c a JOIN c b ON a.site = b.site AND a.event = 1 AND (b.time > a.time OR (b.time = a.time AND b.event = 0)) GROUP BY a.site)"""


@query("concordance_srv6", "SRV6", q.select([q.SURV, CPAIRS], f"SELECT site, CAST(pairs AS BIGINT) AS pairs, {q.rnd('good/pairs')} AS c_index FROM p"))
def concordance(spark, d):
    return sv.concordance(fx.mr_surv(spark, d), "x", ("site",)).select("site", F.col("pairs").cast("bigint").alias("pairs"), r("c_index").alias("c_index"))
