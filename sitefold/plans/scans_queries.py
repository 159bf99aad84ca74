"""Scans, role inference, manifests, logs and size tables."""

from pyspark.sql import functions as F

from sitefold.functions.scalars import r
from sitefold.operators import gwas as gw
from sitefold.plans import fixtures as fx
from sitefold.plans import sqlparts as q
from sitefold.plans.registry import query
from sitefold.runtime import scratch_path
from sitefold.sources import sites as src


@query("site_scan_src1", "SRC1", f"SELECT 'lineitem' AS site, count(*) AS n, {q.rnd('avg(l_quantity)')} AS mean_q, "
       f"{q.rnd('max(l_extendedprice)')} AS max_p FROM lineitem")
def site_scan(spark, d):
    df = src.scan_sites(spark, f"{d}/lineitem.parquet", suffix=".parquet")
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean_q"), r(F.max("l_extendedprice")).alias("max_p"))


@query("instrument_columns_src2", "SRC2", q.select([q.MR], f"""SELECT site, count(*) AS n, {q.rnd('avg(snp0)')} AS g0,
  {q.rnd('avg(snp1)')} AS g1, {q.rnd('avg(snp2)')} AS g2, 3 AS width FROM mr GROUP BY site"""))
def instrument_columns(spark, d):
    df = src.pack_instruments(fx.mr_rows(spark, d))
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(F.col("g")[j])).alias(f"g{j}") for j in range(3)],
                                  F.max(F.size("g")).alias("width"))


@query("covariate_selection_src3", "SRC3", q.select([q.MR], f"SELECT site, {q.rnd('avg(c1)')} AS mean_c1 FROM mr GROUP BY site"))
def covariate_selection(spark, d):
    df = src.select_covariates(fx.mr_rows(spark, d), ["c1"])
    return df.groupBy("site").agg(r(F.avg("`cov:c1`")).alias("mean_c1"))


@query("manifest_sites_src4", "SRC4", q.select([q.MR], f"""SELECT 'linear' AS shape, CAST(site AS VARCHAR) AS site_id, fold AS manifest,
  count(*) AS n, {q.rnd('regr_slope(y, x)')} AS avg_slope FROM mr GROUP BY site, fold"""))
def manifest_sites(spark, d):
    mr = fx.mr_rows(spark, d)
    rec = mr.groupBy("fold", "site").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("avg_slope"))
    doc = rec.groupBy("fold").agg(F.to_json(F.struct(
        F.lit("linear").alias("shape"), F.lit(False).alias("shared_snps"),
        F.collect_list(F.struct(F.col("site").cast("string").alias("site_id"), "n", "avg_slope")).alias("sites"))).alias("doc"))
    manifest = doc.select("fold", F.from_json("doc", src.MANIFEST).alias("m")).select("fold", "m.*")
    return src.explode_sites(manifest).select("shape", "site_id", F.col("fold").alias("manifest"), "n", r("avg_slope").alias("avg_slope"))


@query("truth_records_src5", "SRC5", q.select([q.MR], f"""SELECT site, {q.rnd('regr_slope(y, x)')} AS avg_slope,
  {q.rnd('corr(x, snp0)*corr(x, snp0)')} AS h2_x, {q.rnd('regr_slope(x, u)')} AS gamma_x, {q.rnd('regr_slope(y, u)')} AS gamma_y FROM mr GROUP BY site"""))
def truth_records(spark, d):
    c = F.corr("x", "snp0")
    doc = fx.mr_rows(spark, d).groupBy("site").agg(F.to_json(F.struct(
        F.regr_slope("y", "x").alias("avg_slope"), (c * c).alias("h2_x"), F.regr_slope("x", "u").alias("gamma_x"),
        F.regr_slope("y", "u").alias("gamma_y"))).alias("doc"))
    t = doc.select("site", F.from_json("doc", src.TRUTH).alias("t")).select("site", "t.*")
    return t.select("site", *[r(c).alias(c) for c in ("avg_slope", "h2_x", "gamma_x", "gamma_y")])


@query("site_sizes_src6", "SRC6", q.select([q.MR], """SELECT site, count(*) AS n,
  CAST(count(*) - ceil(count(*)*0.2e0) AS BIGINT) AS n_train FROM mr GROUP BY site"""))
def site_sizes(spark, d):
    return src.site_sizes(fx.mr_rows(spark, d))


@query("concatenated_logs_src7", "SRC7", q.select([q.MR], f"""SELECT fold AS round, site, {q.rnd('count(*)')} AS n, {q.rnd('avg(y)')} AS loss, NULL::DOUBLE AS kept FROM mr GROUP BY ALL
  UNION ALL SELECT fold, site, NULL, NULL, {q.rnd('avg(snp1)')} FROM mr GROUP BY fold, site"""))
def concatenated_logs(spark, d):
    g = fx.mr_rows(spark, d).groupBy(F.col("fold").alias("round"), "site")
    return src.concat_logs([g.agg(r(F.count(F.lit(1))).alias("n"), r(F.avg("y")).alias("loss")), g.agg(r(F.avg("snp1")).alias("kept"))])


CURVES = [q.MR, q.GRID61, """params AS (SELECT site, fold AS round, regr_slope(y, x) AS t1, regr_slope(y, snp0)/10e0 AS t2 FROM mr GROUP BY site, fold)""",
          "curves AS (SELECT site, round, k, x, t1*x + t2*x*x + t1/7e0 AS f FROM params, grid)"]


@query("curves_with_band_src8", "SRC8 SNK2", q.select(CURVES, """SELECT round, count(*) AS n_rows,
  CASE WHEN round = 4 THEN count(*) ELSE 0 END AS with_band FROM curves GROUP BY round"""))
def curves_with_band(spark, d):
    c = fx.curves(fx.mr_rows(spark, d))
    last = F.col("round") == 4
    out = c.select(F.col("site").cast("string").alias("site"), "round", "x", "f", F.when(last, F.col("f") - 1).alias("f_lo"),
                   F.when(last, F.col("f") + 1).alias("f_hi"))
    path = scratch_path(spark, "curves")
    src.write_table(out, path, "csv")
    back = src.read_curves(spark, path)
    return back.groupBy("round").agg(F.count(F.lit(1)).alias("n_rows"), F.count("f_lo").alias("with_band"))


@query("outcome_family_src9", "SRC9", "SELECT 'y' AS outcome, 'continuous' AS family UNION ALL SELECT 'yb', 'binary' UNION ALL SELECT 'time', 'survival'")
def outcome_family(spark, d):
    mr = fx.mr_rows(spark, d)
    return (src.detect_family(mr.select("y"), "y").select(F.lit("y").alias("outcome"), "family")
            .unionByName(src.detect_family(mr.select("yb"), "yb").select(F.lit("yb").alias("outcome"), "family"))
            .unionByName(src.detect_family(fx.mr_surv(spark, d)).select(F.lit("time").alias("outcome"), "family")))


GWAS_COLS = ["snp0", "snp1", "x", "y"]


def gwas_sql(snps=("snp0", "snp1"), src_name="mr") -> str:
    """CTE gw(site, snp, n, beta_x, se_x, beta_y, se_y) from regr_ aggregates."""
    parts = []
    for g in snps:
        se = {v: f"sqrt((regr_syy({v}, {g}) - regr_sxy({v}, {g})*regr_sxy({v}, {g})/regr_sxx({v}, {g}))/(count(*)-2)/regr_sxx({v}, {g}))" for v in "xy"}
        parts.append(f"SELECT site, '{g}' AS snp, count(*) AS n, regr_slope(x, {g}) AS beta_x, {se['x']} AS se_x, "
                     f"regr_slope(y, {g}) AS beta_y, {se['y']} AS se_y FROM {src_name} GROUP BY site")
    return "gw AS (" + " UNION ALL ".join(parts) + ")"


@query("summary_statistics_sink_snk1", "SNK1", q.select([q.MR, gwas_sql(("snp0", "snp1", "snp2"))], f"""SELECT site, snp, n, {q.rnd('beta_x')} AS beta_x, {q.rnd('se_x')} AS se_x,
  {q.rnd('beta_y')} AS beta_y, {q.rnd('se_y')} AS se_y FROM gw"""))
def summary_statistics_sink(spark, d):
    path = scratch_path(spark, "sumstats")
    src.write_summary_statistics(gw.gwas(fx.mr_rows(spark, d), ("snp0", "snp1", "snp2")), path)
    s = spark.read.parquet(path)
    return s.select(F.col("site").cast("int").alias("site"), "snp", "n", *[r(c).alias(c) for c in ("beta_x", "se_x", "beta_y", "se_y")])


@query("result_sinks_snk2", "SNK2 AGG17 AGG19", q.select([q.MR, "k AS (SELECT 'site' || site AS axis, fold AS level, regr_slope(y, x) AS est, count(*) AS n, avg((y - 0.9e0*x)*(y - 0.9e0*x)) AS mse FROM mr GROUP BY site, fold)"],
       f"""SELECT 'comparison' AS sink, axis, level, {q.rnd('est')} AS est, NULL::DOUBLE AS mse, n FROM k
 UNION ALL SELECT 'metrics', axis, level, NULL, {q.rnd('mse')}, n FROM k UNION ALL SELECT 'sweep', axis, level, {q.rnd('est')}, {q.rnd('mse')}, n FROM k"""))
def result_sinks(spark, d):
    """Comparison, metric and sweep tables written as Parquet, CSV and partitioned Parquet, and read back."""
    k = fx.mr_rows(spark, d).groupBy(F.concat(F.lit("site"), F.col("site").cast("string")).alias("axis"), F.col("fold").alias("level")).agg(
        r(F.regr_slope("y", "x")).alias("est"), r(F.avg((F.col("y") - 0.9 * F.col("x")) * (F.col("y") - 0.9 * F.col("x")))).alias("mse"), F.count(F.lit(1)).alias("n"))
    out = None
    for sink, fmt, cols, parts in (("comparison", "parquet", ("est",), ()), ("metrics", "csv", ("mse",), ()), ("sweep", "parquet", ("est", "mse"), ("axis",))):
        table, path = k.select("axis", "level", *cols, "n"), scratch_path(spark, sink)
        src.write_table(table, path, fmt, parts)
        back = spark.read.schema(table.schema).format(fmt).option("header", True).load(path)
        back = back.select(F.lit(sink).alias("sink"), "axis", "level", *[(F.col(c) if c in cols else F.lit(None).cast("double")).alias(c) for c in ("est", "mse")], "n")
        out = back if out is None else out.unionByName(back)
    return out
