"""Analysis views over the benchmark tables. Each is a plain projection, so filters and column
pruning reach the parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNPS = ("snp0", "snp1")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mr_rows(spark: SparkSession, d: str) -> DataFrame:
    """Site rows: five sites, three dosage columns, an exposure and an outcome."""
    q, pk = F.col("l_quantity"), F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_suppkey") % 5).cast("int").alias("site"),
        ((F.col("l_orderkey") * 7 + pk * 3 + F.col("l_linenumber")) % 5).cast("int").alias("fold"),
        F.when(q <= 16, 0).when(q <= 33, 1).otherwise(2).alias("snp0"),
        (pk % 3).cast("int").alias("snp1"), (F.col("l_linenumber") % 3).cast("int").alias("snp2"),
        (q / 10.0 + F.lit(0.2) * (pk % 3)).alias("x"),
        (F.col("l_extendedprice") / 10000.0 + F.lit(0.03) * q).alias("y"),
        F.col("l_discount").alias("c1"), F.col("l_tax").alias("u"),
        (F.col("l_returnflag") == "R").cast("int").alias("yb"))


def mr_surv(spark: SparkSession, d: str) -> DataFrame:
    """Follow-up times in days from order to shipment; late shipments are the events."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.datediff("l_shipdate", "o_orderdate")
    q, pk = F.col("l_quantity"), F.col("l_partkey")
    return rows.select(
        (F.col("l_suppkey") % 5).cast("int").alias("site"),
        F.when(q <= 16, 0).when(q <= 33, 1).otherwise(2).alias("snp0"), (pk % 3).cast("int").alias("snp1"),
        (F.col("l_linenumber") % 3).cast("int").alias("snp2"), (q / 10.0 + F.lit(0.2) * (pk % 3)).alias("x"),
        F.col("l_tax").alias("u"), (F.abs(gap) + 1).cast("double").alias("time"), (gap > 0).cast("int").alias("event"))


def local_rows(mr: DataFrame, snps=SNPS) -> DataFrame:
    """Rows with each site's predicted exposure, its square and the first-stage residual."""
    from sitefold.operators import iv
    from sitefold.operators import moments as mo
    from sitefold.runtime import cut

    fs = cut(iv.local_first_stage(mo.moments(mr, [*snps, "x"]), snps))
    return iv.with_squares(iv.predict_rows(mr, fs, snps, ("site",))).withColumn("resid", F.col("x") - F.col("xhat"))


def updates(spark: SparkSession, d: str) -> DataFrame:
    """One update vector per (round, label): coordinate means over vectors of any width, weight = rows behind it."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("round"), F.col("label").alias("site"), "embedding")
    cells = e.select("round", "site", F.posexplode("embedding").alias("j", "v")).groupBy("round", "site", "j").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vectors = cells.groupBy("round", "site").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("p"))
    weights = e.groupBy("round", "site").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return vectors.join(weights, ["round", "site"]).select("round", "site", F.transform("p", lambda c: c["v"]).alias("vec"), "weight")


def curve_params(mr: DataFrame) -> DataFrame:
    """Per (site, round) slope of y on x and a small curvature, standing in for a trained model."""
    return mr.groupBy("site", F.col("fold").alias("round")).agg(
        F.regr_slope("y", "x").alias("t1"), (F.regr_slope("y", "snp0") / 10.0).alias("t2"))


def curves(mr: DataFrame) -> DataFrame:
    from sitefold.operators.curves import with_grid

    x = F.col("x")
    return with_grid(curve_params(mr)).select("site", "round", "k", "x", (F.col("t1") * x + F.col("t2") * x * x + F.col("t1") / 7.0).alias("f"))


def replicates(mr: DataFrame, n: int = 200) -> DataFrame:
    """Slope per replicate group: a fixed number of groups whatever the table size."""
    rep = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber")) % n).cast("int")
    return mr.groupBy(rep.alias("rep")).agg(F.regr_slope("y", "x").alias("theta_1"), (F.regr_slope("y", "snp0") / 10.0).alias("theta_2"))
