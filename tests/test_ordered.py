import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sitefold.operators import ordered as od


def test_running_totals_with_one_hot_group(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": np.where(rng.random(5000) < 0.8, "hot", rng.choice(list("abc"), 5000)), "t": rng.integers(0, 700, 5000), "v": rng.random(5000)})
    df = spark.createDataFrame(p)
    for desc in (False, True):
        got = od.running_totals(df, ["g"], "t", ["v"], descending=desc).toPandas().sort_values(["g", "t"])
        want = p.groupby(["g", "t"]).v.sum().reset_index().sort_values(["g", "t"], ascending=[True, not desc])
        want["cum_v"] = want.groupby("g").v.cumsum()
        want = want.sort_values(["g", "t"])
        np.testing.assert_allclose(got.cum_v.to_numpy(), want.cum_v.to_numpy())
    buckets = od.with_buckets(df.groupBy("g", "t").agg(F.sum("v").alias("v")), ["g"], "t")
    assert buckets.filter("g = 'hot'").select("_bucket").distinct().count() > 1


def test_quantiles_match_numpy(spark, mr, pdf):
    got = od.exact_quantiles(mr, "y", {"a": 0.025, "b": 0.5, "c": 0.9}).first()
    np.testing.assert_allclose([got["a"], got["b"], got["c"]], np.quantile(pdf.y, [0.025, 0.5, 0.9]), rtol=1e-12)


def test_split_sizes_are_exact_and_repeatable(mr):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"]
    a = od.train_test_split(mr, 0.2, ["site"], ["yb"], ids, 1)
    s = a.groupBy("site", "yb").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).toPandas()
    assert (s.t == np.ceil(s.n * 0.2)).all()
    b = od.train_test_split(mr.repartition(5), 0.2, ["site"], ["yb"], ids, 1)
    assert a.filter("is_test").select(*ids).exceptAll(b.filter("is_test").select(*ids)).count() == 0
    f = od.fold_ids(mr.drop("fold"), 5, ["site"], ids, 2).groupBy("site", "fold").count().toPandas()
    assert f.groupby("site")["count"].agg(lambda v: v.max() - v.min()).max() <= 1


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 12, 300) / 4.0, rng.integers(0, 2, 300)
    d = s[y == 1][:, None] - s[y == 0][None, :]
    want = ((d > 0) + 0.5 * (d == 0)).mean()
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    assert abs(od.auc(df, "s", "y").first()["auc"] - want) < 1e-12
    assert od.auc(df.withColumn("y", F.lit(1)), "s", "y").first()["auc"] is None
