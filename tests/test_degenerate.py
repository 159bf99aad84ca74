"""Sites where something does not vary: the cell has no estimate and the rest of the job goes on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.operators import gwas, metrics
from sitefold.plans import fixtures as fx
from sitefold.runtime import cells


def test_constant_columns_at_one_site(spark):
    rows = [(s, float(i % 3), 0.5 * (i % 3) + 0.1 * i, float(i)) for s in (0, 1) for i in range(12)] + [(2, 1.0, 0.5 * i, float(i)) for i in range(12)] + [(3, float(i), float(i), 2.0) for i in range(2)]
    df = spark.createDataFrame(rows, "site int, snp0 double, x double, y double")
    got = {r["site"]: r for r in gwas.gwas(df, ["snp0"]).collect()}
    assert got[2]["beta_x"] is None and got[2]["se_y"] is None and got[0]["beta_x"] is not None and got[3]["se_x"] is None
    packed = {r["site"]: r for r in gwas.gwas_long(df.withColumn("g", F.array("snp0"))).collect()}
    assert packed[2]["beta_x"] is None and abs(packed[0]["beta_x"] - got[0]["beta_x"]) < 1e-12
    combined = {r["site"]: r["ivw"] for r in gwas.ivw(gwas.gwas(df, ["snp0"])).collect()}
    assert combined[2] is None and combined[0] is not None
    assert {r["site"]: r["naive"] for r in gwas.naive_slope(df.withColumn("x", F.when(F.col("site") == 2, 1.0).otherwise(F.col("x")))).collect()}[2] is None
    assert metrics.regression(df.filter("site = 3"), "x", "y").first()["r2"] is None


def test_updates_of_any_width_and_what_counts_for_a_broadcast(spark, tmp_path):
    wide = [(i, [float(i + j) for j in range(70)], i % 2) for i in range(12)]
    spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = fx.updates(spark, str(tmp_path)).collect()
    assert {len(r["vec"]) for r in got} == {70} and all(abs(r["vec"][69] - r["vec"][0] - 69) < 1e-9 for r in got)
    assert cells(spark.createDataFrame([(1, [1.0] * 500), (2, [1.0])], "k int, v array<double>")) == 503


def test_one_rule_for_nulls_in_every_kernel(spark):
    """A row without a value in one of the columns counts nowhere: expressions, shifted sums, tiles, arrays and a stream agree."""
    from sitefold.operators import moments as mo

    rng = np.random.default_rng(2)
    v = pd.DataFrame(rng.normal(size=(60, 9)).round(3), columns=[f"c{k}" for k in range(9)])
    v["site"] = np.arange(60) % 3
    holes = v.mask(pd.DataFrame(rng.random((60, 10)) < 0.04, columns=v.columns) & (v.columns != "site"))
    names = [f"c{k}" for k in range(9)]
    df = spark.createDataFrame(holes).select(F.col("site").cast("int").alias("site"), *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in names])
    df = df.unionByName(df.limit(1).select(F.lit(9).alias("site"), *[F.lit(None).cast("double").alias(c) for c in names]))
    want = {s: (len(p), p[names].mean().to_numpy(), np.cov(p[names].T, ddof=0) * len(p)) for s, p in holes.dropna().groupby("site")}

    def same(table):
        got = {r["site"]: r for r in table.collect()}
        assert set(got) == set(want)
        for s, (n, mean, m2) in want.items():
            assert got[s]["n"] == n
            np.testing.assert_allclose([got[s][f"m_{c}"] for c in names], mean, rtol=1e-12)
            np.testing.assert_allclose([[got[s][mo.s_name(a, b)] for a in names] for b in names], m2, rtol=1e-10, atol=1e-12)

    same(mo.moments(df, names))
    same(mo.moments(df, names, origin={c: 0.3 for c in names}))
    same(mo.moments_blocked(df.repartition(7), names))
    packed = mo.moments_arrays(df.withColumn("g", F.array(*names[:7])).repartition(5), names[7:], array="g", width=7)
    for r in packed.collect():
        np.testing.assert_allclose(r["m2"], want[r["site"]][2][np.triu_indices(9)], rtol=1e-10, atol=1e-12)


def test_tiles_of_several_hundred_columns(spark, monkeypatch):
    from sitefold.operators import moments as mo

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 150)) + 1e5
    df = spark.createDataFrame([(int(i % 2), v.tolist()) for i, v in enumerate(x)], "site int, v array<double>").repartition(6)
    got = mo.moment_cells(mo.moment_tiles(df, [], array="v", width=150), [str(k) for k in range(150)]).toPandas()
    assert len(got) == 2 * 150 * 151 // 2
    for s in (0, 1):
        want = np.cov(x[s::2].T, ddof=0) * 45
        part = got[got.site == s]
        np.testing.assert_allclose(part.sxy, want[part.a.astype(int), part.b.astype(int)], rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(part.mean_a, x[s::2].mean(0)[part.a.astype(int)], rtol=1e-13)
    with pytest.raises(Exception, match="numbers in every row"):
        mo.moment_tiles(df, [], array="v", width=151).collect()
    assert mo.moment_tiles(df.limit(0), [], array="v", width=150).collect() == []


def test_packed_regressions_with_missing_dosages(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), [None if rng.random() < 0.1 else float(rng.integers(0, 3)) for _ in range(600 if i % 5 else 590)], float(rng.normal()), None if i == 7 else float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "site int, g array<double>, x double, y double").repartition(5)
    got = {(r["site"], r["snp"]): r for r in gwas.gwas_long(df).collect()}
    wide = df.select("site", "x", "y", *[F.get("g", F.lit(k)).alias(f"snp{k}") for k in (0, 3, 595)])
    for r in gwas.gwas(wide, ["snp0", "snp3", "snp595"]).collect():
        other = got[r["site"], r["snp"]]
        assert r["n"] == other["n"] and all(abs(r[c] - other[c]) < 1e-12 for c in ("beta_x", "se_x", "beta_y", "se_y"))
    assert len(got) == 1200 and got[0, "snp595"]["n"] < got[0, "snp0"]["n"]
