import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.operators import moments as mo
from sitefold.sources import sites as src
from sitefold.streaming import moments as sm
from sitefold.streaming import rounds as rd


def test_site_files_manifest_and_truth(spark, tmp_path):
    folder = tmp_path / "quadratic_set"
    folder.mkdir()
    for s, n in (("site01", 3), ("site02", 5)):
        pd.DataFrame({"id": range(n), "snp0": 1, "snp1": 2, "U": 0.5, "X": 1.5, "Y": 2.5}).to_csv(folder / f"{s}.csv", index=False)
        (folder / f"{s}.truth.json").write_text(json.dumps({"avg_slope": 0.3, "maf": [0.1, 0.2], "theta1": 0.3}, indent=1))
    (folder / "manifest.json").write_text(json.dumps({"theta1": 0.3, "theta2": 0.15, "sites": [
        {"site_id": "site01", "n": 3, "avg_slope": 0.3}, {"site_id": "site02", "n": 5, "avg_slope": 0.2}]}, indent=1))
    df = src.scan_sites(spark, str(folder / "site*.csv"), "csv", src.site_schema(2))
    assert {r["site"]: r["count"] for r in df.groupBy("site").count().collect()} == {"site01": 3, "site02": 5}
    assert src.instrument_columns(df) == ["snp0", "snp1"]
    assert src.infer_roles(df.columns)["U"] == "oracle"
    assert src.pack_instruments(df).first()["g"] == [1.0, 2.0]
    m = src.read_manifest(spark, str(folder / "manifest.json"))
    assert m.first()["shape"] == "quadratic"
    assert src.explode_sites(m).agg(F.sum("n")).first()[0] == 8
    t = {r["site"]: r for r in src.read_truth(spark, str(folder / "*.truth.json")).collect()}
    assert t["site02"]["avg_slope"] == 0.3 and t["site01"]["theta2"] is None


def test_families_and_missing_values(spark):
    surv = spark.createDataFrame([(1.0, 1)], "time double, event int")
    assert src.detect_family(surv).first()["family"] == "survival"
    df = spark.createDataFrame([(0.0,), (1.0,)], "y double")
    assert src.detect_family(df).first()["family"] == "binary"
    assert src.detect_family(df.withColumn("y", F.col("y") * 2)).first()["family"] == "continuous"
    with pytest.raises(ValueError, match="outcome"):
        src.detect_family(df.withColumnRenamed("y", "z"))
    assert src.nan_to_null(spark.createDataFrame([(float("nan"),)], "a double")).first()["a"] is None


def test_stream_totals_equal_batch_whatever_the_file_split(spark, mr, tmp_path):
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = mr.select("site", "x", "y")
    rows.repartition(6).write.parquet(inp)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(inp)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    sm.run_available(sm.running_moments(stream, ["x", "y"]), keep, str(tmp_path / "cp"))
    a = spark.read.parquet(out).orderBy("site").toPandas()
    b = mo.moments(rows, ["x", "y"]).orderBy("site").toPandas()
    assert (a.n == b.n).all() and abs(a.s_x__y - b.s_x__y).max() < 1e-7
    assert abs(sm.combined_slope(spark.read.parquet(out)).first()["slope"] - (b.s_x__y.sum() / b.s_x__x.sum())) < 1e-10


@pytest.mark.parametrize("packed", [False, True])
def test_streams_of_many_columns_over_several_triggers(spark, tmp_path, packed):
    """Nine columns by expressions and any number by state, with missing values, equal to the batch."""
    rng = np.random.default_rng(3)
    names = [f"c{k}" for k in range(9)]
    rows = spark.createDataFrame([(int(i % 3), *(None if rng.random() < 0.02 else float(v) for v in rng.normal(size=9) + 50)) for i in range(200)], "site int, " + ", ".join(f"{c} double" for c in names))
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(6).write.parquet(inp)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(inp)
    want = {r["site"]: r for r in mo.moments(rows, names).collect()}
    if not packed:
        sm.run_available(sm.running_moments(stream, names), lambda b, _: b.write.mode("overwrite").parquet(out), str(tmp_path / "cp"))
        got = {r["site"]: (r["n"], [[r[mo.s_name(a, b)] for a in names] for b in names]) for r in spark.read.parquet(out).collect()}
    else:
        running = sm.running_moment_arrays(stream.withColumn("g", F.array(*names[:6])), names[6:], array="g", width=6)
        sm.run_available(running, lambda b, e: b.withColumn("epoch", F.lit(e)).write.mode("append").parquet(out), str(tmp_path / "cp"), "update")
        seen = spark.read.parquet(out).orderBy("epoch").collect()
        assert len({r["epoch"] for r in seen}) == 3
        got = {r["site"]: (r["n"], np.reshape(r["m2"], (9, 9))) for r in seen}
    for site, r in want.items():
        assert got[site][0] == r["n"]
        np.testing.assert_allclose(got[site][1], [[r[mo.s_name(a, b)] for a in names] for b in names], rtol=1e-9, atol=1e-9)


def test_the_manifest_decides_and_must_match_the_files(spark, tmp_path):
    from sitefold.operators import iv

    rng = np.random.default_rng(1)
    sets = {}
    for name in ("site01", "site02"):
        g = rng.integers(0, 3, (40, 2))
        x = g @ [0.5, 0.3] + rng.normal(size=40)
        pd.DataFrame({"snp0": g[:, 0], "snp1": g[:, 1], "x": x, "y": 0.4 * x + rng.normal(size=40)}).to_csv(tmp_path / f"{name}.csv", index=False)
    for shared in (True, False, None):
        doc = {"sites": [{"site_id": "site01"}, {"site_id": "site02"}]} | ({} if shared is None else {"shared_snps": shared})
        (tmp_path / f"m{shared}.json").write_text(json.dumps(doc))
        df = src.scan_sites(spark, str(tmp_path / "site*.csv"), "csv", "snp0 int, snp1 int, x double, y double")
        run = iv.from_manifest(src.read_manifest(spark, str(tmp_path / f"m{shared}.json")), df, ["snp0", "snp1"], robust=False)
        sets[shared] = (run.design.instruments, run.estimates().first()["theta"])
    assert sets[True][0] == ("snp0", "snp1") and sets[False][0] == ("xhat",) and sets[None] == sets[False]
    (tmp_path / "other.json").write_text(json.dumps({"sites": [{"site_id": "site01"}, {"site_id": "site09"}]}))
    with pytest.raises(ValueError, match="site09.*site02"):
        iv.from_manifest(src.read_manifest(spark, str(tmp_path / "other.json")), df, ["snp0", "snp1"])


def _messages(spark, path, rows, name):
    spark.createDataFrame(rows, "round int, site string, seq bigint, weight double, vec array<double>").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("round int, site string, seq bigint, weight double, vec array<double>").option("maxFilesPerTrigger", 1).parquet(path)


def test_round_barrier_waits_for_every_site(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _messages(spark, path, [(0, "a", 1, 1.0, [1.0]), (0, "b", 1, 3.0, [5.0]), (1, "a", 1, 1.0, [7.0]), (0, "x", 1, 1.0, [9.0])], "m")
    stream = _messages(spark, path, [(0, "b", 2, 3.0, [2.0])], "m")
    q = rd.round_barrier(stream, ["a", "b"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {r["missing"] for r in got if r["status"] == "rejected"} == {"x"}
    done = [r for r in got if r["status"] == "complete"]
    assert [r["round"] for r in done] == [0] and done[0]["weight"] == 4.0
    assert done[0]["vec"] in ([1.75], [4.0])


def test_incomplete_round_names_the_missing_site(spark, tmp_path):
    import time

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = _messages(spark, path, [(4, "a", 1, 1.0, [1.0])], "m")
    q = (rd.round_barrier(stream, ["a", "b"], timeout="500").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(processingTime="300 milliseconds").start(out))
    for _ in range(100):
        time.sleep(0.4)
        got = spark.read.parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() and q.lastProgress else []
        if got:
            break
    q.stop()
    assert [(r["round"], r["status"], r["missing"]) for r in got] == [(4, "incomplete", "b")]
