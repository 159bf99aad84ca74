"""Steps whose work must grow no faster than the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.operators import iv
from sitefold.operators import moments as mo
from sitefold.plans import all_queries
from sitefold.sources import sites as src


def test_wide_arrays_are_made_once_a_row(spark):
    df = spark.range(40, numPartitions=3).select((F.col("id") % 2).alias("site"), F.array(*[F.when(F.col("id") != 7, (F.col("id") * (k + 1) % 11).cast("double")) if k == 3 else (F.col("id") * (k + 1) % 11).cast("double") for k in range(70)]).alias("v"))
    tiles = mo.moment_tiles(df, [], array="v", width=70)
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "transform(" not in plan and plan.count("Filter") == 0
    cells = {(r.site, r.a, r.b): r for r in mo.moment_cells(tiles, [str(k) for k in range(70)]).collect()}
    rows = [(r.site, np.array(r.v)) for r in df.collect() if None not in r.v]
    for site in (0, 1):
        v = np.array([x for s, x in rows if s == site])
        r = cells[site, "3", "69"]
        assert r.n == len(v)
        np.testing.assert_allclose(r.sxy, ((v[:, 3] - v[:, 3].mean()) * (v[:, 69] - v[:, 69].mean())).sum(), rtol=1e-9)


@pytest.mark.parametrize("folder, suffix, want", [("site01.csv", ".csv/", "site01"), ("a.csv.csv", ".csv/", "a.csv"), (".csv", ".csv/", ""), ("plain", ".csv/", "")])
def test_site_names_are_cut_without_a_pattern(spark, tmp_path, folder, suffix, want):
    path = f"{tmp_path}/{folder}"
    spark.range(2).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path).select(src.site_name(suffix).alias("site"))
    assert {r.site for r in df.collect()} == {want}
    assert "substring_index" in df._jdf.queryExecution().analyzed().toString()


def test_site_files_are_written_in_one_pass_a_set(spark, monkeypatch):
    calls, scans = [], []
    write, scan = src.write_table, iv.from_manifest
    monkeypatch.setattr(src, "write_table", lambda *a, **k: (calls.append(a), write(*a, **k))[1])
    monkeypatch.setattr(iv, "from_manifest", lambda *a, **k: (scans.append(len(a) > 3 or "sites" in k), scan(*a, **k))[1])
    out = all_queries()["site_files_iv11b"].run(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 2 and scans == [True, True] and sorted(r.protocol for r in out) == ["shared", "site"] and {r.sites for r in out} == {5}
