import re

import duckdb
import pytest

import __spark_entry__ as entry
from sitefold.plans import all_queries

SF = "/root/testdata/sf0.001"


def test_every_query_names_its_survey_rows_and_oracles_are_queries():
    qs = all_queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, q in qs.items():
        assert re.fullmatch(r"[a-z0-9_]+", name) and q.rows
        assert not re.search(r"(^|_)op\d", name) and "pipeline" not in name
        assert q.sql is None or not re.search(r"\bUSING SAMPLE\b", q.sql, re.I)


@pytest.mark.parametrize("name", ["gwas_agg1", "manifest_sites_src4", "local_crossfit_iv10", "risk_sets_win5", "trimmed_mean_agr3", "percentile_band_agg22"])
def test_a_sample_of_oracles_at_the_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "embeddings", "nation", "part", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a = entry.queries()[name](spark, SF).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert sorted(map(str, a[cols].values.tolist())) == sorted(map(str, b[cols].values.tolist()))


def test_entry(spark):
    rows = {r["estimator"]: r for r in entry.entry(spark).collect()}
    assert len(rows) == 6 and rows["local first stages"]["abs_diff_from_pooled"] == 0.0
