"""A few catalogued queries against DuckDB on the smallest driver tables (all of them: tools/check.py)."""

import os

import pytest

import __spark_entry__ as entry
from pitbars.plans import catalog
from tools.check import rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["tick_bars", "rollup_anchored", "regime_breaks", "zone_touches", "bootstrap_ci"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_every_query_has_a_statement_and_a_spec():
    assert set(catalog.CATALOG) <= set(entry.oracle_sql()) and set(catalog.CATALOG) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    mine = entry.queries()[name](spark, SF)
    assert "NestedLoop" not in mine._jdf.queryExecution().executedPlan().toString()
    assert rows(mine.toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
