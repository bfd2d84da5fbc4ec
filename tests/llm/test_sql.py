"""Registered operator queries against their SQL, on the small tables."""

import os

import pytest

from checks.compare import TABLES, rows_of
from msgscreen.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    result = db.sql(oracles.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(result.columns, result.fetchall())


def test_native_plans_run_no_python(spark):
    for name in ("op2_url_rules", "op8_secrets"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name
