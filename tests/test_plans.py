"""Physical plans: what must and must not appear, and SQL twins on the small tables."""

import os

import pytest

import __spark_entry__ as entry
import checks.queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["bm25_topk", "bm25_topk_joined", "dense_topk", "dense_topk_blocked", "hybrid_search", "registry_latest", "sample_stratified"]
)
def test_ranking_is_limited_before_the_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, DATA))
    assert plan.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_plans_do_not_shuffle_the_corpus(spark):
    for name in ("bm25_topk", "knn_leave_one_out"):
        # The only exchange carries the k rows per query and task.
        assert plan_of(entry.queries()[name](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_pairs_stay_in_the_task_of_their_document(spark):
    plan = plan_of(entry.queries()["bm25_topk_joined"](spark, DATA))
    assert "Exchange hashpartitioning(doc_id" in plan and "hashpartitioning(doc_id, query_id" not in plan


def test_profile_reads_only_its_columns(spark):
    plan = plan_of(entry.queries()["corpus_profile"](spark, DATA))
    assert "text" not in plan.split("ReadSchema:")[1].split(">")[0]


def test_every_query_equals_its_sql(spark):
    import duckdb

    from checks.compare import TABLES, rows_of

    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    oracles, wrong = entry.oracle_sql(), []
    for name, build in checks.queries.QUERIES.items():
        df = build(spark, DATA)
        got = rows_of(df.columns, df.collect())
        if name not in oracles:
            assert got[1], name
            continue
        result = db.sql(oracles[name])
        if got != rows_of(result.columns, result.fetchall()):
            wrong.append(name)
    assert not wrong


def test_gather_reads_only_the_folders_of_winners(spark):
    assert "dynamicpruning" in plan_of(entry.queries()["gather_cases"](spark, DATA)).lower()


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "rrf_score", "source"]
