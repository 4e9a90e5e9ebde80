"""Every registered query against its SQL on the smallest tables, and what the plans must not contain."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from checks import model as M  # noqa: E402
from checks import q_search, register  # noqa: E402
from lumenlake.operators import specs  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = register.QUERIES, register.SQL


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return connection


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_without_cross_joins(spark, db, name):
    df = QUERIES[name](spark, SF)
    text = plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(SQL[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_all_are_registered():
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).columns == ["duplicate_copies", "duplicate_bytes"]


@pytest.mark.parametrize("spec", [q_search.AND, q_search.OR, q_search.NOT, q_search.NESTED])
def test_spec_plans_have_no_python_and_no_nested_loops(spark, spec):
    text = plan(specs.apply_spec(M.catalog(spark, SF, clusters=True), spec))
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    from lumenlake.sources.listing import read_assets

    M.assets(spark, SF).write.parquet(str(tmp_path / "assets"))
    text = plan(read_assets(spark, str(tmp_path / "assets"), "videos", before=q_search.MIDDLE).select("id"))
    assert "EqualTo(media_type,video)" in text and "LessThan(created_at" in text
    assert "file_size" not in text


def test_bucketed_tables_join_without_a_shuffle(spark):
    from lumenlake.operators.insights import enrich
    from lumenlake.sources.tables import save_bucketed

    built = {"assets": M.assets, "quality": M.quality, "content": M.content}
    for name, build in built.items():
        save_bucketed(build(spark, SF), f"bucketed_{name}", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich(*[spark.table(f"bucketed_{name}") for name in built])
        assert "Exchange" not in plan(joined)
        assert joined.count() == M.assets(spark, SF).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounded_windows_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["refinement_log"](spark, SF))


def test_savings_and_merges_combine_before_the_shuffle(spark):
    for name in ("duplicate_savings", "latest_by_key", "merge_quality", "mean_pool"):
        assert "partial_" in plan(QUERIES[name](spark, SF))
