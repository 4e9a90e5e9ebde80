"""Registered queries of the package against their SQL on the smallest tables."""

import duckdb
import pytest

from lumenlake.llm.queries import QUERIES, SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_all_queries():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = database.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", ["op2_licences", "op3_mixing"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_pipeline_keeps_what_its_stages_keep(spark):
    out = QUERIES["pipeline"](spark, SF)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = out.collect()
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= documents.keys()
    assert all(set(r.text.split()) <= set(documents[r.doc_id].text.split()) for r in rows)
