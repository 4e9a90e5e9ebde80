import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlake.operators import paging
from lumenlake.plans.ordering import ordered_totals, row_numbers


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Keep small partitions apart, so that offsets between slices matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_of_a_huge_group_match_a_window(spark):
    df = spark.range(3000).selectExpr(
        "id", "case when id % 3 <> 0 then 'hot' when id % 5 > 0 then cast(id % 50 as string) end as g", "(id * 7919) % 101 as v"
    )
    order = [F.col("v").desc(), F.col("id").asc()]
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = row_numbers(df, order, "n", ["g"])
    assert {(r.id, r.n) for r in got.collect()} == {(r.id, r.n) for r in expected.collect()}
    running = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered_totals(df, order, {"s": F.col("v")}, ["g"])
    expected = df.withColumn("s", F.sum("v").over(running))
    assert {(r.id, r.s) for r in sums.collect()} == {(r.id, r.s) for r in expected.collect()}
    # The hot group is spread over several slices.
    ranged = df.repartitionByRange(F.col("g"), *order).withColumn("slice", F.spark_partition_id())
    hot = ranged.groupBy("g").agg(F.count_distinct("slice").alias("slices")).where("g = 'hot'").first()
    assert hot.slices > 1


def test_export_pages_number_the_whole_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as v")
    pages = paging.export_pages(df, [F.col("v").asc(), F.col("id").desc()], 60).collect()
    ordered = sorted(range(1000), key=lambda i: (i % 7, -i))
    assert {(r.id, r.position, r.page) for r in pages} == {(i, n + 1, n // 60 + 1) for n, i in enumerate(ordered)}


def test_target_keeps_the_smallest_prefix(spark):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 7), ("d", 9)], "id string, file_size bigint")
    order = [F.coalesce("file_size", F.lit(-1)).desc(), F.col("id").desc()]
    kept = paging.recoverable_target(df, order, 10)
    assert {(r.id, r.running_bytes) for r in kept.collect()} == {("d", 9), ("c", 16)}
    assert paging.recoverable_target(df, order, 1000).count() == 4
