"""What Catalyst makes of the queries: pruning, pushdown, partial aggregation, join choice."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import aggregates, joins, layout, scan, sorting


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lineitem(spark, sf):
    return scan.parquet(spark, sf, "lineitem")


def test_scan_prunes_columns_and_pushes_filters(lineitem):
    p = plan(scan.scan(lineitem, ["l_orderkey"], F.col("l_quantity") > 40))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p and "GreaterThan(l_quantity,40.0)" in p and "Batched: true" in p


def test_aggregates_are_partial_before_the_shuffle(lineitem):
    p = plan(aggregates.group(lineitem, ["l_returnflag"], F.sum("l_quantity").alias("q")))
    assert p.count("HashAggregate") == 2 and "partial_sum" in p
    p = plan(aggregates.cube(lineitem, ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
    assert "Expand" in p and "partial_count" in p


def test_small_sides_are_broadcast_and_top_k_does_not_sort_all(spark, sf, lineitem):
    nation, supplier = scan.parquet(spark, sf, "nation"), scan.parquet(spark, sf, "supplier")
    assert "BroadcastHashJoin" in plan(joins.join(supplier, nation, F.col("s_nationkey") == F.col("n_nationkey")))
    assert "SortMergeJoin" in plan(joins.join(supplier, nation, F.col("s_nationkey") == F.col("n_nationkey"), strategy="merge"))
    assert "TakeOrderedAndProject" in plan(sorting.top(lineitem, 5, sorting.key("l_orderkey")))
    a, b = scan.parquet(spark, sf, "nation").select("n_name"), scan.parquet(spark, sf, "region").select("r_name")
    assert "Join" not in plan(joins.union_join(a, b))


def test_index_lookup_is_pushed_down(spark, lineitem, tmp_path):
    index = layout.create(lineitem, layout.Index("i", "lineitem", (layout.Key("l_orderkey"),), "hash", False, str(tmp_path / "i")))
    assert "EqualTo(l_orderkey,7)" in plan(layout.lookup(spark, index, l_orderkey=7))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_orderkey", "revenue", "o_orderdate"] and df.count() == 10
