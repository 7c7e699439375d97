"""Plans that must stay as they are meant: what is pushed down, what is shuffled, what runs in Python."""

import os

import pytest
from pyspark.sql import functions as F

from weirflow.functions import aggregates as A
from weirflow.operators import joins as J
from weirflow.operators import ordering as O
from weirflow.operators import windows as W
from weirflow.plans.inspect import operators, scan_facts
from weirflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_filters_and_columns_reach_the_scan(spark):
    pushed, read = scan_facts(QUERIES["where_select"](spark, SF))
    assert any("GreaterThan(l_quantity" in p for p in pushed) and any("EqualTo(l_returnflag" in p for p in pushed)
    assert sorted(read) == ["l_linenumber", "l_orderkey", "l_quantity", "l_returnflag"]
    assert not operators(QUERIES["where_select"](spark, SF))


def test_grouping_sums_before_its_one_shuffle(spark):
    got = operators(A.group_by(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_returnflag"], A.sum_field("s", "l_tax"), A.avg_field("a", "l_tax"), A.count_field("n")))
    assert got["HashAggregate"] == 2 and got["Exchange"] == 1


def test_top_k_does_not_sort_all(spark):
    got = operators(O.top_k(spark.read.parquet(f"{SF}/orders.parquet"), 5, "o_totalprice", "o_orderkey"))
    assert got["TakeOrderedAndProject"] == 1 and not got["Sort"] and not got["Exchange"]


def test_small_side_is_broadcast_only_if_counted_small(spark):
    l, r = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey"), spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert operators(J.inner_join(l, r, "l_orderkey", "o_orderkey", small_right_rows=10))["SortMergeJoin"] == 1
        assert operators(J.inner_join(l, r, "l_orderkey", "o_orderkey", small_right_rows=10_000_000))["BroadcastHashJoin"] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["group_by_stats", "full_join", "sliding_event_time", "session_event_time", "count_window", "value_change_trigger", "running_stats", "activity_sessions"])
def test_no_python_in_relational_plans(spark, name):
    got = operators(QUERIES[name](spark, SF))
    assert not {"MapInArrow", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"} & set(got)


def test_global_row_numbers_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 500)
    o = O.Ordered(spark.range(0, 5000, 1, 3), [F.col("id")])
    blocks = o.rows.groupBy(O.BLOCK).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(O.BLOCK).collect()
    assert len(blocks) > 5 and max(b.n for b in blocks) < 1500 and all(a.hi < b.lo for a, b in zip(blocks, blocks[1:], strict=False))
    df = O.with_row_number(spark.range(0, 5000, 1, 3), "id")
    assert df.agg(F.min("row_number"), F.max("row_number"), F.countDistinct("row_number")).head() == (1, 5000, 5000)


def test_the_order_writes_nothing_and_shuffles_its_rows_once(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_ROWS", 50)
    written = []
    from pyspark.sql.readwriter import DataFrameWriter

    for name in ("parquet", "save", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, name, lambda *a, **k: written.append(a))
    events = spark.read.parquet(f"{SF}/events.parquet")
    for df in (W.count_window(events, 7, "event_id"), W.triggered_window(events, W.ValueChangeTrigger("event_type"), "event_id"), W.triggered_window(events, W.ConditionTrigger(F.col("value") > 90), "event_id")):
        got = operators(df)
        # Of the exchanges one deals the rows; the others carry what blocks give.
        assert got["Exchange"] <= 4 and got["BroadcastHashJoin"] == 1 and not got["SortMergeJoin"]
    assert not written


@pytest.mark.parametrize("order", [["a"], [F.desc], ["b", "a"], [F.asc_nulls_last, "a"], [F.desc_nulls_first, "a"]])
def test_blocks_keep_every_order(spark, monkeypatch, order):
    """Row numbers by blocks against one window over all rows, with NULLs, NaN, ties and both directions."""
    from pyspark.sql import Window

    monkeypatch.setattr(O, "BLOCK_ROWS", 30)
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float((i * 37) % 50), (i * 13) % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b bigint").repartition(3)
    by = [c("a") if callable(c) else F.col(c) for c in order] + [F.col("id")]
    got = {r.id: r.n for r in O.with_row_number(df, by, "n").collect()}
    assert got == {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.orderBy(*by))).collect()}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(12,3)", "boolean", "binary", "int", "array<int>"])
def test_blocks_of_every_type(spark, monkeypatch, kind):
    monkeypatch.setattr(O, "BLOCK_ROWS", 10)
    made = {"date": "date_add(date'1969-12-01', cast(id as int))", "timestamp": "timestamp_seconds(id * 1000003 - 50000000)", "timestamp_ntz": "cast(timestamp_seconds(id * 1000003) as timestamp_ntz)", "binary": "cast(cast(id as string) as binary)", "boolean": "id > 50", "array<int>": "array(cast(id as int))"}
    df = spark.range(100).select(F.expr(made.get(kind, f"cast(id as {kind})")).alias("v"), "id").repartition(3)
    o = O.Ordered(df, [F.col("v")])
    ends = o.rows.groupBy(O.BLOCK).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(O.BLOCK)
    rows = ends.collect()
    assert all(x.hi < y.lo for x, y in zip(rows, rows[1:], strict=False))
    assert len(rows) > {"boolean": 1, "array<int>": 0}.get(kind, 5)


#: Queries over an order of all rows, which ran out of the driver's memory on 60 times sf0.1: Spark put the search for blocks into itself at every step.
BY_ORDER = ["count_window", "late_data_side_output", "late_sliding", "running_group_summary", "sort_count_window", "value_change_trigger", "activity_sessions_of_all", "count_trigger", "late_data_drop", "late_sessions", "running_count", "running_max", "running_stats", "sliding_count_window", "sort_by", "window_builder_lateness", "condition_trigger"]


@pytest.mark.parametrize("name", BY_ORDER)
def test_plans_of_orders_do_not_grow_with_the_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(O, "BLOCK_ROWS", 10**9)
    expected = sorted(map(str, QUERIES[name](spark, SF).collect()))
    made = []
    for rows in (100, 10):
        monkeypatch.setattr(O, "BLOCK_ROWS", rows)
        df = QUERIES[name](spark, SF)
        made.append(df._jdf.queryExecution().analyzed().toString().count(f" AS {O.BLOCK}#"))
    assert made[0] == made[1] > 0
    assert sorted(map(str, df.collect())) == expected
