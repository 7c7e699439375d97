"""Small vectors, and one test for each place where a loose engine would go wrong."""

import datetime as dt
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import aggregates as A
from weirflow.functions import coerce as C
from weirflow.functions.flatten import cross_flatten, dot_flatten
from weirflow.operators import event_time as E
from weirflow.operators import joins as J
from weirflow.operators import ordering as O
from weirflow.operators import relational as R
from weirflow.operators import running as G
from weirflow.operators import windows as W
from weirflow.sources import files, memory, sinks


def values(spark, xs, to="bigint"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"ord bigint, value {to}")


def windows(df):
    out = {}
    for r in df.orderBy("window_id", "ord").collect():
        out.setdefault(r.window_id, []).append(r.value)
    return [out[k] for k in sorted(out)]


def test_limit_and_offset(spark):
    v = values(spark, range(5))
    assert [r.value for r in R.limit(v, 2, "ord").collect()] == [0, 1]
    assert R.limit(v, 0, "ord").count() == R.limit(v, -1, "ord").count() == 0
    assert [r.value for r in R.offset(v, 3, "ord").collect()] == [3, 4]
    with pytest.raises(ValueError):
        R.limit(v, 2, None)


def test_select_skips_absent_fields(spark):
    assert R.select(values(spark, [1]), "nothing", "value").columns == ["value"]


def test_coercion(spark):
    df = spark.createDataFrame([("42", "1.5"), ("123abc", "x"), (" 12 ", "1.23e-4"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(C.get_or(df, "a", -1, "int")).collect()] == [42, -1, -1, -1]
    assert [r[0] for r in df.select(C.get(df, "b", "double")).collect()] == [1.5, None, 1.23e-4, None]
    n = spark.createDataFrame([(65,)], "a int")
    assert n.select(C.get(n, "a", "string")).head()[0] == "65"
    b = spark.createDataFrame([("false",), ("yes",)], "a string")
    assert [r[0] for r in b.select(C.get(b, "a", "boolean")).collect()] == [False, True]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:45Z",), ("2024-01-15 10:30:45",), ("2024-01-15",), ("x",)], "t string")
    got = [r[0] for r in df.select(C.parse_time(F.col("t"), T.StringType())).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 1, 15, 10, 30, 45) and got[2:] == [None, None]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 59, 59, 500000),)], "t timestamp")
    assert ts.select(C.standardize_time(F.col("t"))).head()[0] == dt.datetime(2024, 1, 1, 1)


def test_aggregates_over_nothing_and_many_types(spark):
    none = spark.createDataFrame([], "v double, s string")
    assert A.aggregates(none, A.sum_field("s", "v"), A.avg_field("a", "v"), A.min_field("m", "s"), A.count_field("n")).head() == (0.0, 0.0, "", 0)
    assert A.group_by(none, [], A.count_field("n")).count() == 0
    df = spark.createDataFrame([("a", 1.5, True), ("a", None, False), ("b", 2.0, True)], "k string, v double, f boolean")
    out = {r.k: r for r in A.group_by(df, ["k"], A.sum_field("s", "v"), A.min_field("m", "v"), A.avg_field("skip", "v", missing="skip"), A.max_field("f", "f")).collect()}
    assert (out["a"].s, out["a"].m, out["a"].skip, out["a"].f) == (1.5, 0.0, 1.5, True)


def test_many_rows_many_aggregates(spark):
    row = A.aggregates(spark.range(100_000).withColumnRenamed("id", "value"), A.sum_stream("s"), A.count_stream("n"), A.max_stream("m")).head()
    assert (row.s, row.n, row.m) == (4999950000, 100_000, 99_999)


def test_group_keys_are_typed(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), (None, "c")], "x string, y string")
    assert A.group_by(df, ["x", "y"], A.count_field("n")).count() == 3


def test_custom_fold(spark):
    fold = A.custom_fold("p", F.col("value"), F.col("ord"), F.lit(1).cast("bigint"), lambda s, v: s * v)
    assert A.aggregate_scalar(values(spark, [2, 3, 4]), fold) == 24


def test_custom_fold_with_merge(spark):
    """A text that grows over many values, in order; no values give the initial one."""
    joined = lambda s, v: F.when(s == "", v).otherwise(F.concat(s, F.lit(","), v))
    fold = A.custom_fold("p", F.col("id").cast("string"), -F.col("id"), F.lit(""), joined, F.upper, merge=joined)
    for n in (0, 1, 15, 16, 17, 257, 5000):
        assert A.aggregate_scalar(spark.range(n).repartition(3), fold) == ",".join(map(str, reversed(range(n))))


def test_a_text_folded_over_many_values_takes_linear_time(spark):
    """Copied at every value, these 300,000 would move 300 GB."""
    from weirflow.plans.queries import QUERIES

    events = spark.range(300_000).selectExpr("id as event_id", "'a' as event_type", "cast(id as double) as value")
    with pytest.MonkeyPatch.context() as m:
        m.setattr("weirflow.plans.queries.table", lambda *a: events)
        began = time.time()
        (row,) = QUERIES["custom_aggregates"](spark, "").collect()
    assert row.ids == ",".join(map(str, range(300_000))) and time.time() - began < 20


def people(spark):
    left = spark.createDataFrame([(9, "none"), (1, "ann"), (2, "bob"), (None, "nil")], "dept int, name string")
    right = spark.createDataFrame([(1, "hr"), (2, "it"), (3, "law"), (None, "null")], "id int, name string")
    return left, right


def test_joins(spark):
    left, right = people(spark)
    assert J.inner_join(left, right, "dept", "id").count() == 2
    assert J.left_join(left, right, "dept", "id").count() == 4
    assert J.right_join(left, right, "dept", "id").count() == 4
    assert J.full_join(left, right, "dept", "id").count() == 6
    assert J.inner_join(left, right, "dept", "id", null_safe=True).count() == 3
    assert J.inner_join(left, right, "dept", "id").columns == ["dept", "left.name", "id", "right.name"]
    over = {r.dept: r.name for r in J.left_join(left, right, "dept", "id", prefixes=("", "")).collect()}
    assert over == {9: "none", 1: "hr", 2: "it", None: "nil"}
    safe = sorted(J.full_join(left, right, "dept", "id", prefixes=("", ""), null_safe=True).select("dept", "name", "id").collect(), key=str)
    assert [tuple(r) for r in safe] == [(1, "hr", 1), (2, "it", 2), (9, "none", None), (None, "law", 3), (None, "null", None)]
    kept = {r.id: r.name for r in J.right_join(left, right, "dept", "id", prefixes=("", "")).collect()}
    assert kept == {1: "hr", 2: "it", 3: "law", None: "null"}
    with pytest.raises(TypeError):
        J.inner_join(left, right, "name", "id")
    big, small = spark.createDataFrame([(1_000_000,)], "a bigint"), spark.createDataFrame([(1e6,)], "b double")
    assert J.inner_join(big, small, "a", "b").count() == 1


def test_top_and_bottom(spark):
    v = values(spark, [5, 2, 9, 1, 8, 7, 9])
    assert [r.value for r in O.top_k(v, 3, "value", "ord").collect()] == [9, 9, 8]
    assert [r.ord for r in O.top_k(v, 1, "value", "ord").collect()] == [2]
    assert [r.value for r in O.bottom_k(v, 2, "value", "ord").collect()] == [1, 2]
    assert O.top_k(v, 0, "value").count() == 0


def test_sort_missing(spark):
    v = values(spark, [2, None, 1])
    assert [r.value for r in O.sort_by(v, "value").collect()] == [None, 1, 2]
    assert [r.value for r in O.sort_by_desc(v, "value").collect()] == [2, 1, None]


def test_sort_in_count_windows(spark):
    out = O.sort_count_window(values(spark, [5, 2, 8, 1, 9, 3]), 3, "ord", F.col("value")).orderBy("window_id", "position").collect()
    assert [r.value for r in out] == [2, 5, 8, 1, 3, 9]


def test_sort_with_comparator(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "k string, v int")
    out = O.sort_with(df, ["k"], lambda x, y: y["v"] - x["v"]).orderBy("position").collect()
    assert [r.v for r in out] == [3, 2, 1]


def test_count_windows(spark):
    assert windows(W.count_window(values(spark, range(1, 8)), 3, "ord")) == [[1, 2, 3], [4, 5, 6], [7]]
    assert windows(W.sliding_count_window(values(spark, range(1, 6)), 3, 2, "ord")) == [[1, 2, 3], [3, 4, 5]]
    assert W.sliding_count_window(values(spark, [1, 2]), 3, 1, "ord").count() == 0
    for bad in (lambda: W.count_window(values(spark, [1]), 0, "ord"), lambda: W.sliding_count_window(values(spark, [1]), 2, 3, "ord")):
        with pytest.raises(ValueError):
            bad()


def test_triggers(spark):
    v = values(spark, [5, 5, 7, 7, 7, 2])
    assert windows(W.triggered_window(v, W.ValueChangeTrigger("value"), "ord")) == [[5], [5, 7], [7, 7, 2]]
    assert windows(W.triggered_window(v, W.CountTrigger(4), "ord")) == [[5, 5, 7, 7], [7, 2]]
    assert windows(W.triggered_window(values(spark, [None, None, 1]), W.ValueChangeTrigger("value"), "ord")) == [[None], [None, 1]]


def at(*seconds):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in seconds]


def test_window_builder(spark):
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(at(0, 1, 2, 12, 13, 30))], "ord bigint, t timestamp, value bigint")
    assert windows(W.WindowBuilder().on_count(4).apply(rows, "t", "ord")) == [[0, 1, 2, 3], [4, 5]]
    assert windows(W.WindowBuilder().on_time(10).apply(rows, "t", "ord")) == [[0, 1, 2, 3], [4, 5]]
    assert windows(W.WindowBuilder().on_count(2).on_time(10).apply(rows, "t", "ord")) == [[0, 1], [2, 3], [4, 5]]
    assert windows(W.WindowBuilder().apply(rows, "t", "ord")) == [[0, 1, 2, 3, 4, 5]]
    assert windows(W.WindowBuilder().on_count(4).accumulating().apply(rows, "t", "ord")) == [[0, 1, 2, 3], [0, 1, 2, 3, 4, 5]]


def test_activity_sessions(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(at(0, 1, 5, 12, 40, 50), (False, True, False, True, False, True), strict=True))], "ord bigint, t timestamp, a boolean")
    for keys in (None, ["k"]):
        out = W.session_window(rows.withColumn("k", F.lit(1)), "t", "ord", 15, F.col("a"), keys).orderBy("ord").collect()
        assert [(r.ord, r.session_id) for r in out] == [(1, 0), (2, 0), (3, 0), (5, 1)]


def test_running(spark):
    for keys in (None, ["k"]):
        v = values(spark, [3, 1, 2]).withColumn("k", F.lit(1))
        out = G.running_stats(v, "value", "ord", keys).orderBy("ord").collect()
        assert [(r["count"], r["sum"], r["min"], r["max"], r["avg"]) for r in out] == [(1, 3, 3, 3, 3.0), (2, 4, 1, 3, 2.0), (3, 6, 1, 3, 2.0)]
    assert [r.running_avg for r in G.running_avg(values(spark, [1, 2]), "value", "ord").orderBy("ord").collect()] == [1.0, 1.5]


def test_group_summary_ties(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("abbaab")], "ord bigint, k string")
    out = A.running_group_summary(df, ["k"], 2, "ord").orderBy("total_processed").collect()
    assert [tuple(r) for r in out] == [(2, 2, "a", 1), (4, 2, "b", 2), (6, 2, "a", 3)]


def test_group_summary_counts_rows_that_tie(spark, monkeypatch):
    """Rows of one place in the order come by key; a key's label is its own; blocks give what one window would."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "a")], "ord bigint, k string")
    out = A.running_group_summary(df, ["k"], 2, "ord").orderBy("total_processed").collect()
    assert [tuple(r) for r in out] == [(2, 1, "a", 2), (4, 2, "a", 3)]
    odd = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, "a", None), (4, None, "a")], "ord bigint, x string, y string")
    assert [tuple(r) for r in A.running_group_summary(odd, ["x", "y"], 4, "ord").collect()] == [(4, 4, '["a|b","c"]', 1)]
    many = [(i // 3, "xyz"[(i * 7) % 5 % 3]) for i in range(300)]
    df = spark.createDataFrame(many, "ord bigint, k string").repartition(3)
    monkeypatch.setattr(O, "BLOCK_ROWS", 40)
    got = [tuple(r) for r in A.running_group_summary(df, ["k"], 10, "ord").orderBy("total_processed").collect()]
    seen, want, best = {}, [], (0, "")
    for n, (_, k) in enumerate(sorted(many), 1):
        seen[k] = seen.get(k, 0) + 1
        best = (seen[k], k) if seen[k] > best[0] else best
        if n % 10 == 0:
            want.append((n, len(seen), best[1], best[0]))
    assert got == want


@pytest.mark.parametrize("rows", [16_384, 25])
def test_global_windows_equal_those_of_one_key(spark, monkeypatch, rows):
    """Triggers, sessions, running values and late rows without keys, in one block and in many, against those within one key."""
    monkeypatch.setattr(O, "BLOCK_ROWS", rows)
    data = [(i, t, None if i % 9 == 0 else (i // 4) % 3, i % 5 == 0) for i, t in enumerate(at(*[i * 3 + (40 if i > 150 else 0) + (i * 7) % 5 for i in range(300)]))]
    df = spark.createDataFrame(data, "ord bigint, t timestamp, value bigint, a boolean").withColumn("k", F.lit(1)).repartition(3)
    same = lambda f: sorted(map(str, f(None).collect())) == sorted(map(str, f(["k"]).collect()))
    for trigger in (W.ValueChangeTrigger("value"), W.CountTrigger(7), W.ConditionTrigger(F.col("a"))):
        assert same(lambda keys, trigger=trigger: W.triggered_window(df, trigger, "ord", keys))
    assert same(lambda keys: W.session_window(df, "t", "ord", 14, F.col("a"), keys).select(*df.columns, "session_id"))
    assert same(lambda keys: W.sliding_count_window(df, 20, 7, "ord", keys))
    assert same(lambda keys: G.running_stats(df, "value", "ord", keys).select(*df.columns, "count", "sum", "min", "max", "avg"))
    assert same(lambda keys: E.with_watermark(df, "t", ["ord"], 10, keys))
    assert [r.ord for r in R.offset(df, 290, "ord").collect()] == list(range(290, 300)) and R.offset(df, 400, "ord").count() == 0


def test_extractors_over_nothing(spark):
    none = spark.createDataFrame([], "a int, s string")
    specs = A.sum_of("s", F.col("a") + 1), A.min_of("lo", F.col("a") * 2), A.max_of("hi", F.length("s")), A.avg_of("m", F.col("a")), A.min_of("t", F.col("s"))
    assert tuple(A.aggregates(none, *specs).head()) == (0, 0, 0, 0.0, "")
    some = spark.createDataFrame([(1, "xx"), (3, "y")], "a int, s string")
    assert tuple(A.aggregates(some, *specs).head()) == (6, 2, 2, 2.0, "xx")


def test_event_time(spark):
    rows = spark.createDataFrame([(t,) for t in at(0, 59.6, 61, 200)], "t timestamp")
    out = E.tumbling(rows, "t", 60).groupBy("window_start").count().orderBy("window_start").collect()
    assert [r["count"] for r in out] == [1, 2, 1]
    week = E.tumbling(rows, "t", 7 * 86400).head()
    assert week.window_start == dt.datetime(2024, 1, 1)
    one = E.session(rows.withColumn("k", F.lit(1)), "t", 60, ["k"], F.count("*").alias("n")).orderBy("session_start").collect()
    assert [r.n for r in one] == [3, 1]
    assert E.tumbling(spark.createDataFrame([("junk",), (None,)], "t string"), "t", 60).count() == 0
    with pytest.raises(ValueError):
        E.tumbling(rows, "absent", 60)


def test_late_rows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at(10, 130, 20, 140))], "ord bigint, t timestamp")
    assert [r.late for r in E.late_split(rows, "t", "ord", 60, 30, policy="side_output").orderBy("ord").collect()] == [False, False, True, False]
    assert E.late_split(rows, "t", "ord", 60, 30).count() == 3
    assert E.late_split(rows, "t", "ord", 60, 30, policy="update").count() == 4
    assert E.late_split(rows, "t", "ord", 60, 30, allowed_lateness=60).count() == 4


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, ("x",)), [1, 2], [7, 8, 9]), (3, (4, ("y",)), [], [5]), (6, (7, ("z",)), [], [])], "id int, a struct<b:int,c:struct<d:string>>, s array<int>, t array<int>")
    out = dot_flatten(df)
    assert out.columns == ["id", "a.b", "a.c.d", "s", "t"]
    assert [(r.id, r.s, r.t) for r in out.orderBy("id", "t").collect()] == [(1, 1, 7), (1, 2, 8), (3, None, 5), (6, None, None)]
    assert dot_flatten(df, "_", "a").columns == ["id", "a_b", "a_c_d", "s", "t"]
    assert cross_flatten(df.select("id", "s", "t")).count() == 6 + 1 + 1
    assert dot_flatten(out.select("id", "`a.b`")).columns == ["id", "a.b"]


def test_which_fields_are_arrays(spark):
    from weirflow.functions.flatten import is_array

    df = spark.createDataFrame([([1], 2, "x")], "a array<int>, b int, c string")
    assert [is_array(df, c) for c in df.columns] == [True, False, False]


def test_tee_and_split(spark):
    v = values(spark, [i % 20 for i in range(1000)])
    a, b = R.tee(v, 2)
    assert a.count() == b.count() == 1000
    assert R.split(v, "value").groupBy("group").count().where("count = 50").count() == 20
    odd = spark.createDataFrame([(None,), ("\0",), ("",)], "k string")
    assert R.split(odd, "k").groupBy("group").count().count() == 3


def test_records_and_ranges(spark):
    assert memory.from_records(spark, [{"a": 1}, {}], "a int").collect() == [(1,), (None,)]
    with pytest.raises(Exception):
        memory.from_records(spark, [{"a": "x"}], "a int").collect()
    assert [r.value for r in memory.value_range(spark, 5, 0, -2).collect()] == [5, 3, 1]
    with pytest.raises(ValueError):
        memory.value_range(spark, 0, 1, 0)
    assert memory.once(spark, 7).collect() == [(7,)]


def test_built_records(spark):
    b = memory.RecordBuilder().int("a", 1).bool("f", True).time("t", at(5)[0])
    assert memory.from_built(spark, b, memory.RecordBuilder().int("a", None)).orderBy(F.desc("a")).collect() == [(1, True, at(5)[0]), (None, None, None)]
    with pytest.raises(Exception, match="field a"):
        memory.RecordBuilder().int("a", "x")
    with pytest.raises(TypeError, match="field a"):
        memory.from_built(spark, b, memory.RecordBuilder().string("a", "x"))
    assert memory.from_built(spark).count() == 0


def test_unchecked_values(spark):
    assert [r.value for r in memory.from_values(spark, ["a", None], checked=False).collect()] == ["a", None]
    assert memory.from_records(spark, [{"a": 1.5}], "a double", checked=False).collect() == [(1.5,)]
    assert memory.once(spark, "x", "string").collect() == [("x",)]


def test_jobs_can_be_cancelled(spark):
    import threading

    slow = lambda n: spark.range(0, n, 1, 4).selectExpr("sum(id % 7)").collect()
    slow(10)
    with R.cancellable(spark, "to-cancel") as cancel:
        stopper = threading.Timer(2.0, cancel)
        stopper.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            slow(6 * 10**10)
        stopper.join()
    assert spark.range(3).count() == 3


def test_for_each(spark):
    seen, rows = spark.sparkContext.accumulator(0), []
    sinks.for_each(spark.range(10), lambda r: seen.add(r.id))
    sinks.for_each_local(spark.range(10), lambda r: rows.append(r.id))
    assert seen.value == 45 and sorted(rows) == list(range(10)) and len(sinks.collect(spark.range(4))) == 4


def test_partitioned_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, k string")
    R.split_write(rows, str(tmp_path / "one"), "k")
    sinks.write_partitioned(rows, str(tmp_path / "two"), "k")
    for name in ("one", "two"):
        assert sorted(p.name for p in (tmp_path / name).iterdir() if p.is_dir()) == ["k=a", "k=b"]
        assert files.read_parquet(spark, str(tmp_path / name)).where("k = 'a'").count() == 2


def test_batches(spark):
    assert [r.id for r in R.map_batches(spark.range(5), lambda bs: (b.slice(0, 1) for b in bs), "id long").limit(1).collect()] == [0]


def test_window_builder_carries_and_waits(spark):
    """Each trigger by itself (carry), the time since the last firing, keys, rows without a time, and a batch's end within a window."""
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(at(0, 1, 2, 12, 13, 30))], "ord bigint, t timestamp, value bigint")
    both = W.WindowBuilder(carry=True).on_count(4).on_time(10)
    # The count fires on its fourth row, at which ten seconds are over as well; then the time on the last row.
    assert windows(both.apply(rows, "t", "ord")) == [[0, 1, 2, 3], [4, 5]]
    assert windows(W.WindowBuilder().on_processing_time(12).apply(rows, "t", "ord")) == [[0, 1, 2, 3], [4, 5]]
    many = spark.createDataFrame([(i, at(i)[0], i % 3) for i in range(3000)] + [(9999, None, 0)], "ord bigint, t timestamp, k bigint").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = W.WindowBuilder(keys=("k",)).on_time(29.5).apply(many, "t", "ord").groupBy("k", "window_id").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # A row every three seconds: the eleventh is the first that is 29.5 seconds or more after the first.
    assert {r["count"] for r in got} == {11, 10} and sum(r["count"] for r in got) == 3000 and max(r.window_id for r in got) == 90
    with pytest.raises(ValueError):
        W.WindowBuilder().on_count(2).allow_lateness(5).apply(rows, "t", "ord")


def test_streamed_windows_and_sessions(spark, tmp_path):
    """Rows with their windows over several micro-batches: counts go on, a silence closes, sessions open with activity."""
    from weirflow.streaming import stateful

    src, schema = str(tmp_path / "in"), "k int, ord bigint, a boolean"
    out = {n: str(tmp_path / n) for n in ("count", "silence", "sessions")}
    for batch in ([(1, 0, False), (1, 1, False), (2, 0, True)], [(1, 2, True), (1, 3, False)], [(1, 4, False), (2, 1, False)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = lambda: memory.folder_stream(spark, src, schema, "parquet")
        for name, df in (("count", stateful.windowed_stream(stream(), "k", "ord", count=2)), ("silence", stateful.windowed_stream(stream(), "k", "ord", timeout_ms=1)), ("sessions", stateful.activity_sessions_stream(stream(), "k", "a", "ord", 3_600_000))):
            df.writeStream.format("parquet").option("path", out[name]).option("checkpointLocation", f"{out[name]}-c").trigger(availableNow=True).start().awaitTermination()
    got = lambda name, c: sorted((r.k, r.ord, r[c]) for r in spark.read.parquet(out[name]).collect())
    assert got("count", "window_id") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 0, 0), (2, 1, 0)]
    assert got("silence", "window_id") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 0, 0), (2, 1, 1)]
    assert got("sessions", "session_id") == [(1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 0, 0), (2, 1, 0)]


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path, "a.csv", 'id,when,ok,x,s\n1,2024-01-01 10:00:00,yes,1.5,"a,""b"\n2,2024-01-02 10:00:00,no,2,\n'))
    assert [t for _, t in df.dtypes] == ["bigint", "timestamp", "boolean", "double", "string"]
    assert df.orderBy("id").head()[4] == 'a,"b'
    assert files.read_csv(spark, write(tmp_path, "b.csv", "1,2\n"), header=False).columns == ["col0", "col1"]
    assert files.read_csv(spark, write(tmp_path, "c.csv", "1,2\n"), header=False, headers=["a"]).columns == ["a", "extra_col1"]
    assert files.read_csv(spark, write(tmp_path, "d.csv", "a,b\n")).count() == 0


def test_delimited(spark, tmp_path):
    df = files.read_delimited(spark, write(tmp_path, "a.txt", "a||b\n1||x\n\n2||y||z\n3\n"), sep="||")
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (2, "y"), (3, None)]
    assert files.read_delimited(spark, write(tmp_path, "b.txt", "1\t2\n"), header=False).columns == ["field_0", "field_1"]


def test_delimited_header_goes_by_place(spark, tmp_path):
    """Rows that equal the header stay, whether a file is one task's or many."""
    df = files.read_delimited(spark, write(tmp_path, "a.txt", "a\tb\na\tb\n1\t2\n"))
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("a", "b")]
    (tmp_path / "more").mkdir()
    for i in range(3):
        write(tmp_path / "more", f"{i}.txt", "a\tb\n" + f"a\tb\n{i}\tx\"y\n" * 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = files.read_delimited(spark, str(tmp_path / "more"))
        assert df.rdd.getNumPartitions() > 6
        assert {tuple(r) for r in df.groupBy("a", "b").count().collect()} == {("a", "b", 6000), *((str(i), 'x"y', 2000) for i in range(3))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_is_split_unless_cells_hold_line_breaks(spark, tmp_path):
    plain = write(tmp_path, "a.csv", "id,s\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    broken = write(tmp_path, "b.csv", "id,s\n" + "".join(f'{i},"x\ny"\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        one, two = files.read_csv(spark, plain), files.read_csv(spark, broken)
        assert one.rdd.getNumPartitions() > 4 and two.rdd.getNumPartitions() == 1
        assert one.count() == two.count() == 2000 and two.where("s = 'x\ny'").count() == 2000 and one.where("s = concat('x, \"', id, '\"')").count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_tsv(spark, tmp_path):
    df = files.read_tsv(spark, write(tmp_path, "a.tsv", 'id\tname\n1\t"a\tb"\n2\t"say ""hi"""\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a\tb"), (2, 'say "hi"')]


def test_json(spark, tmp_path):
    df = files.read_json(spark, write(tmp_path, "a.json", '{"a": 1, "b": [1, 2]}\n\n{"a": 2}\n'))
    assert df.count() == 2
    with pytest.raises(Exception):
        files.read_json(spark, write(tmp_path, "b.json", '{"a": 1}\n{"a": \n'), schema="a int").collect()
    sinks.write_json(spark.createDataFrame([(1, 2)], "a tinyint, b int"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == '{"a":1,"b":2}\n'


def test_protobuf(spark, tmp_path):
    from google.protobuf import descriptor_pb2

    from weirflow.sources import proto

    f = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto2")
    e = f.enum_type.add(name="Color")
    e.value.add(name="RED", number=0)
    e.value.add(name="BLUE", number=1)
    m = f.message_type.add(name="M")
    inner = m.nested_type.add(name="In")
    inner.field.add(name="x", number=1, type=1, label=1)
    for n, (name, kind, label, of) in enumerate((("id", 3, 1, ""), ("tags", 9, 3, ""), ("color", 14, 1, ".t.Color"), ("inner", 11, 1, ".t.M.In"), ("raw", 12, 1, ""), ("big", 4, 1, "")), 1):
        m.field.add(name=name, number=n, type=kind, label=label, type_name=of or None)
    about = descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString()
    rows = spark.createDataFrame([(1, ["a", "b"], "BLUE", (1.5,), b"\x00\xff", Decimal(2**63), "extra"), (2, None, None, None, None, None, None)], "id bigint, tags array<string>, color string, inner struct<x:double>, raw binary, big decimal(20,0), other string")
    for json_lines in (False, True):
        path = str(tmp_path / f"pb{json_lines}")
        proto.write_protobuf(rows, path, about, "t.M", json_lines)
        got = proto.read_protobuf(spark, path, about, "t.M", json_lines).orderBy("id").collect()
        assert got[0].asDict(True) == {"id": 1, "tags": ["a", "b"], "color": "BLUE", "inner": {"x": 1.5}, "raw": b"\x00\xff", "big": 2**63}
        assert got[1].id == 2 and got[1].tags is None and got[1].color is None
    # Files are read as streams: of many chunks, a message longer than a chunk, a name that a URI would escape.
    cls = proto.message_class(about, "t.M")
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    (folder / "x.pb").write_bytes(b"".join(proto.delimited(cls(id=i, tags=["t" * i])) for i in range(2500)))
    got = proto.read_protobuf(spark, str(folder), about, "t.M").where("length(tags[0]) = id or id = 0")
    assert got.count() == 2500
    one = b"".join(proto.delimited(cls(id=i, tags=["t" * i])) for i in range(300))
    assert all([m.id for m in proto.messages(one, cls, chunk)] == list(range(300)) for chunk in (1, 7, 1 << 20))
    assert list(proto.read_protobuf(spark, str(folder), about, "t.M").columns) == ["id", "tags", "color", "inner", "raw", "big"]
    body = proto.delimited(cls(id=5))
    assert [x.id for x in proto.messages(body + b"\x80", cls)] == [5]
    with pytest.raises(ValueError):
        list(proto.messages(body[:-1], cls))


def test_generated_stream(spark, tmp_path):
    from weirflow.streaming import windows as SW

    stream = memory.generate_stream(spark, lambda start, n: ((i,) for i in range(start, min(start + n, 30))), "n bigint", size=10)
    q = stream.writeStream.format("memory").queryName("generated").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    for _ in range(100):
        if spark.table("generated").count() >= 30:
            break
        q.awaitTermination(0.2)
    q.stop()
    assert sorted(r.n for r in spark.table("generated").collect()) == list(range(30))
    assert SW.watermark_of(q) is None


def test_late_stream(spark, tmp_path):
    from weirflow.streaming import windows as SW

    src = tmp_path / "in"
    src.mkdir()
    schema = "ord bigint, t timestamp"
    stream = memory.folder_stream(spark, str(src), schema, "parquet")
    for batch in ([(0, at(100)[0])], [(1, at(10)[0]), (2, at(95)[0])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        SW.split_late(stream, "t", 30, str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [0, 2]
    assert [r.ord for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [1]


def test_streams_of_windows_and_sessions(spark, tmp_path):
    from weirflow.streaming import windows as SW

    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(t, 1) for t in at(0, 10, 70, 200, 400)], "t timestamp, k int")
    rows.coalesce(1).write.parquet(src)
    read = lambda: memory.folder_stream(spark, src, "t timestamp, k int", "parquet")
    slid = SW.run_available(SW.sliding_stream(read(), "t", 120, 60, "0 seconds", ["k"], F.count("*").alias("n")).select("window.start", "n"), str(tmp_path / "slid"), "complete")
    assert sum(r.n for r in slid.collect()) == 10
    sessions = SW.run_available(SW.session_stream(read(), "t", 65, "0 seconds", [], F.count("*").alias("n")).select("session.start", "n"), str(tmp_path / "sessions"), "complete")
    assert sorted(r.n for r in sessions.collect()) == [1, 1, 3]


def test_fan_out_gives_every_sink_every_row(spark, tmp_path):
    from weirflow.streaming import windows as SW

    src = str(tmp_path / "in")
    spark.range(300).write.parquet(src)
    sinks_ = [lambda b, e, i=i: b.write.mode("overwrite").parquet(str(tmp_path / f"out{i}" / str(e))) for i in range(3)]
    SW.fan_out(memory.folder_stream(spark, src, "id bigint", "parquet"), str(tmp_path / "check"), *sinks_).awaitTermination()
    assert [spark.read.parquet(str(tmp_path / f"out{i}" / "*")).count() for i in range(3)] == [300] * 3
