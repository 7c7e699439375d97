"""One query for each operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import coerce as C
from ..functions.flatten import cross_flatten, dot_flatten
from ..operators import event_time as E
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import ranking as K
from ..operators import relational as R
from ..operators import running as G
from ..operators import windows as W
from ..sources import files, memory, sinks
from ..streaming import stateful, windows as SW
from .scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- projection, filters, maps ----------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def where_select(spark, d):
    return R.chain(table(spark, d, "lineitem"), lambda x: R.where(x, (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")), lambda x: R.select(x, "l_orderkey", "l_linenumber", "no_such_field", "l_quantity"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_columns(spark, d):
    return R.map_columns(table(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), revenue=F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("SELECT * REPLACE (upper(c_mktsegment) AS c_mktsegment), c_acctbal < 0 AS in_debt FROM customer")
def map_update(spark, d):
    return R.update(table(spark, d, "customer"), c_mktsegment=F.upper("c_mktsegment"), in_debt=F.col("c_acctbal") < 0)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 300)")
def limit_offset(spark, d):
    return R.pipe(lambda x: R.limit(x, 1000, "o_orderkey"), lambda x: R.offset(x, 300, "o_orderkey"))(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS value FROM events")
def extract_field_default(spark, d):
    return R.extract_field(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")), "k", "bigint")


@query("SELECT event_id, coalesce(TRY_CAST(value AS BIGINT), 0) * 0 + CAST(trunc(value) AS BIGINT) AS whole, CAST(event_id AS VARCHAR) AS text, 7::BIGINT AS absent FROM events")
def typed_access(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.get_or(e, "value", 0, "bigint").alias("whole"), C.get(e, "event_id", "string").alias("text"), C.get_or(e, "nothing", 7, "bigint").alias("absent"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def flat_map_words(spark, d):
    words = R.flat_map(table(spark, d, "documents").select("text"), F.split("text", " "), "word")
    return A.group_by(words, ["word"], A.count_field("n"))


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def map_batches(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    twice = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], ["c_custkey", "twice"]) for b in batches)
    return R.map_batches(table(spark, d, "customer").select("c_custkey", "c_acctbal"), twice, "c_custkey bigint, twice double")


@query("SELECT count(*)::BIGINT AS n FROM orders")
def cancellable_count(spark, d):
    """A job under a tag that another thread could cancel."""
    with R.cancellable(spark, "weirflow-count"):
        n = table(spark, d, "orders").count()
    return memory.once(spark, n).withColumnRenamed("value", "n")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_tax > 0.04 GROUP BY l_returnflag")
def parallel_map(spark, d):
    return R.parallel(table(spark, d, "lineitem").select("l_returnflag", "l_tax"), 8, lambda x: A.group_by(R.where(x, F.col("l_tax") > 0.04), ["l_returnflag"], A.count_field("n")))


@query("SELECT 'sum' AS what, round(sum(value), 2) AS v FROM events UNION ALL SELECT 'count', count(*) FROM events")
def tee_branches(spark, d):
    one, two = R.tee(table(spark, d, "events").select("value"), 2)
    return A.aggregates(one, A.sum_field("v", "value")).select(F.lit("sum").alias("what"), F.round("v", 2).alias("v")).unionAll(A.aggregates(two, A.count_field("v")).select(F.lit("count"), F.col("v").cast("double")))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def split_by_key(spark, d):
    return R.split(table(spark, d, "events"), "event_type").groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("group.event_type", "n", "total")


@query("SELECT event_type, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def per_group_code(spark, d):
    return R.per_group(table(spark, d, "events").select("event_type", "value"), ["event_type"], lambda key, pdf: pdf.iloc[:1].assign(n=len(pdf), spread=pdf["value"].max() - pdf["value"].min())[["event_type", "n", "spread"]], "event_type string, n bigint, spread double")


@query("SELECT o_orderkey, o_orderdate AS a, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def parse_time(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"))
    from pyspark.sql import types as T

    return o.where(C.parse_time(F.col("text"), T.StringType()) == C.parse_time(F.col("seconds"), T.LongType())).select("o_orderkey", C.parse_time(F.col("text"), T.StringType()).cast("timestamp_ntz").alias("a"), "seconds")


@query("SELECT event_id, date_trunc('second', ts + INTERVAL 500 MILLISECONDS) AS ts FROM events")
def standardize_time(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.standardize_time(F.col("ts"), e.schema["ts"].dataType).alias("ts"))


# --- nested data --------------------------------------------------------------


@query("SELECT p_partkey, p_brand AS \"info.brand\", p_size AS \"info.more.size\", i AS n FROM part, (SELECT unnest([1, 2]) AS i)")
def dot_flatten_records(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("more")).alias("info"), F.array(F.lit(1), F.lit(2)).alias("n"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("m"))
    return dot_flatten(p).drop("m")


@query("SELECT vec_id, i::BIGINT AS place, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def dot_flatten_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: i.cast("bigint")).alias("place"), F.col("embedding").alias("x"))
    return dot_flatten(e)


@query("SELECT c_custkey, a, b FROM customer, (SELECT unnest(['x', 'y']) AS a), (SELECT unnest([1, 2, 3]) AS b)")
def cross_flatten_arrays(spark, d):
    return cross_flatten(table(spark, d, "customer").select("c_custkey", F.array(F.lit("x"), F.lit("y")).alias("a"), F.array(*map(F.lit, (1, 2, 3))).alias("b")))


# --- joins ----------------------------------------------------------------------


#: Both sides have rows without a match and NULL keys.
_SIDES = """WITH c AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_custkey END AS c_custkey, c_name FROM customer WHERE c_acctbal > 0),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders WHERE o_custkey % 3 <> 1)
"""
_JOINED = _SIDES + "SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM c {} o ON c_custkey {} o_custkey"


def _customers_orders(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").selectExpr("CASE WHEN c_custkey % 10 <> 3 THEN c_custkey END AS c_custkey", "c_name")
    o = table(spark, d, "orders").where("o_custkey % 3 <> 1").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 100 <> 7 THEN o_custkey END AS o_custkey", "o_totalprice")
    return c, o


@query(_JOINED.format("JOIN", "="))
def inner_join(spark, d):
    return J.inner_join(*_customers_orders(spark, d), "c_custkey", "o_custkey")


@query(_JOINED.format("LEFT JOIN", "="))
def left_join(spark, d):
    return J.left_join(*_customers_orders(spark, d), "c_custkey", "o_custkey")


@query(_JOINED.format("RIGHT JOIN", "="))
def right_join(spark, d):
    return J.right_join(*_customers_orders(spark, d), "c_custkey", "o_custkey")


@query(_JOINED.format("FULL JOIN", "="))
def full_join(spark, d):
    return J.full_join(*_customers_orders(spark, d), "c_custkey", "o_custkey")


_NATIONS = "SELECT CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_regionkey + 1 END AS key, n_name AS name, n_nationkey AS n FROM nation"
_REGIONS = "SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END AS key, r_name AS name FROM region"


def _nations_regions(spark, d):
    n = table(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey + 1 END AS key", "n_name AS name", "n_nationkey AS n")
    return n, table(spark, d, "region").selectExpr("CASE WHEN r_regionkey <> 4 THEN r_regionkey END AS key", "r_name AS name")


@query(f"SELECT l.key AS \"left.key\", l.name AS \"left.name\", n, r.key AS \"right.key\", r.name AS \"right.name\" FROM ({_NATIONS}) l FULL JOIN ({_REGIONS}) r ON l.key IS NOT DISTINCT FROM r.key")
def null_safe_join(spark, d):
    return J.full_join(*_nations_regions(spark, d), "key", "key", null_safe=True)


@query(f"SELECT CASE WHEN m THEN r.key ELSE l.key END AS key, CASE WHEN m THEN r.name ELSE l.name END AS name, n FROM ({_NATIONS}) l FULL JOIN (SELECT *, TRUE AS m FROM ({_REGIONS})) r ON l.key = r.key")
def join_without_prefixes(spark, d):
    return J.full_join(*_nations_regions(spark, d), "key", "key", prefixes=("", ""))


@query(f"SELECT CASE WHEN m THEN r.key ELSE l.key END AS key, CASE WHEN m THEN r.name ELSE l.name END AS name, n FROM ({_NATIONS}) l LEFT JOIN (SELECT *, TRUE AS m FROM ({_REGIONS})) r ON l.key IS NOT DISTINCT FROM r.key")
def null_safe_join_without_prefixes(spark, d):
    return J.left_join(*_nations_regions(spark, d), "key", "key", prefixes=("", ""), null_safe=True)


@query("SELECT n.n_regionkey AS \"nation.key\", n.n_name AS \"nation.name\", r.r_regionkey AS \"region.key\", r.r_name AS \"region.name\" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_prefixes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return J.inner_join(n, r, "key", "key", prefixes=("nation", "region"), small_right_rows=10_000)


# --- aggregates -------------------------------------------------------------------


@query("SELECT round(sum(l_quantity), 2) AS s, count(*) AS c, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS a FROM lineitem")
def aggregates_multi(spark, d):
    out = A.aggregates(table(spark, d, "lineitem"), A.sum_field("s", "l_quantity"), A.count_field("c"), A.min_field("lo", "l_extendedprice"), A.max_field("hi", "l_extendedprice"), A.avg_field("a", "l_discount"))
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@query("SELECT 0.0::DOUBLE AS s, 0::BIGINT AS c, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS a")
def aggregates_empty(spark, d):
    v = table(spark, d, "lineitem").where("l_quantity < 0").select(F.col("l_quantity").alias("value"))
    return A.aggregates(v, A.sum_stream("s"), A.count_stream("c"), A.min_stream("lo"), A.max_stream("hi"), A.avg_stream("a"))


@query("SELECT round(sum(l_quantity * l_extendedprice), 2) AS s, min(l_extendedprice / l_quantity) AS lo, max(l_partkey % 100) AS hi, round(avg(l_quantity + l_tax), 6) AS a FROM lineitem")
def aggregates_of_expressions(spark, d):
    q = F.col("l_quantity")
    out = A.aggregates(table(spark, d, "lineitem"), A.sum_of("s", q * F.col("l_extendedprice")), A.min_of("lo", F.col("l_extendedprice") / q), A.max_of("hi", F.col("l_partkey") % 100), A.avg_of("a", q + F.col("l_tax")))
    return out.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@query("SELECT 0::BIGINT AS s, 0.0::DOUBLE AS lo, '' AS hi, 0.0::DOUBLE AS a")
def aggregates_of_nothing(spark, d):
    none = table(spark, d, "lineitem").where("l_quantity < 0")
    return A.aggregates(none, A.sum_of("s", F.col("l_linenumber")), A.min_of("lo", F.col("l_tax")), A.max_of("hi", F.col("l_returnflag")), A.avg_of("a", F.col("l_tax"))).withColumn("s", F.col("s").cast("long"))


@query("SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 10")
def aggregate_scalar(spark, d):
    return memory.once(spark, A.aggregate_scalar(table(spark, d, "lineitem").where("l_quantity > 10"), A.count_field("n"))).withColumnRenamed("value", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_stats(spark, d):
    out = A.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], A.sum_field("sum_qty", "l_quantity"), A.avg_field("avg_price", "l_extendedprice"), A.min_field("min_disc", "l_discount"), A.max_field("max_tax", "l_tax"), A.count_field("n"))
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_price": F.round("avg_price", 4)})


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_by_keys_only(spark, d):
    return A.group_by(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_type, round(sum(value * value), 2) AS squares, count(*) FILTER (WHERE value > 50) AS above, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY event_type")
def custom_aggregates(spark, d):
    joined = lambda s, v: F.when(s == "", v).otherwise(F.concat(s, F.lit(","), v))
    fold = A.custom_fold("ids", F.col("event_id").cast("string"), F.col("event_id"), F.lit(""), joined, merge=joined)
    out = A.group_by(table(spark, d, "events"), ["event_type"], A.column_spec("squares", F.round(F.sum(F.col("value") * F.col("value")), 2)), A.column_spec("above", F.count_if(F.col("value") > 50)), fold)
    return out


@query("""WITH c AS (SELECT event_id, user_id::VARCHAR AS k, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events),
m AS (SELECT *, max(c) OVER (ORDER BY n) AS best, sum((c = 1)::INT) OVER (ORDER BY n) AS active FROM c)
SELECT m.n AS total_processed, m.active::BIGINT AS active_groups, (SELECT arg_min(c.k, c.n) FROM c WHERE c.c = m.best) AS largest_group_key, m.best AS largest_group_count FROM m WHERE m.n % 1000 = 0""")
def running_group_summary(spark, d):
    return A.running_group_summary(table(spark, d, "events"), ["user_id"], 1000, "event_id")


# --- running aggregates ---------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS running_sum FROM events")
def running_sum(spark, d):
    return G.running_sum(_events(spark, d), "value", "event_id", ["user_id"]).withColumn("running_sum", F.round("running_sum", 2))


@query("SELECT event_id, user_id, value, count(*) OVER (ORDER BY event_id) AS running_count FROM events")
def running_count(spark, d):
    return G.running_count(_events(spark, d), "event_id")


@query("SELECT event_id, user_id, value, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id), 9) AS running_avg FROM events")
def running_avg(spark, d):
    return G.running_avg(_events(spark, d), "value", "event_id", ["user_id"]).withColumn("running_avg", F.round("running_avg", 9))


@query("SELECT event_id, user_id, value, max(value) OVER (ORDER BY event_id) AS running_max FROM events")
def running_max(spark, d):
    return G.running_max(_events(spark, d), "value", "event_id")


@query("SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS running_min FROM events")
def running_min(spark, d):
    return G.running_min(_events(spark, d), "value", "event_id", ["user_id"])


@query("SELECT event_id, user_id, value, count(*) OVER w AS count, round(sum(value) OVER w, 2) AS sum, min(value) OVER w AS min, max(value) OVER w AS max, round(sum(value) OVER w, 2) / count(*) OVER w AS avg FROM events WINDOW w AS (ORDER BY event_id)")
def running_stats(spark, d):
    # The average of the rounded sum: rounding averages would differ where they end in a 5.
    return G.running_stats(_events(spark, d), "value", "event_id").withColumn("sum", F.round("sum", 2)).withColumn("avg", F.col("sum") / F.col("count"))


# --- order ----------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_brand NULLS FIRST, p_size NULLS FIRST, p_partkey) AS place FROM part")
def sort_by(spark, d):
    rows = O.with_row_number(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size", "p_partkey"], "place")
    return O.sort_by(rows, "p_brand", "p_size", "p_partkey")


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC NULLS LAST) AS place FROM part")
def sort_by_desc(spark, d):
    rows = O.with_row_number(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.desc("p_partkey")], "place")
    return O.sort_by_desc(rows, "p_retailprice", "p_partkey")


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """Each row of a sorted result with the row before it in the result: the hash of unordered rows then shows the order."""
    rows = df.select(*columns).collect()
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "place bigint, " + ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes))


@query("SELECT row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place, n_name FROM nation")
def sort_by_expressions(spark, d):
    return _placed(O.sort(table(spark, d, "nation"), F.desc("n_regionkey"), F.asc("n_name")), "n_name")


@query("SELECT row_number() OVER (ORDER BY n_name) AS place, n_name AS value, 'asc' AS way FROM nation UNION ALL SELECT row_number() OVER (ORDER BY n_name DESC), n_name, 'desc' FROM nation")
def sort_asc_and_desc(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("value"))
    return _placed(O.sort_asc(n), "value").withColumn("way", F.lit("asc")).unionAll(_placed(O.sort_desc(n), "value").withColumn("way", F.lit("desc")))


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name), n_name DESC) - 1 AS position, n_name FROM nation")
def sort_with_comparator(spark, d):
    by = lambda x, y: F.when(F.length(x["n_name"]) != F.length(y["n_name"]), F.length(x["n_name"]) - F.length(y["n_name"])).when(x["n_name"] < y["n_name"], 1).when(x["n_name"] > y["n_name"], -1).otherwise(0)
    return O.sort_with(table(spark, d, "nation").select("n_regionkey", "n_name"), ["n_regionkey"], by).withColumn("position", F.col("position").cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return O.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def bottom_k(spark, d):
    return O.bottom_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY value, event_id) AS position FROM (SELECT event_id, value, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS window_id FROM events)")
def sort_count_window(spark, d):
    return O.sort_count_window(table(spark, d, "events").select("event_id", "value"), 100, "event_id", F.col("value"), F.col("event_id"))


@query("SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY value DESC, event_id) AS position FROM (SELECT event_id, value, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events)")
def sort_time_window(spark, d):
    return O.sort_time_window(table(spark, d, "events").select("event_id", "value", "ts"), "ts", "1 hour", F.desc("value"), F.col("event_id")).drop("ts")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER w AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, lag(c_acctbal) OVER w AS lag, lead(c_acctbal) OVER w AS lead, ntile(4) OVER w AS ntile FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
def ranking(spark, d):
    out, keys, by = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], ["c_acctbal", "c_custkey"]
    for kind in ("row_number", "rank", "dense_rank"):
        out = K.rank(out, kind, keys, by).withColumn(kind, F.col(kind).cast("long"))
    out = K.ntile(K.lead(K.lag(out, "c_acctbal", keys, by), "c_acctbal", keys, by), 4, keys, by)
    return out.withColumn("ntile", F.col("ntile").cast("long")).drop("c_acctbal")


# --- windows by count and trigger -------------------------------------------------------


@query("SELECT window_id, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS window_id FROM events) GROUP BY window_id")
def count_window(spark, d):
    return W.count_window(table(spark, d, "events").select("event_id", "value"), 300, "event_id").groupBy("window_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT unnest(generate_series(0, (SELECT (count(*) - 100) // 40 FROM r))) AS window_id)
SELECT window_id, count(*) AS n, round(sum(value), 2) AS total FROM w JOIN r ON i >= window_id * 40 AND i < window_id * 40 + 100 GROUP BY window_id""")
def sliding_count_window(spark, d):
    return W.sliding_count_window(table(spark, d, "events").select("event_id", "value"), 100, 40, "event_id").groupBy("window_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_TRIGGERED = "SELECT window_id, min(event_id) AS first, count(*) AS n FROM (SELECT event_id, coalesce(sum(fire) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS window_id FROM ({})) GROUP BY window_id"


@query(_TRIGGERED.format("SELECT event_id, (row_number() OVER (ORDER BY event_id) % 77 = 0)::INT AS fire FROM events"))
def count_trigger(spark, d):
    return W.triggered_window(table(spark, d, "events").select("event_id"), W.CountTrigger(77), "event_id").groupBy("window_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@query(_TRIGGERED.format("SELECT event_id, (row_number() OVER (ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id))::INT AS fire FROM events"))
def value_change_trigger(spark, d):
    return W.triggered_window(table(spark, d, "events").select("event_id", "event_type"), W.ValueChangeTrigger("event_type"), "event_id").groupBy("window_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@query(_TRIGGERED.format("SELECT event_id, (value > 90)::INT AS fire FROM events"))
def condition_trigger(spark, d):
    return W.triggered_window(table(spark, d, "events").select("event_id", "value"), W.ConditionTrigger(F.col("value") > 90), "event_id").groupBy("window_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


_BUILT = """WITH RECURSIVE r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, i, event_id, ts, event_type, 0::BIGINT AS window_id, 1 AS n, ts AS began, ts AS fired FROM r WHERE i = 1
 UNION ALL SELECT r.user_id, r.i, r.event_id, r.ts, r.event_type, s.window_id + CASE WHEN {fire} THEN 1 ELSE 0 END, CASE WHEN {fire} THEN 1 ELSE s.n + 1 END,
  CASE WHEN {fire} THEN r.ts ELSE s.began END, CASE WHEN {fire} THEN s.ts ELSE s.fired END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, window_id, count(*) AS n, min(event_id) AS first FROM s GROUP BY ALL"""


@query(_BUILT.format(fire="(s.n >= 10 OR s.ts - s.began >= INTERVAL 1 HOUR)"))
def window_builder(spark, d):
    built = W.WindowBuilder(keys=("user_id",)).on_count(10).on_time(3600)
    return built.apply(table(spark, d, "events").select("user_id", "event_id", "ts"), "ts", "event_id").groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(_BUILT.format(fire="(s.ts - s.fired >= INTERVAL 2 HOUR OR s.event_type = 'purchase')"))
def window_builder_processing_time(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("bought"))
    built = W.WindowBuilder(keys=("user_id",)).on_processing_time(7200).on("bought")
    return built.apply(e, "ts", "event_id").groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""WITH a AS (SELECT event_id, ts, TIMESTAMP '2024-01-01' + to_seconds(event_id + (event_id * 37) % 50) AS came FROM events),
w AS (SELECT *, max(ts) OVER (ORDER BY came, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a),
k AS (SELECT event_id, row_number() OVER (ORDER BY came, event_id) AS i FROM w WHERE top IS NULL OR ts >= top - INTERVAL 5 MINUTE)
SELECT (i - 1) // 200 AS window_id, count(*) AS n, min(event_id) AS first FROM k GROUP BY ALL""")
def window_builder_lateness(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id + (event_id * 37) % 50)").alias("at"))
    return W.WindowBuilder().on_count(200).allow_lateness(300).apply(e, "at", "event_id", "ts").groupBy("window_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS window_start FROM events) GROUP BY window_start")
def time_window(spark, d):
    return W.time_window(table(spark, d, "events").select("ts"), "ts", "2 hours").groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type = 'click' AS act FROM events),
l AS (SELECT *, max(CASE WHEN act THEN ts END) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a),
n AS (SELECT *, sum((act AND (last IS NULL OR ts - last > INTERVAL 5 MINUTE))::INT) OVER (ORDER BY ts, event_id) AS s FROM l)
SELECT (s - 1)::BIGINT AS session_id, count(*) AS n FROM n WHERE act OR ts - last <= INTERVAL 5 MINUTE GROUP BY ALL""")
def activity_sessions_of_all(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return W.session_window(e, "ts", "event_id", 300, F.col("event_type") == "click").groupBy("session_id").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type = 'click' AS act FROM events),
l AS (SELECT *, max(CASE WHEN act THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a),
n AS (SELECT *, sum((act AND (last IS NULL OR ts - last > INTERVAL 2 HOUR))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, (s - 1)::BIGINT AS session_id, count(*) AS n FROM n WHERE act OR ts - last <= INTERVAL 2 HOUR GROUP BY ALL""")
def activity_sessions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return W.session_window(e, "ts", "event_id", 7200, F.col("event_type") == "click", ["user_id"]).groupBy("user_id", "session_id").agg(F.count("*").alias("n"))


# --- event time ---------------------------------------------------------------------------


@query("SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value, time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts + INTERVAL 500 MILLISECONDS)) AS window_start FROM events) GROUP BY window_start")
def tumbling_event_time(spark, d):
    return E.tumbling(table(spark, d, "events").select("ts", "value"), "ts", 600).groupBy("window_start", "window_end").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS window_start FROM events) GROUP BY window_start")
def weekly_event_time(spark, d):
    return E.tumbling(table(spark, d, "events").select("ts"), "ts", 7 * 86400, standardize=False).groupBy("window_start").agg(F.count("*").alias("n"))


@query("SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start FROM events, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY window_start")
def sliding_event_time(spark, d):
    return E.sliding(table(spark, d, "events").select("ts"), "ts", 900, 300, standardize=False).groupBy("window_start").agg(F.count("*").alias("n"))


@query("SELECT window_start, count(*) AS n FROM (SELECT ts, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) WHERE ts < window_start + INTERVAL 10 MINUTE GROUP BY window_start")
def sliding_with_gaps(spark, d):
    return E.sliding(table(spark, d, "events").select("ts"), "ts", 600, 3600, standardize=False).groupBy("window_start").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_event_time(spark, d):
    return E.session(table(spark, d, "events").select("user_id", "ts"), "ts", 1800, ["user_id"], F.count("*").alias("n"), standardize=False)


_ARRIVAL = "(event_id // 50) * 50 + (event_id * 37) % 50"
_LATE = f"""WITH a AS (SELECT event_id, ts, {_ARRIVAL} AS arrival FROM events),
w AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 SECOND AS wm, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start FROM a),
l AS (SELECT *, coalesce(window_start + INTERVAL 60 SECOND <= wm, FALSE) AS late FROM w)
"""


@query(_LATE + "SELECT window_start, late, count(*) AS n FROM l GROUP BY ALL")
def late_data_side_output(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.expr("floor(event_id / 50) * 50 + (event_id * 37) % 50").alias("arrival"))
    return E.late_split(e, "ts", ["arrival", "event_id"], 60, 60, policy="side_output").groupBy("window_start", "late").agg(F.count("*").alias("n"))


@query(_LATE + "SELECT window_start, count(*) AS n FROM l WHERE NOT late GROUP BY ALL")
def late_data_drop(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.expr("floor(event_id / 50) * 50 + (event_id * 37) % 50").alias("arrival"))
    return E.late_split(e, "ts", ["arrival", "event_id"], 60, 60).groupBy("window_start").agg(F.count("*").alias("n"))


@query(_LATE + """, s AS (SELECT wm, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start FROM w, (SELECT unnest([0, 1, 2]) AS k))
SELECT window_start, count(*) AS n FROM s WHERE wm IS NULL OR window_start + INTERVAL 920 SECOND > wm GROUP BY ALL""")
def late_sliding(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.expr("floor(event_id / 50) * 50 + (event_id * 37) % 50").alias("arrival"))
    return E.late_split(e, "ts", ["arrival", "event_id"], 900, 60, allowed_lateness=20, slide=300).groupBy("window_start").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT event_id, user_id, ts, {_ARRIVAL} AS arrival FROM events),
w AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 SECOND AS wm FROM a),
k AS (SELECT * FROM w WHERE wm IS NULL OR ts + INTERVAL 100 SECOND > wm),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 100 SECOND THEN 0 ELSE 1 END AS new FROM k),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, i""")
def late_sessions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.expr("floor(event_id / 50) * 50 + (event_id * 37) % 50").alias("arrival"))
    kept = E.late_for_sessions(e, "ts", ["arrival", "event_id"], 100, 60)
    return E.session(kept, "ts", 100, ["user_id"], F.count("*").alias("n"), standardize=False).drop("session_end")


# --- sources and sinks ----------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, d, "customer"), path)
    return files.read_csv(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def tsv_round_trip(spark, d):
    path = new_path(spark, "tsv")
    sinks.write_tsv(table(spark, d, "supplier"), path)
    return files.read_delimited(spark, path)


@query("SELECT p_partkey, p_name, p_brand FROM part")
def quoted_tsv_round_trip(spark, d):
    path = new_path(spark, "quoted-tsv")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('"\tand\n')).alias("p_name"), "p_brand")
    sinks.write_tsv(p, path)
    return files.read_tsv(spark, path).withColumn("p_name", F.regexp_extract("p_name", r'^say "(.*)"\tand$', 1))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def separated_round_trip(spark, d):
    """A separator of several characters, no header."""
    path = new_path(spark, "separated")
    table(spark, d, "customer").select(F.concat_ws(" || ", "c_custkey", "c_name", "c_mktsegment").alias("value")).write.text(path)
    return files.read_delimited(spark, path, "||", header=False, headers=["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT n_name AS col0, n_regionkey::BIGINT AS extra_col1 FROM nation")
def csv_without_header(spark, d):
    path = new_path(spark, "bare-csv")
    table(spark, d, "nation").select("n_name", "n_regionkey").write.csv(path)
    return files.read_csv(spark, path, header=False, headers=["col0"])


@query("SELECT c_custkey, NULL::VARCHAR AS absent, c_name FROM customer")
def csv_chosen_headers(spark, d):
    path = new_path(spark, "chosen-csv")
    sinks.write_csv(table(spark, d, "customer"), path, ["c_custkey", "absent", "c_name"])
    return files.read_csv(spark, path, types={"c_custkey": "bigint", "absent": "string", "c_name": "string"}).withColumn("absent", F.nullif("absent", F.lit("")))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(spark, d):
    path = new_path(spark, "json")
    sinks.write_json(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_json(spark, path)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_array_round_trip(spark, d):
    path = new_path(spark, "json-array")
    sinks.write_json_array(table(spark, d, "region"), path, ["r_regionkey"], pretty=True)
    return files.read_json(spark, path, array=True)


@query("SELECT range AS value FROM range(10, 1000, 7)")
def value_range(spark, d):
    return memory.value_range(spark, 10, 1000, 7)


@query("SELECT range AS n, range * range AS square FROM range(0, 100)")
def generate(spark, d):
    return memory.generate(spark, lambda: ((i, i * i) for i in range(100)), "n bigint, square bigint")


@query("SELECT 1::BIGINT AS a, 'x' AS b UNION ALL SELECT 2, NULL")
def from_records(spark, d):
    return memory.from_records(spark, [{"a": 1, "b": "x"}, {"a": 2}], "a bigint, b string")


@query("SELECT unnest([3, NULL, 5])::BIGINT AS value UNION ALL SELECT 7")
def values_and_once(spark, d):
    return memory.from_values(spark, [3, None, 5]).unionAll(memory.once(spark, 7))


@query("SELECT 'a' AS value UNION ALL SELECT 'b'")
def values_of_any_type(spark, d):
    return memory.from_values(spark, ["a", "b"], checked=False)


@query("SELECT 1::BIGINT AS a, 2.5::DOUBLE AS b UNION ALL SELECT 2, NULL")
def records_unchecked(spark, d):
    from pyspark.sql import Row

    return memory.from_records(spark, [Row(a=1, b=2.5), {"a": 2}], "a bigint, b double", checked=False)


@query("SELECT 1::BIGINT AS id, 'ann' AS name, 2.5::DOUBLE AS score, 2::BIGINT AS tags, 'x' AS d UNION ALL SELECT 2, NULL, NULL, 0, 'y'")
def built_records(spark, d):
    one = memory.RecordBuilder().int("id", 1).string("name", "ann").float("score", 2.5).array("tags", ["a", "b"], "string").record("more", memory.RecordBuilder().string("d", "x"))
    two = memory.RecordBuilder().int("id", 2).array("tags", [], "string").record("more", memory.RecordBuilder().string("d", "y"))
    return memory.from_built(spark, one, two).select("id", "name", "score", F.size("tags").cast("long").alias("tags"), "more.d")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def foreach_collected(spark, d):
    """Rows by for_each_local and for_each (an accumulator counts), and back by from_records."""
    counts = A.group_by(table(spark, d, "events"), ["event_type"], A.count_field("n"))
    rows, seen = [], spark.sparkContext.accumulator(0)
    sinks.for_each_local(counts, rows.append)
    sinks.for_each(counts, lambda row: seen.add(row.n))
    if seen.value != sum(r.n for r in rows) or len(sinks.collect(counts)) != len(rows):
        raise AssertionError("for_each, for_each_local and collect disagree")
    return memory.from_records(spark, rows, "event_type string, n bigint")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def partitioned_round_trip(spark, d):
    path = new_path(spark, "partitioned")
    R.split_write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return A.group_by(files.read_parquet(spark, path), ["o_orderstatus"], A.count_field("n"))


def _nation_descriptors() -> bytes:
    from google.protobuf import descriptor_pb2

    f = descriptor_pb2.FileDescriptorProto(name="nation.proto", package="weirflow", syntax="proto2")
    m = f.message_type.add(name="Nation")
    for i, (name, kind) in enumerate((("n_nationkey", 3), ("n_name", 9), ("n_regionkey", 3)), 1):
        m.field.add(name=name, number=i, type=kind, label=1)
    return descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString()


_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


@query(_NATION)
def protobuf_round_trip(spark, d):
    from ..sources import proto

    path = new_path(spark, "proto")
    proto.write_protobuf(table(spark, d, "nation"), path, _nation_descriptors(), "weirflow.Nation")
    return proto.read_protobuf(spark, path, _nation_descriptors(), "weirflow.Nation")


@query(_NATION)
def protobuf_json_round_trip(spark, d):
    from ..sources import proto

    path = new_path(spark, "proto-json")
    proto.write_protobuf(table(spark, d, "nation"), path, _nation_descriptors(), "weirflow.Nation", json_lines=True)
    return proto.read_protobuf(spark, path, _nation_descriptors(), "weirflow.Nation", json_lines=True)


# --- streams ------------------------------------------------------------------------------------


def _stream(spark, d, *columns):
    """The events table as a stream, by way of a folder (a stream reads folders)."""
    folder = new_path(spark, "stream-source")
    table(spark, d, "events").select(*columns).write.parquet(folder)
    return memory.folder_stream(spark, folder, table(spark, d, "events").select(*columns).schema, "parquet")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = SW.tumbling_stream(_stream(spark, d, "ts", "event_type"), "ts", 3600, "1 minute", ["event_type"], F.count("*").alias("n"))
    return SW.run_available(out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"), new_path(spark, "stream-out"), "complete")


@query("SELECT user_id, count(*) AS n, round(max(value), 2) AS hi FROM events GROUP BY user_id")
def stream_running_stats(spark, d):
    out = stateful.running_stats_stream(_stream(spark, d, "event_id", "user_id", "value"), "user_id", "value", "event_id")
    return SW.run_available(out, new_path(spark, "stream-out")).groupBy("user_id").agg(F.max("count").alias("n"), F.round(F.max("max"), 2).alias("hi"))


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS window_id FROM events")
def stream_count_windows(spark, d):
    out = stateful.windowed_stream(_stream(spark, d, "event_id", "user_id"), "user_id", "event_id", count=20)
    return SW.run_available(out, new_path(spark, "stream-out"))


@query("SELECT event_id, user_id, 0::BIGINT AS session_id FROM (SELECT *, max((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS open FROM events) WHERE open = 1")
def stream_activity_sessions(spark, d):
    """All rows arrive within the timeout of an hour: what comes before a user's first click is dropped, the rest is one session."""
    e = _stream(spark, d, "event_id", "user_id", "event_type").withColumn("act", F.col("event_type") == "click")
    return SW.run_available(stateful.activity_sessions_stream(e, "user_id", "act", "event_id", 3_600_000), new_path(spark, "stream-out")).select("event_id", "user_id", "session_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    out = SW.session_stream(_stream(spark, d, "user_id", "ts"), "ts", 1800, "1 minute", ["user_id"], F.count("*").alias("n"))
    return SW.run_available(out.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("session_start"), "n"), new_path(spark, "stream-out"), "complete")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def stream_from_csv_and_json(spark, d):
    """Regions 0 to 2 by way of CSV files, the others by way of JSON files."""
    schema, path = "r_regionkey bigint, r_name string", new_path(spark, "stream-files")
    r = table(spark, d, "region")
    sinks.write_csv(r.where("r_regionkey <= 2"), f"{path}/csv")
    sinks.write_json(r.where("r_regionkey > 2"), f"{path}/json")
    one, two = files.stream_csv(spark, f"{path}/csv", schema), files.stream_json(spark, f"{path}/json", schema)
    return SW.run_available(one.unionAll(two), new_path(spark, "stream-out"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 99")
def stream_to_csv(spark, d):
    path = new_path(spark, "stream-csv")
    q = sinks.stream_to_csv(_stream(spark, d, "event_id", "event_type", "value").where("value > 99"), path, f"{path}-checkpoint")
    q.awaitTermination()
    return files.read_csv(spark, path, types={"event_id": "bigint", "event_type": "string", "value": "double"})


