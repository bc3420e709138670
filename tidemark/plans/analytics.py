"""Queries for aggregates, rollups, merging tables, lookups, layout and data operations over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.aggregates import agg, finalised, state_table
from tidemark.operators import audits, counted, dml, layout, lookups, merge_kinds
from tidemark.operators.rollup import AggregatingView, Projection, route
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.session import load
from tidemark.sources.engines import merged_tables

#: The exact sum of doubles, the same on both sides whatever the order of rows.
EXACT = "CAST(sum(CAST({0} AS DECIMAL(18,4))) AS DOUBLE)"


def blocks(rows: DataFrame, key: str, n: int = 3) -> list[DataFrame]:
    """rows in n parts by a hash, as blocks that came in apart."""
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def hourly() -> AggregatingView:
    return AggregatingView("rollup_hourly", {"hour": S.start_of_hour(F.col("ts"))}, [agg.exact_sum("value", "total"), agg.count("n")])


@query(f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {EXACT.format('value')} AS total, count(*) AS n FROM events GROUP BY 1")
def rollup_hourly(spark: SparkSession, d: str) -> DataFrame:
    """States of three blocks, merged and finalised."""
    return hourly().over_blocks(blocks(load(spark, d, "events"), "event_id"))


@query(f"SELECT CAST(ts AS DATE) AS day, event_type, {EXACT.format('value')} AS total, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def rollup_daily_by_type(spark: SparkSession, d: str) -> DataFrame:
    view = AggregatingView("daily", {"day": S.to_date(F.col("ts")), "event_type": F.col("event_type")}, [agg.exact_sum("value", "total"), agg.count("n"), agg.min("value", "low"), agg.max("value", "high")])
    return view.over_blocks(blocks(load(spark, d, "events"), "event_id"))


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_avg(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.avg("value", "mean")]
    states = state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "hour": S.start_of_hour(F.col("ts"))}, a)
    return finalised(states, ["event_type"], a).select("event_type", F.round("mean", 6).alias("mean"))


@query("SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def agg_min_max(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.min("value", "low"), agg.max("value", "high")]
    return finalised(state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "user_id": F.col("user_id")}, a), ["event_type"], a)


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_uniq_exact(spark: SparkSession, d: str) -> DataFrame:
    days = counted.counted(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, "user_id")
    return counted.distinct_values(days, ["event_type"], "users")


@query()
def agg_uniq_approx(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.uniq("user_id", "users")]
    return finalised(state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, a), ["event_type"], a)


@query("SELECT event_type, list_sort(list(user_id)) AS users FROM events GROUP BY 1")
def agg_group_array(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.group_array("user_id", "users")]
    return finalised(state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, a), ["event_type"], a)


@query("SELECT event_type, list_sort(list(DISTINCT user_id)) AS users FROM events GROUP BY 1")
def agg_group_uniq_array(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.group_uniq_array("user_id", "users")]
    return finalised(state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, a), ["event_type"], a)


@query("SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def agg_quantile_exact(spark: SparkSession, d: str) -> DataFrame:
    days = counted.counted(load(spark, d, "events"), {"user_id": F.col("user_id"), "day": F.to_date("ts")}, "value")
    return counted.quantiles(days, ["user_id"], {"median": 0.5}).select("user_id", F.round("median", 6).alias("median"))


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.99), 6) AS high FROM events GROUP BY 1")
def agg_quantiles_exact(spark: SparkSession, d: str) -> DataFrame:
    """Several quantiles of few large groups."""
    days = counted.counted(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, "value")
    found = counted.quantiles(days, ["event_type"], {"low": 0.01, "middle": 0.5, "high": 0.99})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("low", "middle", "high")))


@query()
def agg_quantile_sketch(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.quantile("value", 0.5, "median")]
    return finalised(state_table(load(spark, d, "events"), {"event_type": F.col("event_type"), "day": F.to_date("ts")}, a), ["event_type"], a)


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, max(value) AS some FROM events GROUP BY 1")
def agg_any_last(spark: SparkSession, d: str) -> DataFrame:
    """The last type by event id; any() is asked of a column with one value for each group."""
    peak = load(spark, d, "events").withColumn("peak", F.max("value").over(Window.partitionBy("user_id")))
    a = [agg.any_last("event_type", "event_id", "last_type"), agg.any("peak", "some")]
    return finalised(state_table(peak, {"user_id": F.col("user_id"), "day": F.to_date("ts")}, a), ["user_id"], a)


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END) AS DOUBLE) AS clicked, count_if(value > 50) AS big FROM events GROUP BY 1")
def agg_sum_if(spark: SparkSession, d: str) -> DataFrame:
    a = [agg.sum_if(F.col("value").cast("decimal(18,4)"), F.col("event_type") == "click", "clicked"), agg.count_if(F.col("value") > 50, "big")]
    return finalised(state_table(load(spark, d, "events"), {"user_id": F.col("user_id"), "day": F.to_date("ts")}, a), ["user_id"], a).select("user_id", F.col("clicked").cast("double").alias("clicked"), "big")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events")
def select_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_type", F.to_date("ts").alias("day")).distinct()


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, bool_or(n_name LIKE 'A%') AS some_a FROM nation GROUP BY 1")
def array_agg_ordered(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s.n_name)
    return load(spark, d, "nation").groupBy("n_regionkey").agg(names.alias("names"), F.bool_or(F.col("n_name").like("A%")).alias("some_a"))


@query("SELECT user_id, event_type, arg_max(value, {'t': ts, 'i': event_id}) AS value, max(event_id) FILTER (WHERE true) AS newest FROM events GROUP BY 1, 2")
def replacing_latest(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    last = merge_kinds.replacing(e, ["user_id", "event_type"], "event_id", version="ts")
    newest = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("newest"))
    return last.select("user_id", "event_type", "value").join(newest, ["user_id", "event_type"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def replacing_last_inserted(spark: SparkSession, d: str) -> DataFrame:
    return merge_kinds.replacing(load(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT l_shipdate, sum(l_linenumber)::BIGINT AS l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS l_quantity FROM lineitem GROUP BY 1")
def summing_daily(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_shipdate", "l_linenumber", F.col("l_quantity").cast("decimal(18,4)").alias("l_quantity"))
    return merge_kinds.summing(rows, ["l_shipdate"], ["l_linenumber", "l_quantity"]).withColumn("l_quantity", F.col("l_quantity").cast("double"))


SIGNED = "SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign, event_id % 2 AS ver FROM events"


def signed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumns({"sign": F.when(F.col("event_id") % 3 == 0, -1).otherwise(1), "ver": F.col("event_id") % 2})


@query(f"SELECT user_id, event_type, CAST(sum(sign * CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, sum(sign)::BIGINT AS \"left\" FROM ({SIGNED}) GROUP BY 1, 2 HAVING sum(sign) > 0")
def collapsing_sums(spark: SparkSession, d: str) -> DataFrame:
    rows = signed(spark, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return merge_kinds.collapsed_sums(rows, ["user_id", "event_type"], "sign", ["value"]).withColumn("value", F.col("value").cast("double"))


@query(f"SELECT user_id, event_type, arg_max(event_id, event_id) FILTER (WHERE sign = 1) AS event_id FROM ({SIGNED}) GROUP BY 1, 2 HAVING sum(sign) > 0")
def collapsing_rows(spark: SparkSession, d: str) -> DataFrame:
    return merge_kinds.collapsing(signed(spark, d), ["user_id", "event_type"], "sign", "event_id").select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_type, ver, CAST(sum(sign * CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, sum(sign)::BIGINT AS \"left\" FROM ({SIGNED}) GROUP BY 1, 2, 3 HAVING sum(sign) > 0")
def versioned_collapsing(spark: SparkSession, d: str) -> DataFrame:
    rows = signed(spark, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return merge_kinds.collapsed_sums(rows, ["user_id", "event_type"], "sign", ["value"], version="ver").withColumn("value", F.col("value").cast("double"))


@query("""WITH e AS (SELECT *, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(ts))::BIGINT AS age, floor(epoch(ts))::BIGINT AS s FROM events),
p AS (SELECT *, CASE WHEN age >= 1209600 THEN 86400 WHEN age >= 604800 THEN 3600 ELSE 60 END AS step FROM e)
SELECT event_type, make_timestamp((s - s % step) * 1000000) AS bucket, max(value) AS value, count(*) AS points FROM p GROUP BY 1, 2""")
def graphite_rollup(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    e = load(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return merge_kinds.graphite(e, ["event_type"], "ts", "value", now, [(0, 60), (604800, 3600), (1209600, 86400)], "max")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def optimize_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    return merge_kinds.deduplicated(load(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_type, {EXACT.format('value')} AS total, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2")
def aggregating_merge(spark: SparkSession, d: str) -> DataFrame:
    """A table of states, merged twice: the second merge changes nothing."""
    a = [agg.exact_sum("value", "total"), agg.uniq_exact(F.to_date("ts"), "days")]
    keys = {"user_id": F.col("user_id"), "event_type": F.col("event_type")}
    parts = [state_table(b, keys, a) for b in blocks(load(spark, d, "events"), "event_id")]
    once = merge_kinds.aggregating(reduce(DataFrame.unionByName, parts), list(keys), a)
    return finalised(merge_kinds.optimised("aggregating", once, keys=list(keys), aggregates=a), list(keys), a).withColumn("days", F.col("days").cast("long"))


@query("SELECT o_orderstatus, sum(n)::BIGINT AS n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def projection_routed(spark: SparkSession, d: str) -> DataFrame:
    """Answered from a stored pre-aggregate of finer keys."""
    orders = load(spark, d, "orders")
    p = Projection("by_status", ("o_orderstatus", "o_orderpriority"), (agg.count("n"),))
    return route(orders, [(p, p.build(orders))], ["o_orderstatus"], [agg.count("n")])[0]


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nation").createOrReplaceTempView("party_customer")
    load(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation").createOrReplaceTempView("party_supplier")
    return merged_tables(spark, r"party_\w+")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def dict_get_nation(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").where("n_nationkey < 20")
    return lookups.dict_get(load(spark, d, "customer"), nation, "c_nationkey", {"n_name": "unknown"}, table_key="n_nationkey").select("c_custkey", "n_name")


BANDS = [("F", 0.0, 100000.0, "small"), ("F", 100001.0, 250000.0, "middle"), ("O", 0.0, 150000.0, "low"), ("O", 150001.0, 900000.0, "high")]


@query("""WITH b(k, low, high, band) AS (VALUES ('F', 0, 100000, 'small'), ('F', 100001, 250000, 'middle'), ('O', 0, 150000, 'low'), ('O', 150001, 900000, 'high'))
SELECT o_orderkey, band FROM orders LEFT JOIN b ON o_orderstatus = k AND o_totalprice BETWEEN low AND high""")
def range_dict(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "o_orderstatus string, low double, high double, band string")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return lookups.range_dict_get(orders, bands, "o_orderstatus", "o_totalprice", "low", "high", ["band"], grid=50000).select("o_orderkey", "band")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def set_membership(spark: SparkSession, d: str) -> DataFrame:
    members = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return lookups.in_set(load(spark, d, "orders"), members, "o_custkey") .select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def set_non_membership(spark: SparkSession, d: str) -> DataFrame:
    members = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return lookups.in_set(load(spark, d, "orders"), members, "o_custkey", negate=True).select("o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_any(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return lookups.join_table(load(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "inner", "any", order="o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_all_left(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return lookups.join_table(load(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "left")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return lookups.join_table(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], strictness="semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return lookups.join_table(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], strictness="anti")


@query("""SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id
  AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.event_type = 'view' AND c.user_id = a.user_id AND c.ts <= a.ts)) AS view_id
FROM events a WHERE a.event_type = 'purchase'""")
def asof_events(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase, the user's last view at or before it."""
    e = load(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    return lookups.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "seen", ["view_id"], F.to_date).select("event_id", "view_id")


@query("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000")
def inner_join_chain(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = load(spark, d, "customer"), load(spark, d, "nation"), load(spark, d, "region")
    return c.where("c_acctbal > 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_name", "n_name", "r_name")


@query("SELECT a.n_name AS child, b.n_name AS parent FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey")
def self_join(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.col("b.n_nationkey") == F.col("a.n_regionkey")).select(F.col("a.n_name").alias("child"), F.col("b.n_name").alias("parent"))


@query("SELECT g.id, n_name FROM (VALUES (1, [1, 3, 99]), (2, [5])) g(id, members) LEFT JOIN nation ON list_contains(g.members, n_nationkey)")
def left_join_array_member(spark: SparkSession, d: str) -> DataFrame:
    """ON with array membership: the array is exploded first, so the join is by equality."""
    groups = spark.createDataFrame([(1, [1, 3, 99]), (2, [5])], "id int, members array<int>")
    hits = groups.select("id", F.explode("members").alias("n_nationkey")).join(load(spark, d, "nation"), "n_nationkey").select("id", "n_name")
    return groups.select("id").join(hits, "id", "left")


@query("SELECT r_name, coalesce(n, 0) AS n FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 3 GROUP BY 1) ON n_regionkey = r_regionkey")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").where("n_nationkey < 3").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return load(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INTEGER AS k FROM nation")
def lateral_series(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("n_regionkey"))).alias("k"))


@query("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS rich, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    mean = c.agg(F.avg("c_acctbal")).scalar()
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(n, "c_custkey", "left").select("c_custkey", (F.col("c_acctbal") > mean).alias("rich"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 3")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, d, "events").withColumn("r", F.rank().over(w)).where("r <= 3").select("user_id", "event_id", F.col("r").cast("long").alias("r"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def topk_latest(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY total DESC")
def order_by_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("total")).orderBy(F.desc("total"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    parent = load(spark, d, "customer").where("c_custkey % 5 > 0")
    return audits.orphans(load(spark, d, "orders"), parent, ["o_custkey"], ["c_custkey"]).select("o_orderkey")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return audits.unique_violations(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT p_partkey FROM part WHERE NOT (p_retailprice < 1500 AND p_size <= 45)")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    return audits.check_violations(load(spark, d, "part"), (F.col("p_retailprice") < 1500) & (F.col("p_size") <= 45)).select("p_partkey")


@query("SELECT event_id FROM events WHERE value IS NULL OR props IS NULL")
def not_null_violations(spark: SparkSession, d: str) -> DataFrame:
    return audits.not_null_violations(load(spark, d, "events"), ["value", "props"]).select("event_id")


@query("""WITH r AS (SELECT event_id AS id, user_id, ts AS lo, ts + INTERVAL 2 HOUR AS hi FROM events)
SELECT id FROM (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) WHERE reach > lo""")
def exclude_overlaps(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "events").selectExpr("event_id", "user_id", "ts AS lo", "ts + INTERVAL 2 HOUR AS hi")
    return audits.overlaps(r, ["user_id"], "lo", "hi", "event_id").select("id")


@query(ORACLE_SQL["exclude_overlaps"])
def exclude_overlaps_all(spark: SparkSession, d: str) -> DataFrame:
    """The same under the name it had while the other read a part of the events."""
    return exclude_overlaps(spark, d)


@query("""WITH r AS (SELECT event_id, user_id, ts AS lo, ts + INTERVAL 6 HOUR AS hi FROM events)
SELECT event_id FROM (SELECT *, lead(lo) OVER (PARTITION BY user_id ORDER BY lo, hi) AS nxt FROM r) WHERE nxt < hi""")
def without_overlaps(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "events").selectExpr("event_id", "user_id", "ts AS lo", "ts + INTERVAL 6 HOUR AS hi")
    return audits.overlap_with_next(r, ["user_id"], "lo", "hi").select("event_id")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND c_acctbal > 0")
def row_policy(spark: SparkSession, d: str) -> DataFrame:
    return audits.visible(load(spark, d, "customer"), [F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 3], [F.col("c_acctbal") > 0]).select("c_custkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", S.json_string(F.col("props"), "k").alias("k"), S.json_double(F.col("props"), "k").alias("x"))


@query("SELECT (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS part, count(*) AS n FROM lineitem GROUP BY 1")
def partition_yyyymm(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(S.yyyymm(F.col("l_shipdate")).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS range_part, CASE WHEN o_orderstatus IN ('F') THEN 'done' WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'default' END AS list_part FROM orders")
def range_and_list_partition(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", layout.range_partition(F.col("o_totalprice"), [100000, 200000]).alias("range_part"), layout.list_partition(F.col("o_orderstatus"), {"done": ["F"], "open": ["O", "P"]}).alias("list_part"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 14 DAY > TIMESTAMP '2024-02-01'")
def ttl_filter(spark: SparkSession, d: str) -> DataFrame:
    return layout.unexpired(load(spark, d, "events"), F.expr("ts + INTERVAL 14 DAY"), F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id")


@query("SELECT event_id, CASE WHEN ts + INTERVAL 14 DAY > TIMESTAMP '2024-02-01' THEN props END AS props FROM events")
def ttl_column(spark: SparkSession, d: str) -> DataFrame:
    return layout.expired_columns(load(spark, d, "events"), {"props": F.expr("ts + INTERVAL 14 DAY")}, F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id", "props")


@query("SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR), 1, 4))::INT < 16384")
def sample_by(spark: SparkSession, d: str) -> DataFrame:
    return layout.sampled(load(spark, d, "events"), F.col("user_id"), 0.25).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, upper(l_returnflag) AS flag FROM lineitem")
def computed_columns(spark: SparkSession, d: str) -> DataFrame:
    out = layout.computed(load(spark, d, "lineitem"), {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "flag": F.upper("l_returnflag")}, ephemeral=["l_tax"])
    return out.select("l_orderkey", "l_linenumber", "net", "flag")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) + 99 AS id FROM part")
def identity_numbers(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.places import checkpoints

    checkpoints(spark)
    return layout.densely_numbered(load(spark, d, "part"), "id", ["p_retailprice", "p_partkey"], offset=100).select("p_partkey", "id")


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 2)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.deleted(load(spark, d, "nation"), F.col("n_regionkey") == 2)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.updated(load(spark, d, "nation"), F.col("n_regionkey") == 2, {"n_name": F.concat(F.upper("n_name"), F.lit("!"))})


NEWS = "(VALUES (1, 'Atlantis', 7), (99, 'Lemuria', 1)) v(n_nationkey, n_name, n_regionkey)"


def news(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "Atlantis", 7), (99, "Lemuria", 1)], "n_nationkey int, n_name string, n_regionkey int")


@query(f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM {NEWS}) UNION ALL SELECT * FROM {NEWS}")
def upsert_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.upserted(load(spark, d, "nation"), news(spark), ["n_nationkey"])


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM {NEWS} WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def seed_ignore(spark: SparkSession, d: str) -> DataFrame:
    return dml.upserted(load(spark, d, "nation"), news(spark), ["n_nationkey"], "ignore")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, NULL::VARCHAR AS note FROM nation")
def common_column_copy(spark: SparkSession, d: str) -> DataFrame:
    return dml.common_columns(load(spark, d, "nation"), spark.createDataFrame([], "n_nationkey long, n_name string, note string"))


@query("SELECT * FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def replace_partition(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    return dml.replaced_partition(n, n.withColumn("n_name", F.lower("n_name")), "n_regionkey", 1)


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS piece FROM events")
def array_join_explode(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.explode(F.split("event_type", "i")).alias("piece"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('O', 'F') AND o_totalprice > 100000 AND o_orderdate IS NOT NULL AND o_orderpriority NOT LIKE '%LOW%'")
def filters(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return load(spark, d, "orders").where(p.like("1%") & F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") > 100000) & F.col("o_orderdate").isNotNull() & ~p.like("%LOW%")).select("o_orderkey")


@query("WITH RECURSIVE t(k, name, depth) AS (SELECT 0, n_name, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT k + 1, n_name, depth + 1 FROM t JOIN nation ON n_nationkey = k + 1 WHERE depth < 10) SELECT k, name, depth FROM t".replace("SELECT k + 1, n_name", "SELECT k + 1, nation.n_name"))
def recursive_view(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "nation").createOrReplaceTempView("rv_nation")
    return spark.sql("WITH RECURSIVE t(k, name, depth) AS (SELECT 0, n_name, 0 FROM rv_nation WHERE n_nationkey = 0 UNION ALL SELECT k + 1, n.n_name, depth + 1 FROM t JOIN rv_nation n ON n.n_nationkey = k + 1 WHERE depth < 10) SELECT k, name, depth FROM t")


@query("SELECT le, n FROM (SELECT unnest([10.0::DOUBLE, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) b, LATERAL (SELECT count(*) AS n FROM events WHERE value <= le)")
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.history import histogram

    return histogram(load(spark, d, "events"), "value", [10.0, 50.0, 100.0])


@query("SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS place FROM customer")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    """A SQL function over columns, and a rank by segment."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_negated(x DOUBLE) RETURNS DOUBLE RETURN -x")
    load(spark, d, "customer").createOrReplaceTempView("sf_customer")
    return spark.sql("SELECT c_custkey, c_mktsegment, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY tidemark_negated(c_acctbal), c_custkey) AS BIGINT) AS place FROM sf_customer")


@query("SELECT 'o_orderstatus' AS columns, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'o_orderstatus,o_orderpriority', count(DISTINCT (o_orderstatus, o_orderpriority)) FROM orders")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.statistics import distinct_counts as counts

    return counts(load(spark, d, "orders"), [["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]])


@query("SELECT round(sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n), 6) AS degree FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM orders GROUP BY 1)")
def dependency_degree(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.statistics import dependency

    return dependency(load(spark, d, "orders"), "o_custkey", "o_orderstatus").select(F.round("degree", 6).alias("degree"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS n_name, n_regionkey FROM nation")
def clear_column_in_partition(spark: SparkSession, d: str) -> DataFrame:
    return dml.cleared_column(load(spark, d, "nation"), "n_name", F.col("n_regionkey") == 1)


@query("SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 12")
def sql_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A SQL function that returns a table, joined laterally."""
    load(spark, d, "nation").createOrReplaceTempView("tf_nation")
    load(spark, d, "region").createOrReplaceTempView("tf_region")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_nations(r INT) RETURNS TABLE (n_name STRING) RETURN SELECT n_name FROM tf_nation WHERE n_regionkey = r AND n_nationkey < 12")
    return spark.sql("SELECT r_regionkey, f.n_name FROM tf_region, LATERAL tidemark_nations(r_regionkey) f")
