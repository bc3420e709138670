"""Queries that store tables, views and streams under the shared folder and read them back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.aggregates import agg
from tidemark.operators import audits, dml, encodings, layout, lookups, manifests, skip_index
from tidemark.operators.rollup import AggregatingView, ViewRegistry, select_is_safe
from tidemark.plans.analytics import EXACT, blocks, hourly
from tidemark.plans.registry import query
from tidemark.session import load
from tidemark.sources import queues
from tidemark.sources.engines import TableKind, read, read_stream, write
from tidemark.sources.places import checkpoints
from tidemark.streaming import buffers, views

HOURLY = f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {EXACT.format('value')} AS total, count(*) AS n FROM events GROUP BY 1"


def place(spark: SparkSession, name: str) -> str:
    return f"{checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(HOURLY)
def stored_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A view filled from the past, kept up by two blocks, compacted and read."""
    view, path = hourly(), place(spark, "rollup")
    first, *rest = blocks(load(spark, d, "events"), "event_id")
    view.populate(first, path)
    for b in rest:
        view.insert(b, path)
    view.compact(spark, path, path + "-compact")
    return view.read(spark, path + "-compact")


@query(f"SELECT CAST(ts AS DATE) AS day, {EXACT.format('value')} AS total, count(*) AS n FROM events GROUP BY 1")
def chained_views(spark: SparkSession, d: str) -> DataFrame:
    """A daily view over the hourly view's answers, refreshed after it."""
    hours = hourly().over_blocks(blocks(load(spark, d, "events"), "event_id"))
    daily = AggregatingView("daily", {"day": S.to_date(F.col("hour"))}, [agg.exact_sum("total", "total"), agg.sum("n", "n")])
    registry = ViewRegistry()
    registry.register(daily, ("rollup_hourly",))
    registry.register(hourly())
    assert registry.order() == ["rollup_hourly", "daily"]
    return daily.direct(hours)


@query(HOURLY)
def stream_rollup_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events as files, streamed two files at a time; each block adds its own states."""
    events, at = load(spark, d, "events"), place(spark, "stream")
    events.repartition(4).write.parquet(f"{at}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    views.maintain(source, hourly(), f"{at}/states", f"{at}/offsets").awaitTermination()
    return views.answers(spark, hourly(), f"{at}/states")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def stream_json_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Messages of JSON text, parsed by a schema and kept by a view, as a message queue's would be."""
    at = place(spark, "messages")
    load(spark, d, "events").select(F.to_json(F.struct("event_type", "props")).alias("value")).write.text(f"{at}/in")
    raw = spark.readStream.schema("value string").text(f"{at}/in")
    rows = raw.select(F.from_json("value", "event_type string, props string").alias("m")).select("m.event_type", S.json_string(F.col("m.props"), "k").cast("long").alias("k"))
    view = AggregatingView("by_type", {"event_type": F.col("event_type")}, [agg.sum("k", "k"), agg.count("n")])
    views.maintain(rows, view, f"{at}/states", f"{at}/offsets").awaitTermination()
    return views.answers(spark, view, f"{at}/states")


@query(HOURLY)
def queue_to_view(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of a queue, streamed into a view; two thirds of them come while the stream is down, which then goes on."""
    events, at = load(spark, d, "events"), place(spark, "queue")
    spec = TableKind("kafka", options={"client": "spool", "path": f"{at}/spool", "topics": "events", "format": "JSONEachRow"})
    for some in blocks(events, "event_id"):
        queues.publish(some, f"{at}/spool", "events", F.to_json(F.struct(*events.columns)), F.col("user_id"))
        views.maintain(read_stream(spark, spec, events.schema), hourly(), f"{at}/states", f"{at}/offsets").awaitTermination()
    return views.answers(spark, hourly(), f"{at}/states")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, true AS within FROM events GROUP BY 1")
def buffer_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Events through a buffer that is flushed by rows, bytes and time, and whether each flush is within its bounds."""
    events, at = load(spark, d, "events").select("event_id", "event_type", "value"), place(spark, "buffer")
    events.repartition(3).write.parquet(f"{at}/in")
    limits = buffers.Thresholds(layers=3, min_time=0.5, max_time=3, min_rows=50, max_rows=700, min_bytes=1000, max_bytes=50_000)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    total, flushed = events.count(), {}

    def block(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/block={k}")
        flushed[k] = rows.sparkSession.read.parquet(f"{at}/out/block={k}").count()

    flow = buffers.buffered(source, block, f"{at}/offsets", limits, "500 milliseconds")
    try:
        while flow.isActive and sum(flushed.values()) < total:  # however long it takes: what waits is flushed after max_time
            time.sleep(0.2)
    finally:
        flow.stop()
    if flow.exception():
        raise flow.exception()
    out = spark.read.parquet(f"{at}/out")
    fits = (F.col("__rows") <= limits.max_rows) & (F.col("__bytes") <= limits.max_bytes + 1000) & (F.col("__reason").startswith("max") | (F.col("__rows") >= limits.min_rows))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.bool_and(fits).alias("within"))


PATTERNS = ["%password%", "% tion%ing%", "%zzq%"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM documents WHERE text LIKE '{p}'" for p in PATTERNS))
def like_by_skip_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents like a pattern, from the files whose n-grams allow it."""
    at, index = place(spark, "texts"), skip_index.SkipIndex.parse("ngrambf_v1(4, 32768, 2, 7)")
    load(spark, d, "documents").select("doc_id", "text").repartitionByRange(16, "doc_id").write.parquet(f"{at}/table")
    skip_index.indexed(spark.read.parquet(f"{at}/table"), "text", index).write.parquet(f"{at}/index")
    filters = spark.read.parquet(f"{at}/index")
    found = [skip_index.like(spark, f"{at}/table", "text", filters, index, p).select(F.lit(p).alias("pattern"), "doc_id") for p in PATTERNS]
    return lookups.union_of(found)


@query("""SELECT 'now' AS state, o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND (o_orderstatus <> 'F' OR o_totalprice > 50000)
UNION ALL SELECT 'frozen', o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def frozen_partition(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status: one partition is kept aside and dropped, another replaced, and files that nothing names are freed."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = manifests.ManifestTable(spark, place(spark, "manifests"), "o_orderstatus")
    table.append(orders)
    table.freeze("open", "O")
    table.drop_partition("O")
    table.replace_partition("F", orders.where("o_orderstatus = 'F' AND o_totalprice > 50000"))
    table.free()
    return table.read().select(F.lit("now").alias("state"), "o_orderkey").unionByName(table.read("open").select(F.lit("frozen").alias("state"), "o_orderkey"))


@query("SELECT * FROM lineitem")
def encoded_table(spark: SparkSession, d: str) -> DataFrame:
    """Stored with codecs by column, dictionaries where sketches tell few values; rows as they were."""
    at = place(spark, "encoded")
    encodings.write_encoded(load(spark, d, "lineitem"), at, {"l_orderkey": "CODEC(Delta, ZSTD(3))", "l_linenumber": "Delta", "l_extendedprice": "ZSTD(1)"})
    return spark.read.parquet(at)


@query("SELECT event_id, user_id, value FROM events")
def queue_messages(spark: SparkSession, d: str) -> DataFrame:
    """What a queue holds, as a batch, several tasks a partition."""
    at = place(spark, "queue")
    events = load(spark, d, "events").select("event_id", "user_id", "value")
    queues.publish(events, at, "a", F.to_csv(F.struct(*events.columns)), F.col("event_id"))
    return read(spark, TableKind("kafka", options={"client": "spool", "path": at, "topics": "a", "format": "CSV", "task_messages": 1000}), events.schema)


@query("SELECT (year(ts) * 100 + month(ts))::BIGINT AS part, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2")
def partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    """Stored by month and type, sorted, with a bloom filter; read with partitions pruned."""
    at = place(spark, "partitioned")
    layout.write_partitioned(load(spark, d, "events"), at, {"part": S.yyyymm(F.col("ts"))}, ["event_type", "user_id"], bloom=["user_id"])
    return spark.read.parquet(at).where("part < 202402").groupBy(F.col("part").cast("long").alias("part"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def distributed_shards(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark, "shards")
    spec = TableKind("distributed", options={"shards": [f"{at}/{i}" for i in range(3)], "sharding_key": ["c_custkey"]})
    write(load(spark, d, "customer").select("c_custkey", "c_name"), spec)
    return read(spark, spec)


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation")
def log_appends(spark: SparkSession, d: str) -> DataFrame:
    spec = TableKind("log", options={"path": place(spark, "log")})
    for _ in range(2):
        write(load(spark, d, "nation"), spec)
    return read(spark, spec)


@query("SELECT r_regionkey, r_name FROM region")
def file_json_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "region").select("r_regionkey", "r_name")
    spec = TableKind("file", options={"path": place(spark, "json"), "format": "JSONEachRow"})
    write(rows, spec)
    return read(spark, spec, rows.schema)


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def replacing_table(spark: SparkSession, d: str) -> DataFrame:
    """A table kind that merges on reading."""
    spec = TableKind("replacing", ("event_id",), {"path": place(spark, "replacing")})
    write(load(spark, d, "events").select("user_id", "event_type", "event_id"), spec, order_by=["user_id", "event_type"])
    return read(spark, spec, keys=["user_id", "event_type"], sequence="event_id")


@query("SELECT count(*) AS n FROM part WHERE p_size > 10")
def memory_table(spark: SparkSession, d: str) -> DataFrame:
    spec = TableKind("memory", options={"name": "tidemark_parts"})
    write(load(spark, d, "part"), spec)
    write(load(spark, d, "part"), TableKind("null"))
    return read(spark, spec).where("p_size > 10").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey <> 0")
def swapped_table(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark, "swap")
    n = load(spark, d, "nation")
    dml.swap(spark, n, at)
    dml.swap(spark, dml.deleted(spark.read.parquet(at), F.col("n_regionkey") == 0).select("n_nationkey", F.upper("n_name").alias("n_name")), at)
    return spark.read.parquet(at)


@query("SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS city FROM customer UNION ALL SELECT s_suppkey, NULL, 'x' FROM supplier")
def inherited_tables(spark: SparkSession, d: str) -> DataFrame:
    parent = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return lookups.union_of([parent, load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("city"))])


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > -1e9")
def checked_view(spark: SparkSession, d: str) -> DataFrame:
    return audits.checked(load(spark, d, "supplier"), F.col("s_acctbal") > -1e9, "balance out of range").select("s_suppkey")


KINDS = [("ReplacingMergeTree(ver)", "replacing", "ver"), ("SummingMergeTree((a, b))", "summing", "(a, b)"), ("Distributed('c', 'db', 't', rand())", "distributed", "'c'|'db'|'t'|rand()"), ("Memory", "memory", ""), ("VersionedCollapsingMergeTree(sign, ver)", "versioned_collapsing", "sign|ver")]


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in k) + ')' for k in KINDS)}) v(text, kind, args)")
def parsed_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = [(t, (k := TableKind.parse(t)).kind, "|".join(k.args)) for t, _, _ in KINDS]
    return spark.createDataFrame(found, "text string, kind string, args string")


@query("SELECT * FROM (VALUES (0, 'error'), (1, 'ok'), (2, 'warning'), (3, 'error'), (4, 'ok')) v(k, said)")
def view_safety(spark: SparkSession, d: str) -> DataFrame:
    cases = [("SELECT a, sum(b) FROM t GROUP BY a", "merge_tree"), ("SELECT a, groupArrayState(b) FROM t", "aggregating"), ("SELECT a FROM t", "summing"), ("SELECT uniqExact(a) FROM t", "replacing"), ("SELECT a FROM t", "merge_tree")]
    return spark.createDataFrame([(i, select_is_safe(*c)) for i, c in enumerate(cases)], "k int, said string")




@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def refreshed_view(spark: SparkSession, d: str) -> DataFrame:
    """A materialized view made without data, then refreshed in place."""
    at = place(spark, "view")
    select = load(spark, d, "orders").where("o_totalprice > 50000").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    dml.swap(spark, select.limit(0), at)
    dml.swap(spark, select, at)
    return spark.read.parquet(at)
