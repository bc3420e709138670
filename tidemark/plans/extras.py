"""Queries for operators that the other modules don't run: raw aggregates, partitions, streams, catalogs, collections and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.aggregates import agg, finalised, state_table
from tidemark.operators import audits, history, layout, lookups, objects, refresh
from tidemark.plans.objects import DIFF, changes
from tidemark.plans.registry import query
from tidemark.plans.schemas import values
from tidemark.plans.storage import place
from tidemark.session import load
from tidemark.sources.engines import TableKind, named_collection, read, with_collection, write
from tidemark.streaming import views


@query("SELECT event_type, round(sqrt(sum(CAST(value AS DECIMAL(18,4)) * CAST(value AS DECIMAL(18,4)))::DOUBLE), 6) AS norm FROM events GROUP BY 1")
def agg_raw(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate written as SQL, from states of two blocks."""
    square = "sum(CAST(CAST(value AS DECIMAL(18,4)) * CAST(value AS DECIMAL(18,4)) AS DECIMAL(28,8)))"
    norm = agg.raw(f"sqrt({square})", square, "sum(norm)", "round(sqrt(CAST(norm AS DOUBLE)), 6)", alias="norm")
    e = load(spark, d, "events")
    states = [state_table(e.where(w), {"event_type": F.col("event_type")}, [norm]) for w in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return finalised(states[0].unionByName(states[1]), ["event_type"], [norm])


@query("SELECT 8 AS parts, count(*) AS n, true AS whole_keys FROM orders")
def hash_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Every row has one of eight parts, and rows of a key have the same."""
    rows = load(spark, d, "orders").withColumn("part", layout.hash_partition(["o_custkey"], 8))
    keys = rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    inside = F.when((F.col("low") >= 0) & (F.col("high") < 8), F.col("n"))
    return keys.agg(F.count_distinct("low").cast("int").alias("parts"), F.sum(inside).alias("n"), F.bool_and(F.col("low") == F.col("high")).alias("whole_keys"))


@query("SELECT 'kept' AS place, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'moved', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'back', count(*) FROM orders")
def moved_partition(spark: SparkSession, d: str) -> DataFrame:
    """A partition detached from a stored table by a rename, and attached again."""
    at, aside = place(spark, "parts"), place(spark, "aside")
    load(spark, d, "orders").write.partitionBy("o_orderstatus").parquet(at)
    count = lambda where, path: spark.createDataFrame([(where, spark.read.parquet(path).count())], "place string, n long")
    layout.move_partition(spark, at, {"o_orderstatus": "F"}, aside)
    out = count("kept", at).union(count("moved", aside))
    layout.move_partition(spark, aside, {"o_orderstatus": "F"}, at)
    return out.union(count("back", at))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def buffered_flush(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a stream handed on at an interval, a file at a time."""
    events, at = load(spark, d, "events"), place(spark, "buffer")
    events.repartition(3).write.parquet(f"{at}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    flow = views.buffered(source, lambda rows, k: rows.write.mode("overwrite").parquet(f"{at}/out/block={k}"), f"{at}/offsets", "100 milliseconds")
    flow.processAllAvailable()
    flow.stop()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by windows of event time, with a watermark; the last state of each window."""
    events, at = load(spark, d, "events"), place(spark, "windows")
    events.write.parquet(f"{at}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = views.windowed(source, "ts", "6 hours", "1 hour", ["event_type"], [F.count("*").alias("n")])

    def block(rows: DataFrame, number: int) -> None:
        rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/out/block={number}")

    counts.writeStream.outputMode("update").foreachBatch(block).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("start", "event_type").agg(F.max_by("n", "block").alias("n"))


@query(f"""SELECT substr(string_agg(op || '_' || "table", '__' ORDER BY n DESC, op, "table"), 1, 60) AS name FROM (SELECT op, "table", count(*) AS n FROM ({DIFF}) GROUP BY ALL ORDER BY n DESC, op, "table" LIMIT 3)""")
def migration_names(spark: SparkSession, d: str) -> DataFrame:
    """A migration named by its most frequent kinds of operations and their tables."""
    return history.migration_name(changes(spark, d))


DEFAULTS = ["CURRENT_TIMESTAMP", "now()", "'x'", "0", "gen_random_uuid()", "nextval('s')", "uuid_generate_v4()", "TRUE", "lower('A')", ""]


@query(f"SELECT a, CASE WHEN a = '' OR list_contains(['now()', 'gen_random_uuid()', 'nextval(''s'')', 'uuid_generate_v4()'], a) THEN NULL ELSE a END AS b FROM {values([(x,) for x in DEFAULTS], 'a')}")
def sqlite_defaults(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in DEFAULTS], "a string").withColumn("b", S.sqlite_default(F.col("a")))


@query("SELECT event_id, ts AS at, NULL::TIMESTAMP AS other FROM events")
def json_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps out of JSON text; what is none is null."""
    doc = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.lit("soon").alias("other")))
    return load(spark, d, "events").withColumn("doc", doc).select("event_id", S.json_timestamp(F.col("doc"), "at").alias("at"), S.json_timestamp(F.col("doc"), "other").alias("other"))


@query("SELECT count(*) AS n, count(*) AS numbers, true AS rising FROM lineitem")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with gaps: all different, and from the offset on."""
    rows = layout.numbered(load(spark, d, "lineitem"), "id", offset=1000)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("numbers"), (F.min("id") >= 1000).alias("rising"))


@query("SELECT n_nationkey, n_name FROM nation")
def named_collection_table(spark: SparkSession, d: str) -> DataFrame:
    """A table whose options are kept under a name in the session."""
    named_collection(spark, "tidemark_files", path=place(spark, "collection"), format="parquet")
    spec = with_collection(spark, TableKind("file"), "tidemark_files")
    write(load(spark, d, "nation").select("n_nationkey", "n_name"), spec)
    return read(spark, spec)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def partial_unique_violations(spark: SparkSession, d: str) -> DataFrame:
    """A unique index over the rows that meet a predicate."""
    return audits.unique_violations(load(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def public_columns(spark: SparkSession, d: str) -> DataFrame:
    """Without the columns that are marked as private."""
    return layout.public_columns(layout.marked_private(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"]))


@query("SELECT count(*) AS past, count(*) FILTER (WHERE ts::DATE >= current_date) AS ahead FROM events")
def until_today(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").agg(F.count("*").alias("past"), F.count_if(F.to_date("ts") >= S.today()).alias("ahead"))


@query("""SELECT table_name AS "table", column_name AS name FROM duckdb_columns() WHERE table_name IN ('nation', 'region')""")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the session's catalog, of own tables only."""
    for t in ("nation", "region"):
        load(spark, d, t).createOrReplaceTempView(t)
    load(spark, d, "nation").createOrReplaceTempView("tidemark_lock")
    found = objects.own_objects(objects.catalog_objects(spark, pattern="nation|region|tidemark_lock"), ["nation", "region", "tidemark_lock"]).where("kind = 'column'").select("table", "name")
    for t in ("nation", "region", "tidemark_lock"):
        spark.catalog.dropTempView(t)
    return found


@query("SELECT o_orderpriority, count(*) AS customers FROM (SELECT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 50000 GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def refreshed_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Two materialized views of the catalog, the second over the first; both are stale and are refreshed in that order."""
    first, second = (f"tidemark_{x}_{place(spark, 'v')[-8:]}" for x in ("repeats", "counts"))
    stale = [
        refresh.RefreshedView(second, lambda s: s.table(first).groupBy("o_orderpriority").agg(F.count("*").alias("customers")), (first,)),
        refresh.RefreshedView(first, lambda s: load(s, d, "orders").where("o_totalprice > 50000").groupBy("o_orderpriority", "o_custkey").count().where("count > 1"), every=60),
    ]
    times = spark.createDataFrame([(second, "2024-01-01 00:00:00"), (first, "2024-01-01 00:00:00")], "name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    late = refresh.due(spark, stale, times, F.lit("2024-01-01 00:02:00").cast("timestamp_ntz"))
    assert late == [first, second] and refresh.due(spark, stale, times, F.lit("2024-01-01 00:00:30").cast("timestamp_ntz")) == []
    refresh.refresh(spark, stale, place(spark, "views"), late)
    rows = spark.read.parquet(spark.sql(f"DESCRIBE TABLE EXTENDED {second}").where("col_name = 'Location'").first()["data_type"])
    for name in (second, first):
        spark.sql(f"DROP TABLE {name}")
    return rows


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey <> 0")
def published_table(spark: SparkSession, d: str) -> DataFrame:
    """A catalog table replaced in one change; a view of it that was made before sees the new rows."""
    from tidemark.operators import dml

    n, name = load(spark, d, "nation"), f"tidemark_nation_{place(spark, 'v')[-8:]}"
    dml.publish(spark, name, n, place(spark, "published"))
    rows = spark.table(name)
    dml.publish(spark, name, dml.deleted(rows, F.col("n_regionkey") == 0).withColumn("n_name", F.upper("n_name")), place(spark, "published"))
    out = spark.read.parquet(spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]).select("n_nationkey", "n_name")
    spark.sql(f"DROP TABLE {name}")
    return out


PLURALS = [("add_column", "add_columns"), ("drop_index", "drop_indexes"), ("add_policy", "add_policies"), ("alter_pg_rls", "alter_pg_rls"), ("refresh_matview", "refresh_matviews"), ("create_table", "create_tables"), ("alter_key", "alter_keys")]


@query(f"SELECT a, b FROM {values(PLURALS, 'a, b')}")
def plural_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([p[:1] for p in PLURALS], "a string").withColumn("b", S.plural(F.col("a")))


NAMES = [("toDate(event_time) AS day", "day"), ("user_id", "user_id"), (" sum(x)  as  total ", "total"), ("CAST(a AS INT) AS b", "b"), ("count()", "count()")]


@query(f"SELECT a, b FROM {values(NAMES, 'a, b')}")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([n[:1] for n in NAMES], "a string").withColumn("b", S.output_name(F.col("a")))


@query("""SELECT 't' || p_partkey % 7 AS "table", 'c' || p_partkey AS name, CASE WHEN p_size > 20 THEN 'bigint' ELSE 'text' END AS type, p_size % 2 = 0 AS nullable FROM part""")
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """A schema written as two versions of a snapshot; the latest is found, checked and read back."""
    from tidemark.sources import files

    columns = load(spark, d, "part").select(F.concat(F.lit("t"), F.col("p_partkey") % 7).alias("table"), F.concat(F.lit("c"), "p_partkey").alias("name"), F.when(F.col("p_size") > 20, "bigint").otherwise("text").alias("type"), (F.col("p_size") % 2 == 0).alias("nullable"), F.lit(None).cast("string").alias("default"))
    at = place(spark, "snapshots")
    files.write_snapshot(files.snapshot_of(columns.where("name = 'c1'")), at, "0009")
    files.write_snapshot(files.snapshot_of(columns), at, "0010")
    return files.snapshot_columns(files.read_snapshot(spark, files.latest_snapshot(spark, at))).select("table", "name", "type", "nullable")


@query("SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY 1")
def sketches_are_near(spark: SparkSession, d: str) -> DataFrame:
    """Sketches, merged from the states of blocks, against the exact answers: counts of values within 5 %, the median within 2 % of the ranks."""
    e = load(spark, d, "events")
    sketches = [agg.uniq("user_id", "users"), agg.quantile("value", 0.5, "median")]
    states = state_table(e, {"event_type": F.col("event_type"), "block": F.col("event_id") % 5}, sketches)
    about = finalised(states, ["event_type"], sketches)
    exact = e.join(lookups.maybe_broadcast(about.select("event_type", "median")), "event_type").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"), (F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("share"))
    return exact.join(about, "event_type").select("event_type", (F.abs(F.col("users") - F.col("n")) <= 0.05 * F.col("n")).alias("users_near"), (F.abs(F.col("share") - 0.5) < 0.02).alias("median_near"))
