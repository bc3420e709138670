import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, ddl, dml, layout, lookups, objects, refresh, schema_diff
from tidemark.plans import analytics, schemas
from tidemark.sources.engines import TableKind, reader_options, split_args


def test_asof_join_against_brute_force(spark):
    r = random.Random(4)
    left = [(i, r.randrange(3), r.randrange(30)) for i in range(60)]
    right = [(r.randrange(3), r.randrange(30), i) for i in range(40)]
    got = lookups.asof_join(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, u int, v int"), ["k"], "t", "u", ["v"]).collect()
    for row in got:
        seen = [(u, v) for k, u, v in right if k == row.k and u <= row.t]
        assert row.v == (max(seen)[1] if seen else None)
    assert len(got) == len(left)


def test_asof_join_in_runs_against_brute_force(spark):
    """Runs of a hot key: some have no right row, some keys none before them."""
    r = random.Random(6)
    left = [(i, "hot" if i % 3 else "b", r.randrange(300)) for i in range(150)] + [(200, None, 4)]
    right = [("hot" if i % 4 else "c", r.choice([5, 40, 41, 170, 171, 290]), i) for i in range(40)]
    found = lookups.asof_join(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int"), ["k"], "t", "u", ["v"], lambda t: F.floor(t / 10))
    got = {row.i: row.v for row in found.collect()}
    assert got == {i: max(((u, v) for a, u, v in right if a == k and u <= t), default=(None, None))[1] for i, k, t in left}


@pytest.mark.parametrize("grid", [1, 5])
def test_range_lookup_lists_a_range_in_two_cells_at_most(spark, grid):
    r = random.Random(7)
    ranges = [(r.choice("ab"), lo := r.randrange(-500, 500), lo + r.choice([0, 3, 40, 10**6]), i) for i in range(40)]
    rows = [(i, r.choice("abc"), r.randrange(-600, 1500)) for i in range(200)]
    found = lookups.range_dict_get(spark.createDataFrame(rows, "i int, k string, at int"), spark.createDataFrame(ranges, "k string, lo int, hi int, v int"), "k", "at", "lo", "hi", ["v"], grid)
    got = {row.i: row.v for row in found.collect()}
    for i, k, at in rows:
        held = [(lo, v) for a, lo, hi, v in ranges if a == k and lo <= at <= hi]
        assert (got[i] is None and not held) or got[i] in {v for lo, v in held if lo == max(held)[0]}


def test_range_lookup_takes_the_range_that_starts_last_and_keeps_repeated_rows(spark):
    ranges = spark.createDataFrame([("a", 0, 100, "wide"), ("a", 40, 60, "narrow")], "k string, lo int, hi int, v string")
    rows = spark.createDataFrame([("a", 50), ("a", 50), ("a", 70), ("b", 1), (None, 1)], "k string, at int")
    for grid in (None, 7):
        got = lookups.range_dict_get(rows, ranges, "k", "at", "lo", "hi", ["v"], grid).collect()
        assert sorted((str(r.k), r.at, str(r.v)) for r in got) == [("None", 1, "None"), ("a", 50, "narrow"), ("a", 50, "narrow"), ("a", 70, "wide"), ("b", 1, "None")]


def test_large_lookup_tables_are_not_broadcast(spark):
    assert "BroadcastHint" not in lookups.maybe_broadcast(spark.range(10), most=1)._jdf.queryExecution().logical().toString()


def test_overlaps_finds_every_range_in_conflict_with_an_earlier_one(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), s := r.randrange(50), s + r.randrange(1, 12)) for i in range(40)]
    got = {x.id for x in audits.overlaps(spark.createDataFrame(rows, "i int, k int, lo int, hi int"), ["k"], "lo", "hi", "i").collect()}
    want = {b[0] for a in rows for b in rows if a[1] == b[1] and (a[2], a[3], a[0]) < (b[2], b[3], b[0]) and a[3] > b[2]}
    assert got == want


def test_overlaps_of_all_events_are_those_of_the_pairs(spark, sf, duck):
    want = duck.execute("""WITH r AS (SELECT event_id AS id, user_id, ts AS lo, ts + INTERVAL 2 HOUR AS hi FROM events)
        SELECT DISTINCT b.id FROM r a JOIN r b ON a.user_id = b.user_id AND a.hi > b.lo AND (a.lo, a.hi, a.id) < (b.lo, b.hi, b.id)""").fetchall()
    got = [r.id for r in analytics.exclude_overlaps_all(spark, sf).collect()]
    assert sorted(got) == sorted(i for (i,) in want) and any(i % 4 for i in got)


def test_policies_without_a_permissive_one_show_nothing(spark):
    assert audits.visible(spark.range(3), [], [F.lit(True)]).count() == 0


def test_checked_fails_on_a_bad_row(spark):
    with pytest.raises(Exception, match="too small"):
        audits.checked(spark.range(3), F.col("id") > 0, "too small").collect()


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    rows = lambda policy: sorted(map(tuple, dml.upserted(old, new, ["k"], policy).collect()))
    assert rows("update") == [(1, "a"), (2, "c"), (3, "e")]
    assert rows("ignore") == [(1, "a"), (2, "b"), (3, "e")]
    with pytest.raises(Exception, match="conflict on"):
        rows("error")


def test_swap_keeps_the_old_table_if_asked(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert dml.swap(spark, spark.range(3), at) is None
    kept = dml.swap(spark, spark.read.parquet(at).where("id > 0"), at, keep_old=True)
    assert spark.read.parquet(at).count() == 2 and spark.read.parquet(kept).count() == 3


def test_publish_changes_a_catalog_table_at_once(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert dml.publish(spark, "tidemark_published", spark.range(3), at) is None
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW tidemark_over AS SELECT id + 1 AS x FROM tidemark_published")
    kept = dml.publish(spark, "tidemark_published", spark.table("tidemark_published").where("id > 0"), at, keep_old=True)
    assert spark.table("tidemark_published").count() == 2 and spark.table("tidemark_over").count() == 2 and spark.read.parquet(kept).count() == 3
    spark.sql("DROP VIEW tidemark_over")
    spark.sql("DROP TABLE tidemark_published")


def test_a_large_partition_is_several_files_and_small_ones_are_one(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    rows = spark.range(60_000, numPartitions=16).select(F.when(F.col("id") < 57_000, "hot").otherwise((F.col("id") % 3).cast("string")).alias("p"), F.xxhash64("id").alias("x"))
    layout.write_partitioned(rows, f"file://{tmp_path}/t", {"p": F.col("p")}, ["x"])
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if old is None else spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "t").glob("p=*")}
    assert files["p=hot"] > 4 and all(files[f"p={k}"] == 1 for k in range(3))
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 60_000


def test_views_are_refreshed_after_those_they_depend_on():
    view = lambda name, *of: refresh.RefreshedView(name, None, of)
    assert [v.name for v in refresh.refresh_order([view("c", "b", "a"), view("b", "a"), view("a"), view("d", "outside")])] == ["a", "d", "b", "c"]
    with pytest.raises(ValueError, match="depend on each other"):
        refresh.refresh_order([view("a", "b"), view("b", "a"), view("c")])


def test_object_differences_of_single_changes(spark):
    """Every kind of change, one at a time, with its severity, and undone by the difference back."""
    table = ("table", "t", "t", {"engine": "MergeTree", "comment": "c"})
    cases = [
        (("column", "t", "a", {"type": "varchar(20)"}), ("column", "t", "a", {"type": "varchar(10)"}), [("alter_column_type", "a", "CRITICAL")]),
        (("column", "t", "a", {"type": "int"}), ("column", "t", "a", {"type": "bigint", "comment": "x"}), [("alter_column_comment", "a", "INFO"), ("alter_column_type", "a", "SAFE")]),
        (("column", "t", "a", {"type": "int", "default": "now()"}), ("column", "t", "a", {"type": "int4", "default": "CURRENT_TIMESTAMP"}), []),
        (("column", "t", "a", {"type": "int", "autoincrement": "true"}), None, [("drop_column", "a", "CRITICAL")]),
        (("index", "t", "i", {"columns": "a"}), ("index", "t", "i", {"columns": "a,b"}), [("add_index", "i", "INFO"), ("drop_index", "i", "WARN")]),
        (("unique", "t", "u", {"columns": "a,b"}), ("unique", "t", "v", {"columns": "b, a"}), [("rename_unique", "v", "INFO")]),
        (("check", "t", "k", {"expression": "a > 0"}), None, [("drop_check", "k", "WARN")]),
        (("exclude", "t", "x", {"expression": "e"}), ("exclude", "t", "x", {"expression": "f"}), [("add_exclude", "x", "INFO"), ("drop_exclude", "x", "WARN")]),
        (("foreign_key", "t", "f", {"columns": "a", "referenced_table": "s"}), ("foreign_key", "t", "g", {"columns": "a", "referenced_table": "s", "on_delete": "no action"}), []),
        (("foreign_key", "t", "f", {"columns": "a", "referenced_table": "s"}), ("foreign_key", "t", "f", {"columns": "a", "referenced_table": "s", "on_delete": "CASCADE"}), [("add_foreign_key", "f", "INFO"), ("drop_foreign_key", "f", "WARN")]),
        (("enum", "", "e", {"values": "a,b"}), ("enum", "", "e", {"values": "a,b,c"}), [("alter_enum", "e", "WARN")]),
        (("view", "", "w", {"select": "SELECT 1"}), ("view", "", "w", {"select": "SELECT 2"}), [("create_view", "w", "INFO"), ("drop_view", "w", "WARN")]),
        (None, ("table", "n", "n", {}), [("create_table", "n", "INFO")]),
        (("table", "n", "n", {"engine": "Log"}), ("table", "n", "n", {"engine": "Memory"}), [("recreate_table", "n", "WARN")]),
        (("table", "n", "n", {"settings": "a"}), ("table", "n", "n", {"settings": "b", "ttl": "x"}), [("alter_option", "settings", "WARN"), ("alter_option", "ttl", "INFO")]),
    ]
    # each case is a schema of its own, told apart by a number behind its tables' names
    apart = lambda x, k: (x[0], f"{x[1]}.{k}", f"{x[2]}.{k}" if x[0] == "table" else x[2], x[3])
    a, b = (spark.createDataFrame([apart(x, k) for k, case in enumerate(cases) for x in (table, case[side]) if x], objects.OBJECTS) for side in (0, 1))
    ops = objects.object_diff(a, b)
    found = ops.collect()
    got = [sorted((r.op, r.name.split(".")[0], r.severity) for r in found if r.table.endswith(f".{k}")) for k in range(len(cases))]
    assert got == [want for *_, want in cases]
    back = objects.object_diff(b, a).drop("severity")
    assert sorted(map(str, objects.undone(ops).collect())) == sorted(map(str, back.collect()))


def test_statements_of_every_operation(spark):
    column, table = {"type": "int", "nullable": "false", "default": "0"}, ("table", "t", "t", {"engine": "MergeTree"})
    old = [table, ("column", "t", "a", {"type": "int", "nullable": "true"}), ("column", "t", "gone", column), ("index", "t", "i", {"columns": "a"}), ("unique", "t", "u", {"columns": "a"}), ("foreign_key", "t", "f", {"columns": "a", "referenced_table": "s"}), ("view", "", "v", {"select": "SELECT 1"}), ("table", "m", "m", {"engine": "Log"}), ("enum", "", "e", {"values": "a"})]
    new = [("table", "t", "t", {"engine": "MergeTree", "comment": "it's", "ttl": "x"}), ("column", "t", "a", {"type": "bigint", "nullable": "false", "default": "1", "comment": "c"}), ("column", "t", "b", column), ("index", "t", "i", {"columns": "a", "unique": "true", "where": "a > 0"}), ("unique", "t", "w", {"columns": "a"}), ("check", "t", "k", {"expression": "a > 0"}), ("foreign_key", "t", "f", {"columns": "a", "referenced_table": "s", "referenced_columns": "id", "on_delete": "cascade"}), ("table", "n", "n", {}), ("column", "n", "x", column), ("table", "m", "m", {"engine": "Memory"}), ("column", "m", "x", column), ("enum", "", "e", {"values": "a,b"})]
    a, b = (spark.createDataFrame(x, objects.OBJECTS) for x in (old, new))
    ops = objects.object_diff(a, b)
    got = {r.sql for r in ddl.statements(ops, a, b).collect()}
    assert got == {
        "ALTER TABLE t SET (ttl = 'x')", "COMMENT ON TABLE t IS 'it''s'", "ALTER TABLE t ALTER COLUMN a TYPE bigint", "ALTER TABLE t ALTER COLUMN a SET NOT NULL", "ALTER TABLE t ALTER COLUMN a SET DEFAULT 1", "COMMENT ON COLUMN t.a IS 'c'",
        "ALTER TABLE t ADD COLUMN b INT NOT NULL DEFAULT 0", "ALTER TABLE t DROP COLUMN gone", "DROP INDEX i", "CREATE UNIQUE INDEX i ON t (a) WHERE a > 0", "ALTER TABLE t RENAME CONSTRAINT u TO w", "ALTER TABLE t ADD CONSTRAINT k CHECK (a > 0)",
        "ALTER TABLE t DROP CONSTRAINT f", "ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES s (id) ON DELETE CASCADE", "DROP VIEW v", "CREATE TABLE n (x INT NOT NULL DEFAULT 0)", "ALTER TYPE e ADD VALUE 'b'",
        "CREATE TABLE m__new (x INT NOT NULL DEFAULT 0); ALTER TABLE m RENAME TO m__old; ALTER TABLE m__new RENAME TO m",
    }
    with pytest.raises(Exception, match="drop_column of t.gone can't be undone"):
        objects.approved(ops, ops.where("false")).collect()
    assert objects.approved(ops, ops.where("op = 'drop_column'")).count() == ops.count()


def test_snapshots_are_whole_and_checked(spark, tmp_path):
    from tidemark.sources import files

    at = f"file://{tmp_path}/s"
    one = files.snapshot_of(spark.createDataFrame([("t", "a", "int", True, None)], "table string, name string, type string, nullable boolean, default string"))
    assert files.latest_snapshot(spark, at) is None
    for version in ("2", "10", "1.5"):
        files.write_snapshot(one, at, version)
    assert files.latest_snapshot(spark, at).endswith("snapshot_10")
    with pytest.raises(ValueError, match="there is a snapshot 2"):
        files.write_snapshot(one, at, "2")
    files.write_snapshot(one.withColumn("json", F.lit("{}")), at, "11")
    with pytest.raises(Exception, match="isn't what was written"):
        files.read_snapshot(spark, files.latest_snapshot(spark, at)).collect()


def test_samples_are_whole_keys_and_add_up(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 100)
    parts = [layout.sampled(rows, F.col("k"), 0.25, i / 4) for i in range(4)]
    assert sum(p.count() for p in parts) == 1000
    assert all(r["count"] == 10 for r in parts[0].groupBy("k").count().collect())


def test_dense_numbers_have_no_gaps(spark):
    got = layout.densely_numbered(spark.range(50).withColumn("x", F.col("id") % 5), "n", ["x", "id"]).orderBy("x", "id").collect()
    assert [r.n for r in got] == list(range(1, 51))


def test_diff_applied_leaves_no_diff(spark):
    new = schemas.new(spark)
    assert schema_diff.diff(new, new.unionByName(new.where("false"))).count() == 0


def test_cycles_have_no_level(spark):
    files = spark.createDataFrame([("1", []), ("2", ["3"]), ("3", ["2"])], "version string, depends_on array<string>")
    assert [(r.version, r.level) for r in schema_diff.dependency_order(files).collect()] == [("1", 0)]


def test_long_histories_are_ordered_whole(spark):
    files = [(f"{i:04}", [f"{i - 1:04}"] if i else []) for i in range(200)] + [("x", ["0003", "0150"])]
    files += [(f"d{i}{s}", [f"d{i - 1}a", f"d{i - 1}b"] if i else []) for i in range(60) for s in "ab"]  # 2 ** 59 paths
    got = {r.version: r.level for r in schema_diff.dependency_order(spark.createDataFrame(files, "version string, depends_on array<string>"), complete=True).collect()}
    assert got == {f"{i:04}": i for i in range(200)} | {"x": 151} | {f"d{i}{s}": i for i in range(60) for s in "ab"}


def test_versions_that_cant_be_ordered_are_an_error(spark):
    files = spark.createDataFrame([("1", None), ("2", ["3"]), ("3", ["2"]), ("4", ["1", "2"]), ("5", ["none"])], "version string, depends_on array<string>")
    assert [(r.version, r.level) for r in schema_diff.dependency_order(files).collect()] == [("1", 0)]
    with pytest.raises(ValueError, match="2, 3, 4, 5"):
        schema_diff.dependency_order(files, complete=True)


def test_columns_of_frames(spark):
    got = schema_diff.columns_of({"t": spark.range(1)}, spark).first()
    assert (got.table, got.name, got.type, got.nullable) == ("t", "id", "bigint", False)


def test_kind_declarations():
    assert split_args("'a,b', f(c, d), [1, 2]") == ["'a,b'", "f(c, d)", "[1, 2]"]
    for bad in ("NoSuchTree", "MergeTree("):
        with pytest.raises(ValueError):
            TableKind.parse(bad)


def test_connectors_keep_every_option():
    kafka = reader_options(TableKind("kafka", options={"broker_list": "h:1", "topic_list": "t", "group_name": "g", "format": "JSONEachRow", "max_block_size": 5}))
    assert kafka == ("kafka", {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "kafka.group.id": "g", "maxOffsetsPerTrigger": "5", "failOnDataLoss": "true"})
    login = {"host": "h", "database": "d", "table": "t", "user": "u", "password": "p"}
    assert reader_options(TableKind("mysql", options=login))[1]["url"] == "jdbc:mysql://h:3306/d"
    assert reader_options(TableKind("postgresql", options=login | {"port": 1, "numPartitions": 4, "partitionColumn": "id"}))[1]["numPartitions"] == "4"
    assert reader_options(TableKind("mongodb", options=login))[1]["collection"] == "t"
    assert reader_options(TableKind("redis", options={"host": "h"}))[1]["port"] == "6379"
    assert reader_options(TableKind("s3", options={"path": "s3a://b/x", "format": "CSVWithNames"})) == ("csv", {"header": "true"})
    assert reader_options(TableKind("s3_queue", options={"format": "JSONEachRow"}))[0] == "json"
    assert reader_options(TableKind("nats", options={"url": "n", "subjects": "s"})) == ("message_queue", {"client": "nats", "url": "n", "subjects": "s"})


def test_partitions_are_moved_without_reading(spark, tmp_path):
    at, away = f"file://{tmp_path}/t", f"file://{tmp_path}/away"
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(at)
    layout.move_partition(spark, at, {"p": 1}, away)
    assert spark.read.parquet(at).count() == 5 and spark.read.parquet(away).count() == 5
    layout.move_partition(spark, away, {"p": 1}, at)
    assert spark.read.parquet(at).count() == 10
    with pytest.raises(ValueError):
        layout.move_partition(spark, away, {"p": 1}, at)


def test_operations_without_a_statement_fail(spark):
    from tidemark.operators.render import rendered

    ops = spark.createDataFrame([("no_such_op", "t", "n", None)], "op string, table string, name string, detail string")
    with pytest.raises(Exception, match="no statement for"):
        rendered(ops).collect()


def test_overlap_of_alike_tables_is_told_for_each_of_them(spark):
    from tidemark.operators import schema_diff

    kinds = {"a": [("x", "int"), ("y", "int"), ("z", "text")], "b": [("x", "int"), ("y", "text")], "c": [("z", "text"), ("y", "int"), ("x", "int")], "d": [("x", "int"), ("x", "int"), (None, "int")]}
    tables = [{f"{side}{k}{i}": v for k, v in kinds.items() for i in range(4)} for side in "gn"]
    for t in tables:
        t["both"] = kinds["a"]
    old, new = (spark.createDataFrame([(t, n, 0, k, True, None) for t, of in side.items() for n, k in of], schema_diff.COLUMNS) for side in tables)
    want = {}
    for (a, x), (b, y) in ((p, q) for p in tables[0].items() for q in tables[1].items()):
        score = sum(m == n and m[0] is not None for m in x for n in y) / max(len(x), len(y))
        if "both" not in (a, b) and score >= 0.6:
            want[a, b] = score
    assert {(r.old_table, r.new_table): r.score for r in schema_diff.table_overlap(old, new).collect()} == pytest.approx(want)


def test_a_snapshot_has_a_row_for_each_table(spark):
    from tidemark.sources import files

    rows = [(f"t{i}", f"c{j}", "int", j > 0, None) for i in range(5) for j in range(3)]
    one = files.snapshot_of(spark.createDataFrame(rows, "table string, name string, type string, nullable boolean, default string"))
    assert one.count() == 5 and one.select("checksum").distinct().count() == 5
    assert sorted(map(tuple, files.snapshot_columns(one).collect())) == rows
