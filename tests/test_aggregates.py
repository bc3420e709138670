import pytest
from pyspark.sql import functions as F

from tidemark.functions.aggregates import agg, direct, finalised, merged_states, state_table
from tidemark.operators import merge_kinds
from tidemark.operators.rollup import AggregatingView, Projection, ViewRegistry, route


def everything():
    return [agg.sum("x", "sum"), agg.exact_sum("x", "exact"), agg.avg("x", "avg"), agg.count("n"), agg.count_if(F.col("x") > 2, "big"), agg.sum_if("x", F.col("k") == 1, "some"), agg.min("x", "lo"), agg.max("x", "hi"), agg.any_last("x", "t", "last"), agg.uniq_exact("x", "uniq"), agg.uniq("x", "about"), agg.group_array("x", "all"), agg.group_uniq_array("x", "distinct"), agg.quantile_exact("x", 0.25, "q")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i % 3, float(i % 7) if i % 5 else None, i) for i in range(200)], "k int, x double, t int")


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_merged_states_of_any_blocks_are_the_direct_answer(rows, parts):
    every, keys = everything(), {"k": F.col("k")}
    states = state_table(rows.withColumn("b", F.col("t") % parts), keys | {"b": F.col("b")}, every)
    got = finalised(merged_states(states, ["k"], every), ["k"], every).orderBy("k").collect()
    want = direct(rows, keys, every).orderBy("k").collect()
    for g, w in zip(got, want, strict=True):
        for name in g.asDict():
            assert g[name] == pytest.approx(w[name]) if isinstance(g[name], float) else g[name] == w[name], name


def test_states_of_another_function_are_refused(rows):
    states = state_table(rows, {"k": F.col("k")}, [agg.min("x", "v")])
    with pytest.raises(TypeError):
        finalised(states, ["k"], [agg.max("x", "v")])


def test_empty_input_gives_no_groups(rows):
    a = everything()
    assert finalised(state_table(rows.where("false"), {"k": F.col("k")}, a), ["k"], a).count() == 0


def test_sketch_quantile_is_near_in_rank(spark):
    a = [agg.quantile("id", 0.5, "m")]
    states = state_table(spark.range(10_000), {"b": F.col("id") % 8}, a)
    assert abs(finalised(states.withColumn("one", F.lit(1)), ["one"], a).first()["m"] - 5000) < 300


def test_merging_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, -1), (1, "b", 3, 1), (2, "c", 4, 1)], "k int, v string, s int, sign int")
    for f in (lambda d: merge_kinds.replacing(d, ["k"], "s"), lambda d: merge_kinds.summing(d, ["k"], ["s"]), lambda d: merge_kinds.collapsing(d, ["k"], "sign", "s"), lambda d: merge_kinds.deduplicated(d, ["k"], "s")):
        once = f(rows)
        assert sorted(map(tuple, f(once).collect())) == sorted(map(tuple, once.collect()))


def test_deleted_rows_go_when_newest(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "k int, s int, gone int")
    assert [r.k for r in merge_kinds.replacing(rows, ["k"], "s", deleted="gone").collect()] == [2]


def test_route_takes_the_smallest_projection_that_answers(rows):
    wide, narrow = Projection("wide", ("k", "t"), (agg.count("n"),)), Projection("narrow", ("k",), (agg.count("n"),))
    stored = [(p, p.build(rows)) for p in (wide, narrow)]
    assert route(rows, stored, ["k"], [agg.count("n")])[1] == "narrow"
    assert route(rows, stored, ["k"], [agg.count("n")], F.col("t") > 5, ("t",))[1] == "wide"
    assert route(rows, stored, ["k"], [agg.min("x", "n")])[1] is None


def test_view_rules(spark):
    view = AggregatingView("v", {"k": F.col("k")}, [agg.count("n")])
    registry = ViewRegistry()
    with pytest.raises(ValueError):
        registry.register(view, target_kind="merge_tree")
    assert registry.register(view, ("w",)) == ["v depends on unknown view w"]
    registry.register(AggregatingView("w", {"k": F.col("k")}, [agg.count("n")]), ("v",))
    with pytest.raises(ValueError):
        registry.order()
    with pytest.raises(ValueError):
        AggregatingView("bad", {"n": F.col("k")}, [agg.count("n")])


def test_populate_refuses_a_table_that_holds_states(rows, tmp_path):
    view = AggregatingView("v", {"k": F.col("k")}, [agg.count("n")])
    view.populate(rows, f"file://{tmp_path}/v")
    with pytest.raises(ValueError):
        view.populate(rows, f"file://{tmp_path}/v")
