"""Aggregates with stored partial states.

Each aggregate is four expressions that agree: direct over rows; state over the rows of one block, to be stored; merge
over stored states, which gives a state again; and final, from a state to the answer. For every split of rows into
blocks, final(merge(states)) equals direct. States are plain columns, so partial aggregation, codegen and parquet work
on them. A state column carries its function's name as metadata; merging states of another function is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "tidemark.aggregate"


def _same(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class Aggregate:
    """name is the function with its arguments' types; alias the column of state and answer."""

    name: str
    alias: str
    direct: Column
    state: Column
    merge: Callable[[Column], Column]
    final: Callable[[Column], Column] = _same

    def named(self, alias: str) -> Aggregate:
        return Aggregate(self.name, alias, self.direct, self.state, self.merge, self.final)

    def state_column(self) -> Column:
        return self.state.alias(self.alias, metadata={META: self.name})


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class agg:  # noqa: N801  a namespace, written like the functions it holds
    """Constructors; x is a column or its name."""

    @staticmethod
    def sum(x: Column | str, alias: str = "sum") -> Aggregate:
        c = _column(x)
        return Aggregate("sum", alias, F.sum(c), F.sum(c), F.sum)

    @staticmethod
    def exact_sum(x: Column | str, alias: str = "sum", scale: int = 4) -> Aggregate:
        """Sum of doubles as decimals of a scale: the same in any order of rows and blocks."""
        d = F.sum(_column(x).cast(f"decimal(18,{scale})"))
        return Aggregate(f"exact_sum({scale})", alias, d.cast("double"), d, F.sum, lambda s: s.cast("double"))

    @staticmethod
    def avg(x: Column | str, alias: str = "avg") -> Aggregate:
        c = _column(x)
        return Aggregate("avg", alias, F.avg(c), F.struct(F.sum(c.cast("double")).alias("s"), F.count(c).alias("n")), lambda s: F.struct(F.sum(s["s"]).alias("s"), F.sum(s["n"]).alias("n")), lambda s: F.try_divide(s["s"], s["n"]))

    @staticmethod
    def count(alias: str = "count") -> Aggregate:
        return Aggregate("count", alias, F.count("*"), F.count("*"), F.sum)

    @staticmethod
    def count_if(condition: Column, alias: str = "count_if") -> Aggregate:
        return Aggregate("count_if", alias, F.count_if(condition), F.count_if(condition), F.sum)

    @staticmethod
    def sum_if(x: Column | str, condition: Column, alias: str = "sum_if") -> Aggregate:
        """The sum over rows that meet the condition; null without any."""
        c = F.sum(F.when(condition, _column(x)))
        return Aggregate("sum_if", alias, c, c, F.sum)

    @staticmethod
    def min(x: Column | str, alias: str = "min") -> Aggregate:
        return Aggregate("min", alias, F.min(_column(x)), F.min(_column(x)), F.min)

    @staticmethod
    def max(x: Column | str, alias: str = "max") -> Aggregate:
        return Aggregate("max", alias, F.max(_column(x)), F.max(_column(x)), F.max)

    @staticmethod
    def any(x: Column | str, alias: str = "any") -> Aggregate:
        """Some value that isn't null; which one is undefined."""
        return Aggregate("any", alias, F.any_value(_column(x), True), F.any_value(_column(x), True), lambda s: F.any_value(s, F.lit(True)))

    @staticmethod
    def any_last(x: Column | str, by: Column | str, alias: str = "any_last") -> Aggregate:
        """The value at the greatest by, which is kept in the state, so that blocks can be merged in any order."""
        c, o = _column(x), _column(by)
        state = F.max_by(F.struct(c.alias("x"), o.alias("o")), o)
        return Aggregate("any_last", alias, F.max_by(c, o), state, lambda s: F.max_by(s, s["o"]), lambda s: s["x"])

    @staticmethod
    def uniq_exact(x: Column | str, alias: str = "uniq_exact") -> Aggregate:
        c = _column(x)
        return Aggregate("uniq_exact", alias, F.count_distinct(c), F.collect_set(c), lambda s: F.array_distinct(F.flatten(F.collect_list(s))), F.size)

    @staticmethod
    def uniq(x: Column | str, alias: str = "uniq") -> Aggregate:
        """Approximate, by a HyperLogLog sketch of hashes: a state of bounded size however many values there are."""
        c = F.when(_column(x).isNotNull(), F.xxhash64(_column(x)))
        return Aggregate("uniq", alias, F.hll_sketch_estimate(F.hll_sketch_agg(c)), F.hll_sketch_agg(c), F.hll_union_agg, F.hll_sketch_estimate)

    @staticmethod
    def group_array(x: Column | str, alias: str = "group_array") -> Aggregate:
        """All values that aren't null, sorted, since the order of rows is undefined."""
        c = _column(x)
        return Aggregate("group_array", alias, F.array_sort(F.collect_list(c)), F.collect_list(c), lambda s: F.flatten(F.collect_list(s)), F.array_sort)

    @staticmethod
    def group_uniq_array(x: Column | str, alias: str = "group_uniq_array") -> Aggregate:
        c = _column(x)
        return Aggregate("group_uniq_array", alias, F.array_sort(F.collect_set(c)), F.collect_set(c), lambda s: F.array_distinct(F.flatten(F.collect_list(s))), F.array_sort)

    @staticmethod
    def quantile(x: Column | str, level: float = 0.5, alias: str = "quantile") -> Aggregate:
        """Approximate, by a KLL sketch; an item of the data whose rank is near."""
        c = _column(x).cast("double")
        return Aggregate(f"quantile({level})", alias, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c), F.lit(level)), F.kll_sketch_agg_double(c), F.kll_merge_agg_double, lambda s: F.kll_sketch_get_quantile_double(s, F.lit(level)))

    @staticmethod
    def quantile_exact(x: Column | str, level: float = 0.5, alias: str = "quantile_exact") -> Aggregate:
        """Interpolated. The state holds all values of a block, so it suits groups of few rows; of many, take quantile()."""
        c = _column(x).cast("double")

        def final(values: Column) -> Column:
            s = F.array_sort(values)
            at = (F.size(s) - 1) * F.lit(level)
            low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
            return low + (high - low) * (at - F.floor(at))

        return Aggregate(f"quantile_exact({level})", alias, F.percentile(c, F.lit(level)), F.collect_list(c), lambda s: F.flatten(F.collect_list(s)), final)

    @staticmethod
    def raw(direct: str, state: str, merge: str, final: str = "s", alias: str = "raw", name: str = "raw") -> Aggregate:
        """From SQL: direct and state over rows, merge over a state column named s, final over a merged state named s."""

        def put(sql: str) -> Callable[[Column], Column]:
            return lambda s: F.expr(sql.replace("{s}", "s")) if not isinstance(s, str) else F.expr(sql)

        return Aggregate(name, alias, F.expr(direct), F.expr(state), put(merge), put(final))


def state_table(rows: DataFrame, keys: dict[str, Column], aggregates: list[Aggregate]) -> DataFrame:
    """A row of states for each group of keys (name to expression)."""
    return rows.groupBy(*(e.alias(k) for k, e in keys.items())).agg(*(a.state_column() for a in aggregates))


def check_states(states: DataFrame, aggregates: list[Aggregate]) -> None:
    for a in aggregates:
        told = states.schema[a.alias].metadata.get(META)
        if told is not None and told != a.name:
            raise TypeError(f"column {a.alias} holds states of {told}, not of {a.name}")


def merged_states(states: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """States of the same keys as one: what a merging table keeps."""
    check_states(states, aggregates)
    out = states.groupBy(*keys).agg(*(a.merge(F.col(a.alias)).alias(a.alias) for a in aggregates))
    return out.select(*keys, *(F.col(a.alias).alias(a.alias, metadata={META: a.name}) for a in aggregates))


def finalised(states: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """The answers from states, merged first."""
    return merged_states(states, keys, aggregates).select(*keys, *(a.final(F.col(a.alias)).alias(a.alias) for a in aggregates))


def direct(rows: DataFrame, keys: dict[str, Column], aggregates: list[Aggregate]) -> DataFrame:
    return rows.groupBy(*(e.alias(k) for k, e in keys.items())).agg(*(a.direct.alias(a.alias) for a in aggregates))
