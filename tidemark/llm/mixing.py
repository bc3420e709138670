"""Mixing sources to target weights: pivotal dependent rounding in a distributed reduction tree, in DataFrame functions only.

A source's target divided by its size gives the copies that each of its documents has in the mean; the whole copies are
given at once, and what remains is a mass in words below the document's size. The pivotal step takes two documents with
such masses and moves words from one to the other, in a direction drawn so that each keeps its mean, until one of them
has none or all of its words. Documents are dealt out in slices that one array function folds; each slice leaves one
undecided document, and the slices' residuals are folded again until each source has one, which goes to its nearer bound.
So a source's words differ from its target by at most half of its last residual document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, sent, written

#: Documents that one fold takes.
SLICE = 128
#: Repeated rows that are told apart at a time.
REPEATS = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """sizes with rank: from 0 in code point order of source, null last.

    Sources are sorted over many partitions; a partition's first rank is the number of sources in those before it, so
    what one task gathers, in the window, is a row for each partition.
    """
    ordered = written(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "sources",
    )
    before = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = before.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("row") - F.col("first") + F.col("offset")).drop("part", "row", "first", "offset", "n")


def shares(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by rank and share all words; a target stops at cap
    times its source's size, and the excess is shared again by weight until none is above. Each round is one sum over the sources."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = source_ranks(sizes).withColumn("weight", weight)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, most = 0.0, F.col("source_size") * F.lit(float(cap))
    while True:
        full = (F.col("weight") * level >= most) & (F.lit(level) > 0)
        left, free = ranked.agg(total - F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        new = left / free if free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("source", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def draw(seed: int, *of: Column) -> Column:
    """A number from 0 to 1, the same at every run for the same values."""
    return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")


def folded(items: DataFrame, level: int, seed: int, fan: int = SLICE) -> DataFrame:
    """A level of the tree: (source, slice, done, rest) from (source, slice, item); item: (size, draw, doc, copies, mass).
    Large documents meet first, near their own size, so that what is left undecided tends to be small.

    rest is the one item of a slice whose mass is neither 0 nor its size, null if there is none; done holds the others.
    """
    arrays = items.groupBy("source", "slice").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    kind = items.schema["item"].dataType.simpleString()

    def step(state: Column, item: Column) -> Column:
        a, b = state["rest"], item
        both = a["mass"] + b["mass"]
        # a ends at one bound and b at another: up moves words to a, down moves words to b, as far as either can go
        up, down = F.least(a["size"] - a["mass"], b["mass"]), F.least(a["mass"], b["size"] - b["mass"])
        moved = F.when(draw(seed + level, a["draw"], b["draw"]) * (up + down) < down, up).otherwise(-down)
        mass_a = F.when(moved > 0, F.when(a["size"] - a["mass"] <= b["mass"], a["size"]).otherwise(both)).otherwise(F.when(a["mass"] <= b["size"] - b["mass"], F.lit(0.0)).otherwise(both - b["size"]))
        new_a = F.named_struct(F.lit("size"), a["size"], F.lit("draw"), a["draw"], F.lit("doc"), a["doc"], F.lit("copies"), a["copies"], F.lit("mass"), mass_a)
        new_b = F.named_struct(F.lit("size"), b["size"], F.lit("draw"), b["draw"], F.lit("doc"), b["doc"], F.lit("copies"), b["copies"], F.lit("mass"), both - mass_a)
        whole_a = (new_a["mass"] <= 0) | (new_a["mass"] >= a["size"])
        whole_b = (new_b["mass"] <= 0) | (new_b["mass"] >= b["size"])
        return (
            F.when((b["mass"] <= 0) | (b["mass"] >= b["size"]), F.struct(F.concat(state["done"], F.array(b)).alias("done"), a.alias("rest")))
            .when(a.isNull(), F.struct(state["done"].alias("done"), b.alias("rest")))
            .when(whole_a & whole_b, F.struct(F.concat(state["done"], F.array(new_a, new_b)).alias("done"), F.lit(None).cast(kind).alias("rest")))
            .when(whole_a, F.struct(F.concat(state["done"], F.array(new_a)).alias("done"), new_b.alias("rest")))
            .otherwise(F.struct(F.concat(state["done"], F.array(new_b)).alias("done"), new_a.alias("rest")))
        )

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("rest"))
    return arrays.select("source", "slice", F.aggregate("items", start, step).alias("out")).select("source", "slice", "out.done", "out.rest")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of docs; taken = copies * size.

    Size is the number of words; null and empty texts have 0, and take 0. Null is a source of its own, the last one.
    Repeated rows are separate documents: rows of one id, source and size are counted first and told apart by a number, so
    that any number of them is dealt out over the slices. An empty table gives an empty result. Columns beside the three
    are ignored. Reruns agree: draws are hashes of seed, id, size and number.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    rows = written(rows.groupBy("doc", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("rows"))
    # shares() writes them: the sums are made once
    targets = written(shares(sizes, weights, cap), "targets")
    most = sizes.agg(F.max("rows")).first()[0] or 0
    # slices are dealt by a hash of the document, so a hot source is as many rows here as it has slices
    per = F.broadcast(targets) if targets.count() <= 100_000 else targets
    thousands = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / REPEATS))
    rows = rows.select("doc", "source", "size", "rows", F.explode(thousands).alias("part"))
    numbers = F.sequence(F.col("part") * REPEATS, F.least(F.col("rows"), (F.col("part") + 1) * REPEATS) - 1)
    rows = rows.select("doc", "source", "size", F.explode(numbers).alias("nth"))
    known = rows.join(per, rows.source.eqNullSafe(targets.source)).select(rows.source, "doc", "size", "nth", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    known = known.withColumn("ratio", ratio).withColumn("copies", F.floor("ratio")).withColumn("mass", (F.col("ratio") - F.col("copies")) * F.col("size"))
    count = F.ceil(F.lit(most) / SLICE)
    item = F.struct(F.col("size").cast("double").alias("size"), draw(seed, F.col("doc"), F.col("size"), F.col("nth")).alias("draw"), "doc", "copies", "mass")
    items = known.select("source", F.pmod(F.xxhash64(F.lit(seed), "doc", "size", "nth"), count).alias("slice"), item.alias("item"))
    levels, slices, level = [], max(1, -(-most // SLICE)), 0
    while True:
        now = written(folded(items, level, seed), f"level{level}")
        levels.append(now.select("source", F.explode("done").alias("item")))
        if slices == 1:
            break
        slices = -(-slices // SLICE)
        items = now.where("rest IS NOT NULL").select("source", F.pmod(F.col("slice"), F.lit(slices)).alias("slice"), F.col("rest").alias("item"))
        level += 1
    last = now.where("rest IS NOT NULL").select("source", "rest").withColumn("all", F.col("rest.size") < 2 * F.col("rest.mass"))
    levels.append(last.select("source", F.col("rest").withField("mass", F.when(F.col("all"), F.col("rest.size")).otherwise(0.0)).alias("item")))
    decided = reduce(DataFrame.unionByName, levels).select("source", F.col("item.doc").alias(id_col), F.col("item.size").cast("long").alias("size"), (F.col("item.copies") + F.when((F.col("item.size") > 0) & (F.col("item.mass") >= F.col("item.size")), 1).otherwise(0)).alias("copies"))
    return decided.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken, as mix() has them; columns of docs of these names give way.

    Rows of one id, source and text have the same claim, whether ids are null or not: the copies that these take together are
    dealt to them evenly, in an order of their other columns' hash. Only sizes and ids are shuffled unless ids are too many to broadcast.
    """
    keyed = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h")).alias("key"), docs[source_col].alias("source"), docs[text_col].alias("text"), F.struct("*").alias("row"))
    found = mix(keyed, id_col="key", text_col="text", source_col="source", **options)
    per = found.groupBy(F.col("key").alias("of"), F.col("source").alias("from")).agg(F.count("*").alias("rows"), F.sum("copies").alias("all"), *(F.any_value(c).alias(c) for c in ("size", "source_size", "target")))
    same = F.col("key.id").eqNullSafe(F.col("of.id")) & (F.col("key.h") == F.col("of.h")) & F.col("source").eqNullSafe(F.col("from"))
    rows = keyed.join(sent(per, "copies", 96), same)
    # rows that are equal in all columns are one with a count, and spread out again by thousands
    held = [F.any_value(c).alias(c) for c in ("row", "all", "rows", "size", "source_size", "target")]
    alike = rows.where("rows > 1").groupBy("key", "source", F.xxhash64(F.to_json("row")).alias("content")).agg(F.count("*").alias("times"), *held)
    alike = alike.withColumn("before", F.sum("times").over(Window.partitionBy("key", "source").orderBy("content")) - F.col("times"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS)))).repartition("key", "content", "part")
    numbers = F.sequence(F.col("part") * REPEATS, F.least(F.col("times"), (F.col("part") + 1) * REPEATS) - 1)
    spread = parts.withColumn("at", F.explode(numbers)).withColumn("nth", F.col("before") + F.col("at") + 1)
    copies = F.floor((F.col("all") + F.col("rows") - F.col("nth")) / F.col("rows"))
    kept = ["row", "all", "rows", "size", "source_size", "target", "nth"]
    nth = rows.where("rows = 1").withColumn("nth", F.lit(1).cast("long")).select(*kept).unionByName(spread.select(*kept))
    new = ["size", "source_size", "target", "copies", "taken"]
    return nth.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new)
