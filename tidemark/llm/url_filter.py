"""URL filters: a sort-merge range join of urls with nested host and path rules, in DataFrame functions only.

A rule holds for its host, all subdomains, and every path that starts with its own. With hosts reversed label by label
(org.example. for example.org) and a rule's path behind, a rule is the interval of the keys that start with its key: it
opens at its key and closes behind the last one that starts so. A url has one key under each suffix of its host that is a
rule's. Openings, closings and urls are sorted and swept once. Intervals are nested or apart, so the number of open ones is
the height of the stack, a running sum, and its top is the last rule that was opened at this height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Least number of urls that one sorted sweep takes; a host's sweeps take four times its rules where that is more.
SLICE = 2_000


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z in lower case; without ://, or null, empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_keys(host: Column) -> Column:
    """The reversed host and each of its parents: org., org.example., org.example.www. for www.example.org; none for the empty host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def distinct_rules(rules: DataFrame) -> DataFrame:
    """(key, path, rule, verdict) of each distinct host and path. Of several rules for one, block wins over allow."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
        .groupBy(F.lower("host").alias("rule_host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.element_at(suffix_keys(F.col("rule_host")), -1).alias("key"), "path", F.concat("rule_host", "path").alias("rule"), "verdict")
    )


def judged(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """keys with rule and verdict; keys: distinct (host, path). Both new columns are null where no rule holds."""
    rules = written(distinct_rules(rules), "rules")
    urls = keys.select("host", "path", F.explode(suffix_keys(F.col("host"))).alias("key"))
    # only suffixes that are a rule's host go on; each host's urls are dealt out in slices that all get its rules, few against the urls
    per_host = rules.groupBy("key").agg(F.count("*").alias("rules"))
    counted = urls.groupBy("key").agg(F.count("*").alias("urls")).join(per_host, "key")
    slices = written(counted.select("key", F.ceil(F.col("urls") / F.greatest(F.lit(SLICE), 4 * F.col("rules"))).alias("slices")), "slices")
    # places are bytes: no text has the byte FF, so an interval closes behind all that start as it does, and before what follows them
    place, none = F.col("path").cast("binary"), F.lit(None).cast("string")
    points = urls.join(slices, "key").select("key", F.pmod(F.xxhash64("host", "path"), F.col("slices")).alias("slice"), place.alias("place"), F.lit(1).alias("turn"), "host", "path", none.alias("rule"), none.alias("verdict"))
    dealt = rules.join(slices, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "path", "rule", "verdict")
    opens = dealt.select("key", "slice", place.alias("place"), F.lit(0).alias("turn"), none.alias("host"), none.alias("path"), "rule", "verdict")
    closes = dealt.select("key", "slice", F.concat(place, F.lit(b"\xff")).alias("place"), F.lit(-1).alias("turn"), none.alias("host"), none.alias("path"), none.alias("rule"), none.alias("verdict"))
    change = F.when(F.col("turn") == 0, 1).when(F.col("turn") == -1, -1).otherwise(0)
    swept = Window.partitionBy("key", "slice").orderBy("place", "turn")
    height = F.sum(change).over(swept.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stack = Window.partitionBy("key", "slice", "height").orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("turn") == 0, F.struct(F.length("rule").alias("size"), "verdict", "rule")), ignorenulls=True).over(stack)
    held = points.unionByName(opens).unionByName(closes).withColumn("height", height).where("height > 0").withColumn("top", top).where("turn = 1")
    return held.groupBy("host", "path").agg(F.max("top").alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, rule, verdict) for every row of pages.

    rules: (host, path, verdict); the longest that holds decides (length of host and path; block on a tie), and default
    where none does. A rule's host may be org or blog.example.org; null and host-less rules hold for nothing.
    Null urls and urls without :// have empty host and path, no rule and the default. Repeated rows are kept; a url is
    judged once however often it is listed. Columns beside the two are ignored.
    """
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    verdicts = judged(rows.select("host", "path").where("host <> ''").distinct(), rules)
    return rows.join(verdicts, ["host", "path"], "left").select(id_col, "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
