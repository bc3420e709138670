"""Where source code names what a migration changes: lines that hold a table's or column's name, and references in syntax trees.

All names are one automaton, and each line is read once, whatever their number; no name is held against every line. Names of
more bytes than one automaton may have are dealt out over several.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship
from tidemark.sources.places import kept

#: Bytes of names that one automaton has; it takes some hundred times as much memory at most.
AUTOMATON_BYTES = 1 << 20
#: Characters told before and after a name.
AROUND = 30
#: What lines that are comments begin with.
COMMENTS = ("#", "//", "--", '"""', "'''")


def lines_of(sources: DataFrame) -> DataFrame:
    """(file, line, text) of sources (file, source), numbered from 1."""
    return sources.select("file", F.posexplode(F.split("source", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _named(lines: DataFrame, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            row, target, at = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                first: dict[str, int] = {}
                for end, name in automaton.iter(text or ""):
                    first.setdefault(name, end - len(name) + 1)
                row += [i] * len(first)
                target += first.keys()
                at += first.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(target, pa.string()), pa.array(at, pa.int32())], ["file", "line", "target", "at"])

    ship(lines.sparkSession)
    kinds = {c: lines.schema[c].dataType.simpleString() for c in ("file", "line")}
    return lines.select("file", "line", "low").mapInArrow(run, f"file {kinds['file']}, line {kinds['line']}, target string, at int")


def contained(lines: DataFrame, targets: DataFrame, comments: tuple[str, ...] = COMMENTS) -> DataFrame:
    """(file, line, target, at) of lines (file, line, text) that hold a target, in any case; at: its first place, from 0. Targets (target)
    are told in lower case; null and empty ones are in no line, and lines that are blank or begin as a comment hold none."""
    names = kept(targets.select(F.lower("target").alias("target")).where("target <> ''").distinct(), "targets")
    size = names.agg(F.sum(F.octet_length("target") + 1)).first()[0] or 0
    parts = max(1, -(-size // AUTOMATON_BYTES))
    bare = F.trim("text")
    code = lines.where(bare != "").where(~F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, comments)), lambda c: F.startswith(bare, c)), True), F.lit(False))) if comments else lines
    code = code.withColumn("low", F.lower("text"))
    out = None
    for k in range(parts):
        part = [r.target for r in names.where(F.pmod(F.xxhash64("target"), F.lit(parts)) == k).collect()]  # AUTOMATON_BYTES, about
        found = _named(code, part) if part else None
        out = found if out is None else out if found is None else out.unionByName(found)
    none = code.select("file", "line", F.lit("").alias("target"), F.lit(0).alias("at")).where("false")
    return none if out is None else out


def _references(tree: ast.AST) -> Iterator[tuple[str, int, str, str]]:
    """(kind, line, what is looked up, how it stands in the source)."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute):
            yield "attribute_access", node.lineno, node.attr.lower(), ast.unparse(node)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            yield "string_literal", node.lineno, node.value, repr(node.value)


def syntax_references(sources: DataFrame) -> DataFrame:
    """(file, kind, line, word, snippet) of Python sources (file, source): accessed attributes, in lower case, and texts. Sources that
    can't be parsed have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(file, *r) for r in _references(ast.parse(source or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], ["file", "kind", "line", "word", "snippet"])

    ship(sources.sparkSession)
    return sources.select(F.col("file").cast("string").alias("file"), "source").mapInArrow(run, "file string, kind string, line int, word string, snippet string")


def targets_of(ops: DataFrame, verbose: bool = False) -> DataFrame:
    """(op, table, name, target): what is looked for, for each of ops: its column and its table. Of ops with a severity only warnings and critical
    ones count, unless verbose."""
    kept_ops = ops if verbose or "severity" not in ops.columns else ops.where("severity IN ('WARN', 'WARNING', 'CRITICAL')")
    return kept_ops.select("op", "table", "name", F.explode(F.array_distinct(F.array("name", "table"))).alias("target")).where("target IS NOT NULL")


def impact(ops: DataFrame, lines: DataFrame, verbose: bool = False) -> DataFrame:
    """(op, table, name, file, line) of lines (file, line, text) that hold the column or the table of an operation."""
    targets = targets_of(ops, verbose)
    found = contained(lines, targets.select("target"))
    return targets.withColumn("target", F.lower("target")).join(found, "target").select("op", "table", "name", "file", "line").distinct()


def references(ops: DataFrame, sources: DataFrame, verbose: bool = False) -> DataFrame:
    """(op, table, name, file, line, kind, snippet): where sources (file, source) refer to what ops change. Attributes and texts are told by the
    syntax tree, other lines by their text, with what stands around the name; a line is told once for each target."""
    targets = targets_of(ops, verbose)
    words = syntax_references(sources)
    same = ((F.col("kind") == "attribute_access") & (F.col("word") == F.lower("target"))) | ((F.col("kind") == "string_literal") & (F.col("word") == F.col("target")))
    tree = targets.join(words.withColumn("key", F.lower("word")), F.lower("target") == F.col("key")).where(same).select("op", "table", "name", "target", "file", "line", "kind", "snippet").distinct()
    text = lines_of(sources.select(F.col("file").cast("string").alias("file"), "source")).withColumn("text", F.trim("text"))
    found = contained(text, targets.select("target")).withColumnRenamed("target", "low")
    shown = found.join(text, ["file", "line"])
    begin = F.greatest(F.lit(0), F.col("at") - AROUND)
    shown = shown.withColumn("snippet", F.trim(F.substr("text", begin + 1, F.col("at") + F.length("low") + AROUND - begin)))
    grep = targets.join(shown, F.lower("target") == F.col("low")).select("op", "table", "name", "target", "file", "line", F.lit("grep").alias("kind"), "snippet")
    grep = grep.join(tree.select("target", "file", "line").distinct(), ["target", "file", "line"], "left_anti")
    return tree.unionByName(grep.select(tree.columns)).drop("target").distinct()
