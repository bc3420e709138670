"""Codecs and low cardinality by column, as encodings of a stored table's columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codecs that store differences of values, those that compress what is stored, and those that change nothing here.
DELTA, PACKED, NONE = ("delta", "doubledelta"), ("zstd", "lz4", "lz4hc", "gzip", "deflate", "snappy", "none"), ("gorilla", "t64", "fpc", "default")
#: Compression in a table's files by the name of a codec.
COMPRESSION = {"zstd": "zstd", "lz4": "lz4_raw", "lz4hc": "lz4_raw", "gzip": "gzip", "deflate": "gzip", "snappy": "snappy", "none": "uncompressed"}


def codec_chain(text: str) -> list[tuple[str, int | None]]:
    """(name, argument) of each codec in a declaration such as CODEC(Delta, ZSTD(3)), or in the list within it."""
    inner = re.sub(r"(?is)^\s*codec\s*\((.*)\)\s*$", r"\1", text)
    found = [(m[1].lower(), int(m[2]) if m[2] else None) for m in re.finditer(r"(\w+)(?:\s*\(\s*(\d+)\s*\))?", inner)]
    for name, _ in found:
        if name not in DELTA + PACKED + NONE:
            raise ValueError(f"no such codec: {name}")
    return found


def repeating_columns(rows: DataFrame, share: float = 0.1) -> list[str]:
    """Columns with few different values for their number, by sketches made in one pass: at most this share of the rows."""
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    found = rows.agg(F.count("*").alias("__n"), *(F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(c) for c in plain)).first()
    return [c for c in plain if found[c] <= share * found["__n"]]


def writer_options(columns: list[str], codecs: dict[str, str], low_cardinality: list[str]) -> dict[str, str]:
    """Options of the writer: a dictionary for low-cardinality columns, none for others; differences for columns with a delta codec; the
    compression of the table is the last one that any chain names, at the highest level told, as files have one for all columns."""
    chains = {c: codec_chain(text) for c, text in codecs.items()}
    delta = {c for c, chain in chains.items() if any(name in DELTA for name, _ in chain)}
    both = delta & set(low_cardinality)
    if both:
        raise ValueError(f"a column has either a dictionary or differences: {', '.join(sorted(both))}")
    out = {f"parquet.enable.dictionary#{c}": str(c in low_cardinality).lower() for c in columns}
    if delta:
        out["parquet.writer.version"] = "v2"
    packed = [(name, level) for chain in chains.values() for name, level in chain if name in PACKED]
    if packed:
        out["compression"] = COMPRESSION[packed[-1][0]]
        levels = [level for name, level in packed if name == "zstd" and level is not None]
        if levels and out["compression"] == "zstd":
            out["parquet.compression.codec.zstd.level"] = str(max(levels))
    return out


def write_encoded(rows: DataFrame, path: str, codecs: dict[str, str] | None = None, low_cardinality: list[str] | None = None, share: float = 0.1) -> None:
    """Stores rows with encodings by column. Without low_cardinality, columns with few different values get a dictionary, but those with
    a delta codec. Columns of columns are encoded as the writer sees fit."""
    codecs = codecs or {}
    if low_cardinality is None:
        delta = {c for c, text in codecs.items() if any(name in DELTA for name, _ in codec_chain(text))}
        low_cardinality = [c for c in repeating_columns(rows, share) if c not in delta]
    rows.write.options(**writer_options(rows.columns, codecs, low_cardinality)).parquet(path)
