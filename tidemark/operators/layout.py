"""How tables lie on disk: partitions, sort keys, samples, expiry, skip indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_partitioned(rows: DataFrame, path: str, partition: dict[str, Column], order_by: list[str] = (), mode: str = "append", bloom: list[str] = (), codec: str = "zstd", files: int | None = None) -> None:
    """rows as parquet, a folder for each value of partition, sorted in each file so that its statistics skip.

    Rows are rebalanced by partition: a hot partition is split and small ones share a task, to files of about the session's
    advisory size, however large the table. files: instead, so many files for each partition, by a hash of the sort key.
    """
    by = list(partition)
    out = rows.withColumns(partition)
    if by:
        out = out.repartition(*by, F.pmod(F.xxhash64(*(order_by or rows.columns)), F.lit(files))) if files else out.hint("rebalance", *by)
    writer = out.sortWithinPartitions(*by, *order_by).write.mode(mode).option("compression", codec)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy(*by).parquet(path)


def hash_partition(columns: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def range_partition(column: Column, bounds: list[object]) -> Column:
    """The number of the range [bounds[i], bounds[i + 1]) a value is in, from 0 below the first bound."""
    out = F.lit(0)
    for i, b in enumerate(sorted(bounds), 1):
        out = F.when(column >= F.lit(b), F.lit(i)).otherwise(out)
    return F.when(column.isNotNull(), out)


def list_partition(column: Column, lists: dict[str, list[object]], default: str = "default") -> Column:
    out = F.lit(default)
    for name, values in lists.items():
        out = F.when(column.isin(values), F.lit(name)).otherwise(out)
    return out


def sampled(rows: DataFrame, key: Column, fraction: float, offset: float = 0.0) -> DataFrame:
    """Rows whose key's hash is in [offset, offset + fraction): whole keys, the same ones at every read and in every table."""
    spot = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") / float(1 << 16)
    return rows.where((spot >= offset) & (spot < offset + fraction))


def unexpired(rows: DataFrame, until: Column, now: Column) -> DataFrame:
    """Rows whose time to live hasn't passed; null lives on."""
    return rows.where(until.isNull() | (until > now))


def expired_columns(rows: DataFrame, until: dict[str, Column], now: Column) -> DataFrame:
    """rows with columns set to null once their time to live has passed."""
    return rows.withColumns({c: F.when(u.isNull() | (u > now), F.col(c)) for c, u in until.items()})


def computed(rows: DataFrame, materialized: dict[str, Column] = {}, default: dict[str, Column] = {}, ephemeral: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows as they are stored: defaults for nulls, computed columns added, input-only columns gone."""
    out = rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in default.items()}) if default else rows
    return out.withColumns(materialized).drop(*ephemeral) if materialized else out.drop(*ephemeral)


def numbered(rows: DataFrame, column: str, offset: int = 1) -> DataFrame:
    """rows with unique increasing numbers, with gaps: each partition counts for itself."""
    return rows.withColumn(column, F.monotonically_increasing_id() + offset)


def densely_numbered(rows: DataFrame, column: str, order_by: list[str], offset: int = 1) -> DataFrame:
    """rows numbered without gaps in an order. Ranges are sorted apart; only their sizes meet in one place."""
    parts = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}).checkpoint()
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = sizes.withColumn("__ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return parts.join(F.broadcast(ahead), "__part").withColumn(column, F.col("__row") - F.col("__first") + F.col("__ahead") + offset).drop("__part", "__row", "__first", "__ahead")


def move_partition(spark: SparkSession, table: str, partition: dict[str, object], to: str) -> None:
    """Detaches a partition's folder from a stored table, or, with table and to changed about, attaches it: a rename, no
    rows are read. Fails if there is no such partition or the target has it already."""
    files = spark._jvm.org.apache.hadoop.fs
    name = "/".join(f"{k}={v}" for k, v in partition.items())
    source, target = files.Path(f"{table}/{name}"), files.Path(f"{to}/{name}")
    there = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(source) or there.exists(target):
        raise ValueError(f"{name} can't be moved from {table} to {to}")
    there.mkdirs(target.getParent())
    there.rename(source, target)


def public_columns(rows: DataFrame, private: list[str] = ()) -> DataFrame:
    """rows without private columns: those named, and those whose metadata says so."""
    return rows.select(*(f.name for f in rows.schema.fields if f.name not in private and not (f.metadata or {}).get("private")))


def marked_private(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns marked as private; the mark is kept by projections and by tables."""
    return rows.select(*(F.col(f.name).alias(f.name, metadata={**(f.metadata or {}), "private": True}) if f.name in columns else F.col(f.name) for f in rows.schema.fields))
