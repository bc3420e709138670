"""Table kinds: a specification for each, and what reading and writing one means here.

A kind is a name with options. Storage kinds map to a format and a path, integration kinds to a reader with its options;
kinds that merge rows map to the operators of merge_kinds. Every option given is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import merge_kinds
from tidemark.operators.lookups import union_of
from tidemark.sources import queues

#: Kinds by how they are read. merge: parquet, then the rows of a key merge. file: a format and a path.
#: jdbc and external: a connector that has to be installed. stream: only as a stream. local: in the session.
KINDS = {
    "merge": ("merge_tree", "replacing", "replicated", "summing", "aggregating", "collapsing", "versioned_collapsing", "graphite"),
    "file": ("s3", "file", "hdfs", "url", "log", "tiny_log", "stripe_log"),
    "jdbc": ("mysql", "postgresql"),
    "external": ("mongodb", "redis"),
    "stream": ("kafka", "s3_queue", "rabbitmq", "nats"),
    "local": ("null", "memory", "merge", "set", "join", "dictionary", "distributed", "buffer"),
}
FAMILY = {name: family for family, names in KINDS.items() for name in names}
#: Names of formats in declarations, and of the readers for them.
FORMATS = {"jsoneachrow": "json", "json": "json", "parquet": "parquet", "csv": "csv", "csvwithnames": "csv", "tsv": "csv", "tabseparated": "csv", "orc": "orc", "avro": "avro", "lineasstring": "text", "text": "text"}
#: Spellings of kinds in declarations.
SPELLED = {
    "MergeTree": "merge_tree", "ReplacingMergeTree": "replacing", "ReplicatedMergeTree": "replicated", "SummingMergeTree": "summing",
    "AggregatingMergeTree": "aggregating", "CollapsingMergeTree": "collapsing", "VersionedCollapsingMergeTree": "versioned_collapsing",
    "GraphiteMergeTree": "graphite", "Distributed": "distributed", "Kafka": "kafka", "S3": "s3", "S3Queue": "s3_queue", "RabbitMQ": "rabbitmq",
    "NATS": "nats", "MySQL": "mysql", "PostgreSQL": "postgresql", "MongoDB": "mongodb", "Redis": "redis", "URL": "url", "File": "file",
    "HDFS": "hdfs", "Null": "null", "Memory": "memory", "Merge": "merge", "Set": "set", "Join": "join", "Dictionary": "dictionary",
    "Log": "log", "TinyLog": "tiny_log", "StripeLog": "stripe_log", "Buffer": "buffer",
}


@dataclass(frozen=True)
class TableKind:
    kind: str
    args: tuple[str, ...] = ()
    options: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in FAMILY:
            raise ValueError(f"no such table kind: {self.kind}")

    @property
    def family(self) -> str:
        return FAMILY[self.kind]

    @classmethod
    def parse(cls, text: str) -> TableKind:
        """From a declaration such as ReplacingMergeTree(version): arguments are cut at commas outside of quotes and brackets."""
        m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
        if not m or m[1] not in SPELLED:
            raise ValueError(f"not a table kind: {text}")
        return cls(SPELLED[m[1]], tuple(split_args(m[2] or "")))


def split_args(text: str) -> list[str]:
    out, now, depth, quote = [], "", 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [*out, now.strip()] if now.strip() else out


def format_name(name: str) -> str:
    try:
        return FORMATS[name.lower()]
    except KeyError:
        raise ValueError(f"no reader for format {name}") from None


def reader_options(spec: TableKind) -> tuple[str, dict[str, str]]:
    """(format, options) of Spark's reader for a kind that lies outside of the session."""
    o = {k: v for k, v in spec.options.items() if v is not None}
    said = {k: str(v) for k, v in o.items()}
    if spec.family in ("file", "merge"):
        return (format_name(str(o.get("format", "parquet"))), {k: v for k, v in said.items() if k not in ("format", "path", "compression")} | ({"header": "true"} if str(o.get("format", "")).lower() == "csvwithnames" else {}))
    if spec.family == "stream" and ("client" in said or spec.kind in ("rabbitmq", "nats")):
        return "message_queue", {"client": spec.kind} | {k: v for k, v in said.items() if k != "format"}
    if spec.kind == "kafka":
        return "kafka", {"kafka.bootstrap.servers": said["broker_list"], "subscribe": said["topic_list"], **({"kafka.group.id": said["group_name"]} if "group_name" in said else {}), **({"maxOffsetsPerTrigger": said["max_block_size"]} if "max_block_size" in said else {}), "failOnDataLoss": "true"}
    if spec.kind == "s3_queue":
        return format_name(str(o.get("format", "json"))), {"maxFilesPerTrigger": said.get("max_files", "1000"), "latestFirst": "false"}
    if spec.family == "jdbc":
        port = said.get("port", "3306" if spec.kind == "mysql" else "5432")
        out = {"url": f"jdbc:{spec.kind}://{said['host']}:{port}/{said['database']}", "dbtable": said["table"], "user": said["user"], "password": said["password"]}
        return "jdbc", out | {k: said[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize") if k in said}
    if spec.kind == "mongodb":
        return "mongodb", {"connection.uri": f"mongodb://{said['user']}:{said['password']}@{said['host']}:{said.get('port', '27017')}", "database": said["database"], "collection": said["table"]}
    if spec.kind == "redis":
        return "org.apache.spark.sql.redis", {"host": said["host"], "port": said.get("port", "6379"), "keys.pattern": said.get("pattern", "*")}
    return spec.kind, said


def read(spark: SparkSession, spec: TableKind, schema: StructType | None = None, final: bool = True, **merge: object) -> DataFrame:
    """A batch table. Kinds that merge are merged with the arguments of their operator, unless final is false; of queues of sources.queues
    it is what they have now."""
    if spec.family == "stream" and reader_options(spec)[0] == "message_queue":
        return queues.parsed_messages(queues.messages(spark, **reader_options(spec)[1]), str(spec.options.get("format", "JSONEachRow")), schema)
    if spec.family == "stream":
        raise ValueError(f"{spec.kind} is read as a stream")
    if spec.kind == "memory":
        return spark.table(str(spec.options["name"]))
    if spec.kind == "merge":
        return merged_tables(spark, str(spec.options["tables"]), spec.options.get("database"))
    if spec.kind == "distributed":
        return union_of([spark.read.parquet(p) for p in spec.options["shards"]])
    source, options = reader_options(spec)
    reader = spark.read.format(source).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    rows = reader.load(str(spec.options["path"])) if "path" in spec.options else reader.load()
    return merge_kinds.optimised(spec.kind, rows, **merge) if final and spec.family == "merge" and merge else rows


def read_stream(spark: SparkSession, spec: TableKind, schema: StructType) -> DataFrame:
    """A stream. A queue's messages are parsed by the format and the schema; files are listed as they come. Kafka is read by Spark's own
    connector, or, with the option client, by the data source of sources.queues, as are the other queues."""
    source, options = reader_options(spec)
    if source == "message_queue":
        return queues.parsed_messages(queues.message_stream(spark, **options), str(spec.options.get("format", "JSONEachRow")), schema)
    if spec.kind == "kafka":
        return queues.parsed_messages(spark.readStream.format(source).options(**options).load(), str(spec.options.get("format", "JSONEachRow")), schema)
    return spark.readStream.format(source).options(**options).schema(schema).load(str(spec.options["path"]))


def write(rows: DataFrame, spec: TableKind, order_by: list[str] = (), partition_by: list[str] = ()) -> None:
    if spec.kind == "null":
        rows.write.format("noop").mode("append").save()
    elif spec.kind == "memory":
        rows.createOrReplaceTempView(str(spec.options["name"]))
    elif spec.kind == "distributed":
        shards = list(spec.options["shards"])
        spot = F.pmod(F.xxhash64(*spec.options["sharding_key"]), F.lit(len(shards)))
        for i, path in enumerate(shards):
            rows.where(spot == i).write.mode("append").parquet(path)
    elif spec.family in ("merge", "file"):
        source, options = reader_options(spec)
        out = rows.sortWithinPartitions(*partition_by, *order_by) if order_by else rows
        out.write.format(source).options(**options).mode("append").partitionBy(*partition_by).save(str(spec.options["path"]))
    elif spec.family == "jdbc":
        source, options = reader_options(spec)
        rows.write.format(source).options(**options).mode("append").save()
    else:
        raise ValueError(f"{spec.kind} can't be written to")


def merged_tables(spark: SparkSession, pattern: str, database: object = None) -> DataFrame:
    """All rows of the session's tables and views whose name matches."""
    names = sorted(t.name for t in (spark.catalog.listTables(str(database)) if database else spark.catalog.listTables()) if re.fullmatch(pattern, t.name))
    if not names:
        raise ValueError(f"no table matches {pattern}")
    return union_of([spark.table(n) for n in names])


def named_collection(spark: SparkSession, name: str, **entries: object) -> None:
    """Keeps options under a name in the session, for kinds that are declared without them, such as credentials."""
    for key, value in entries.items():
        spark.conf.set(f"tidemark.collection.{name}.{key}", str(value))


def with_collection(spark: SparkSession, spec: TableKind, name: str) -> TableKind:
    """spec with the options of a named collection beneath its own."""
    prefix = f"tidemark.collection.{name}."
    found = {k.removeprefix(prefix): v for k, v in spark.conf.getAll.items() if k.startswith(prefix)}
    if not found:
        raise ValueError(f"no named collection {name}")
    return TableKind(spec.kind, spec.args, found | spec.options)
