"""Message queues as a data source: Kafka, NATS and RabbitMQ streams, and a spool of messages in a shared folder.

A queue is topics with partitions of numbered messages. One data source reads all of them, as a batch or as a stream: a
client tells where partitions begin and end, and fetches a range of numbers, again if need be. A stream's offsets are these
numbers, so a block that is run again after a failure has the same messages, and none is lost or comes twice. What has been
read is told to the queue's consumer group, for those who watch it; where a stream goes on is in its own checkpoint.
Ranges of many messages are read by several tasks. Clients of brokers need their Python packages; the spool needs none.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.shipping import ship

MESSAGES = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
SEGMENT = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("offset", pa.int64()), ("timestamp", pa.int64())])
#: Messages that one task reads.
TASK_MESSAGES = 100_000
#: Seconds without a message after which a broker that should have one is taken for failed.
PATIENCE = 30.0

#: (key, value, offset, microseconds since 1970)
Message = tuple[bytes | None, bytes | None, int, int]
#: Offsets by `topic/partition`.
Offsets = dict[str, int]


class Spool:
    """Messages as files in a folder that all executors share: `<path>/<topic>/<partition>/<first>-<end>.arrow`.

    Options: path, topics (comma-separated). A segment is written under another name and renamed, so it is there whole or not at all.
    """

    def __init__(self, options: Mapping[str, str]):
        self.fs, self.root = pa.fs.FileSystem.from_uri(options["path"])
        self.topics = [t.strip() for t in options["topics"].split(",")]

    def _listed(self, path: str) -> list[pa.fs.FileInfo]:
        return self.fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))

    def segments(self, partition: str) -> list[tuple[int, int, str]]:
        """(first, end, path) in order."""
        files = [f for f in self._listed(f"{self.root}/{partition}") if f.base_name.endswith(".arrow")]
        return sorted((*map(int, f.base_name.removesuffix(".arrow").split("-")), f.path) for f in files)

    def bounds(self) -> tuple[Offsets, Offsets]:
        first, end = {}, {}
        for topic in self.topics:
            for folder in self._listed(f"{self.root}/{topic}"):
                if folder.type == pa.fs.FileType.Directory and folder.base_name.isdigit():
                    found = self.segments(name := f"{topic}/{folder.base_name}")
                    if found:
                        first[name], end[name] = found[0][0], found[-1][1]
        return first, end

    def fetch(self, partition: str, start: int, end: int) -> Iterator[Message]:
        for first, last, path in self.segments(partition):
            if first < end and start < last:
                with self.fs.open_input_file(path) as f, pa.ipc.open_file(f) as segment:
                    at = first
                    for i in range(segment.num_record_batches):
                        batch = segment.get_batch(i)
                        part = batch.slice(max(0, start - at), max(0, end - max(start, at)))
                        at += batch.num_rows
                        for row in part.to_pylist():
                            yield row["key"], row["value"], row["offset"], row["timestamp"]

    def commit(self, offsets: Offsets) -> None:
        pass

    def close(self) -> None:
        pass


class Kafka:
    """By the package kafka-python. Options: broker_list, topic_list, group_name, and consumer.<name> for any of the consumer's own."""

    def __init__(self, options: Mapping[str, str]):
        import kafka

        self.kafka, self.topics = kafka, [t.strip() for t in options["topic_list"].split(",")]
        own = {k.removeprefix("consumer."): v for k, v in options.items() if k.startswith("consumer.")}
        self.consumer = kafka.KafkaConsumer(bootstrap_servers=options["broker_list"].split(","), group_id=options.get("group_name"), enable_auto_commit=False, **own)

    def _partition(self, name: str) -> Any:
        topic, _, number = name.rpartition("/")
        return self.kafka.TopicPartition(topic, int(number))

    def bounds(self) -> tuple[Offsets, Offsets]:
        names = {self.kafka.TopicPartition(t, p): f"{t}/{p}" for t in self.topics for p in sorted(self.consumer.partitions_for_topic(t) or ())}
        told = lambda offsets: {names[p]: n for p, n in offsets.items()}
        return told(self.consumer.beginning_offsets(list(names))), told(self.consumer.end_offsets(list(names)))

    def fetch(self, partition: str, start: int, end: int) -> Iterator[Message]:
        at = self._partition(partition)
        self.consumer.assign([at])
        self.consumer.seek(at, start)
        heard = time.monotonic()
        # compacted topics have gaps: the range is read once the consumer's position is at its end
        while self.consumer.position(at) < end:
            for m in self.consumer.poll(timeout_ms=1000, max_records=500).get(at, ()):
                heard = time.monotonic()
                if m.offset < end:
                    yield m.key, m.value, m.offset, m.timestamp * 1000
            if time.monotonic() - heard > PATIENCE:
                raise TimeoutError(f"no messages of {partition} from {self.consumer.position(at)} to {end}")

    def commit(self, offsets: Offsets) -> None:
        if self.consumer.config["group_id"]:
            self.consumer.commit({self._partition(p): self.kafka.OffsetAndMetadata(n, "", -1) for p, n in offsets.items()})

    def close(self) -> None:
        self.consumer.close()


class Nats:
    """JetStream by the package nats-py. Options: url, subjects (comma-separated), stream. A stream is one partition; a subject
    is its topic."""

    def __init__(self, options: Mapping[str, str]):
        import asyncio

        import nats

        self.loop, self.nats, self.stream = asyncio.new_event_loop(), nats, options["stream"]
        self.subjects = [s.strip() for s in options["subjects"].split(",")]
        self.connection = self._wait(nats.connect(options["url"].split(",")))
        self.jetstream = self.connection.jetstream()

    def _wait(self, what: Any) -> Any:
        return self.loop.run_until_complete(what)

    def bounds(self) -> tuple[Offsets, Offsets]:
        state = self._wait(self.jetstream.stream_info(self.stream)).state
        return {f"{self.stream}/0": max(1, state.first_seq)}, {f"{self.stream}/0": state.last_seq + 1}

    def fetch(self, partition: str, start: int, end: int) -> Iterator[Message]:
        from nats.js.api import AckPolicy, ConsumerConfig, DeliverPolicy

        config = ConsumerConfig(deliver_policy=DeliverPolicy.BY_START_SEQUENCE, opt_start_seq=start, ack_policy=AckPolicy.NONE, filter_subjects=self.subjects)
        consumer = self._wait(self.jetstream.pull_subscribe("", stream=self.stream, config=config))
        left = True
        while left:
            try:
                found = self._wait(consumer.fetch(500, timeout=5))
            except self.nats.errors.TimeoutError:  # none are left; those between were of other subjects or deleted
                break
            for m in found:
                if (at := m.metadata.sequence.stream) >= end:
                    left = False
                    break
                yield m.subject.encode(), m.data, at, int(m.metadata.timestamp.timestamp() * 1e6)
                left = at < end - 1
        self._wait(consumer.unsubscribe())

    def commit(self, offsets: Offsets) -> None:
        pass

    def close(self) -> None:
        self._wait(self.connection.close())
        self.loop.close()


class RabbitMq:
    """Stream queues, which number their messages, by the package pika. Options: host (or url), queue, exchange_name and routing_key to
    bind it. Classic queues forget what was read and so can't be read again after a failure: declare a stream."""

    def __init__(self, options: Mapping[str, str]):
        import pika

        self.queue = options["queue"]
        self.connection = pika.BlockingConnection(pika.URLParameters(options["url"]) if "url" in options else pika.ConnectionParameters(options["host"]))
        self.channel = self.connection.channel()
        self.channel.queue_declare(self.queue, durable=True, arguments={"x-queue-type": "stream"})
        if "exchange_name" in options:
            self.channel.queue_bind(self.queue, options["exchange_name"], options.get("routing_key", ""))
        self.channel.basic_qos(prefetch_count=500)

    def _from(self, place: int | str, wait: float) -> Iterator[tuple[int, Any, bytes]]:
        """(number, properties, body) from a place on, until none has come for a while."""
        for method, properties, body in self.channel.consume(self.queue, arguments={"x-stream-offset": place}, inactivity_timeout=wait):
            if method is None:
                break
            self.channel.basic_ack(method.delivery_tag)
            yield int(properties.headers["x-stream-offset"]), properties, body
        self.channel.cancel()

    def bounds(self) -> tuple[Offsets, Offsets]:
        first = next((n for n, _, _ in self._from("first", 1.0)), 0)
        self.channel.cancel()
        last = max((n for n, _, _ in self._from("last", 1.0)), default=first - 1)
        return {f"{self.queue}/0": first}, {f"{self.queue}/0": last + 1}

    def fetch(self, partition: str, start: int, end: int) -> Iterator[Message]:
        for n, properties, body in self._from(start, PATIENCE):
            if start <= n < end:
                yield (properties.message_id or "").encode() or None, body, n, int((properties.timestamp or 0) * 1_000_000)
            if n >= end - 1:
                self.channel.cancel()
                return
        raise TimeoutError(f"no messages of {partition} up to {end}")

    def commit(self, offsets: Offsets) -> None:
        pass

    def close(self) -> None:
        self.connection.close()


CLIENTS = {"spool": Spool, "kafka": Kafka, "nats": Nats, "rabbitmq": RabbitMq}


class Range(InputPartition):
    def __init__(self, partition: str, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


def ranges(start: Offsets, end: Offsets, first: Offsets, size: int = TASK_MESSAGES) -> list[Range]:
    """What lies between two offsets, a task's messages each. A partition that start doesn't know begins where the queue has it begin."""
    out = []
    for p, e in sorted(end.items()):
        s = start.get(p, first.get(p, 0))
        out += [Range(p, a, min(e, a + size)) for a in range(s, e, size)]
    return out


class _Reading:
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.client = None

    def connected(self) -> Any:
        if self.client is None:
            self.client = CLIENTS[self.options["client"]](self.options)
        return self.client

    def __getstate__(self) -> dict:
        return self.__dict__ | {"client": None}

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a batch without ranges is read by one task
            return
        topic, _, number = partition.partition.rpartition("/")
        client, rows = CLIENTS[self.options["client"]](self.options), []
        schema = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))])

        def batch() -> pa.RecordBatch:
            key, value, offset, at = (list(c) for c in zip(*rows, strict=True))
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(value, pa.binary()), pa.array([topic] * n), pa.array([int(number)] * n, pa.int32()), pa.array(offset, pa.int64()), pa.array(at, pa.timestamp("us", "UTC"))], schema=schema)

        held = 0
        try:
            for m in client.fetch(partition.partition, partition.start, partition.end):
                rows.append(m)
                held += len(m[1] or b"")
                if len(rows) >= 4096 or held >= 4 << 20:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()
        finally:
            client.close()


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        first, end = self.connected().bounds()
        return ranges(first, end, first, int(self.options.get("task_messages", TASK_MESSAGES)))


class _Stream(_Reading, DataSourceStreamReader):
    """max_block_size: messages of a block, all partitions together. It counts from the block before; the first block after a start
    takes all there is, as the reader isn't told where the stream goes on."""

    def __init__(self, options: Mapping[str, str]):
        super().__init__(options)
        self.reached: Offsets | None = None

    def initialOffset(self) -> Offsets:
        first, end = self.connected().bounds()
        self.reached = end if self.options.get("starting", "earliest") == "latest" else first
        return dict(self.reached)

    def latestOffset(self) -> Offsets:
        first, end = self.connected().bounds()
        most = int(self.options.get("max_block_size", 0))
        if not most or self.reached is None:
            return end
        share, out = -(-most // max(1, len(end))), {}
        for p, e in sorted(end.items()):
            at = self.reached.get(p, first[p])
            out[p] = max(at, min(e, at + min(share, most)))
            most -= out[p] - at
        return out

    def partitions(self, start: Offsets, end: Offsets) -> list[Range]:
        self.reached = dict(end)
        first, _ = self.connected().bounds()
        gone = {p: (start[p], first[p]) for p in start if p in first and start[p] < first[p] and start[p] < end.get(p, 0)}
        if gone and self.options.get("fail_on_data_loss", "true") == "true":
            raise ValueError(f"messages that weren't read yet are gone from the queue: {gone}")
        start = {p: max(n, first.get(p, n)) for p, n in start.items()}
        return ranges(start, end, first, int(self.options.get("task_messages", TASK_MESSAGES)))

    def commit(self, end: Offsets) -> None:
        self.connected().commit(end)

    def stop(self) -> None:
        if self.client is not None:
            self.client.close()
            self.client = None


class QueueSource(DataSource):
    """Format `message_queue`. Options: client (spool, kafka, nats, rabbitmq), what the client takes, task_messages, and for streams
    max_block_size, starting (earliest or latest) and fail_on_data_loss."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(QueueSource)
    return spark


def messages(spark: SparkSession, **options: object) -> DataFrame:
    """All messages that a queue has now."""
    return _registered(spark).read.format("message_queue").options(**options).load()


def message_stream(spark: SparkSession, **options: object) -> DataFrame:
    """A queue's messages as they come."""
    return _registered(spark).readStream.format("message_queue").options(**options).load()


def parsed_messages(raw: DataFrame, format: str, schema: StructType | str) -> DataFrame:
    """The rows in messages, by the name of a format in declarations. Messages that don't parse give nulls."""
    text, name = F.col("value").cast("string"), format.lower()
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    if name in ("json", "jsoneachrow"):
        return raw.select(F.from_json(text, ddl).alias("v")).select("v.*")
    if name in ("csv", "tsv", "tabseparated"):
        return raw.select(F.from_csv(text, F.lit(ddl), {"sep": "," if name == "csv" else "\t"}).alias("v")).select("v.*")
    if name in ("lineasstring", "text", "rawblob"):
        (field,) = StructType.fromDDL(ddl).fields
        return raw.select(F.col("value").cast(field.dataType).alias(field.name))
    raise ValueError(f"messages can't be parsed as {format}")


def publish(rows: DataFrame, path: str, topic: str, value: Column, key: Column, partitions: int = 4) -> None:
    """Appends rows to a spool as messages. Rows of one key keep to one partition; a partition is written by one task, in order of the
    value. A job that fails half way leaves whole segments of some partitions: publish again with what isn't there."""
    at = Spool({"path": path, "topics": topic}).bounds()[1]
    now = int(datetime.datetime.now(datetime.timezone.utc).timestamp() * 1e6)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        first = end = part = stream = segment = None
        for batch in (b for b in batches if b.num_rows):
            if segment is None:
                folder = f"{topic}/{batch.column(0)[0].as_py()}"
                first = end = at.get(folder, 0)
                fs.create_dir(f"{root}/{folder}", recursive=True)
                part = f"{root}/{folder}/{uuid.uuid4().hex}.part"
                stream = fs.open_output_stream(part)
                segment = pa.ipc.new_file(stream, SEGMENT)
            n = batch.num_rows
            segment.write_batch(pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(range(end, end + n), pa.int64()), pa.array([now] * n, pa.int64())], schema=SEGMENT))
            end += n
        if segment is not None:
            segment.close()
            stream.close()
            fs.move(part, f"{root}/{folder}/{first:020d}-{end:020d}.arrow")
        yield from ()

    spot = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    rows = rows.select(key.cast("string").cast("binary").alias("key"), value.cast("string").cast("binary").alias("value"))
    ship(rows.sparkSession)
    placed = rows.select(spot.alias("partition"), "key", "value").repartitionById(partitions, "partition").sortWithinPartitions("value")
    placed.mapInArrow(written, "key binary").write.format("noop").mode("append").save()
