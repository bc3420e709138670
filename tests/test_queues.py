"""Message queues: the spool with restarts and limits, and the brokers' clients against stand-ins for their packages."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from tidemark.sources import queues
from tidemark.sources.engines import TableKind, read, read_stream


def rows(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") % 5).alias("k"))


def publish(spark, at, low, high, partitions=3):
    queues.publish(rows(spark, low, high), at, "t", F.to_json(F.struct("id", "k")), F.col("k"), partitions)


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def spec(at, **more):
    return TableKind("rabbitmq", options={"client": "spool", "path": f"{at}/spool", "topics": "t", "format": "JSONEachRow"} | more)


def run(spark, at, blocks, **more):
    """Runs a stream until all there is has been read; what each block had goes to blocks."""

    def block(df, n):
        blocks.append((n, sorted(r.id for r in df.collect())))

    query = read_stream(spark, spec(at, **more), "id long, k long").writeStream.foreachBatch(block).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def test_restarts_lose_no_message_and_give_none_twice(spark, at):
    blocks = []
    for low, high in ((0, 40), (40, 41), (41, 41), (41, 200)):
        if high > low:
            publish(spark, f"{at}/spool", low, high)
        run(spark, at, blocks)
    assert sorted(i for _, b in blocks for i in b) == list(range(200))
    assert [b for _, b in blocks] == [list(range(40)), [40], list(range(41, 200))]


def test_a_block_that_failed_comes_again_with_the_same_messages(spark, at):
    seen = []
    publish(spark, f"{at}/spool", 0, 30)

    def fails(df, n):
        seen.append(sorted(r.id for r in df.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    for i in range(3):  # a run that begins with a block that failed may end with it
        query = read_stream(spark, spec(at), "id long, k long").writeStream.foreachBatch(fails).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start()
        if i == 0:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination()
            publish(spark, f"{at}/spool", 30, 50)
        else:
            query.awaitTermination()
    assert seen[0] == seen[1] == list(range(30)) and seen[2:] == [list(range(30, 50))]


def test_blocks_are_limited(at, spark):
    publish(spark, f"{at}/spool", 0, 100)
    stream = queues._Stream({"client": "spool", "path": f"{at}/spool", "topics": "t", "max_block_size": "30"})
    now, n = stream.initialOffset(), []
    while (end := stream.latestOffset()) != now:
        got = stream.partitions(now, end)
        n.append(sum(r.end - r.start for r in got))
        now = end
    assert sum(n) == 100 and max(n) <= 30


def test_batch_reads_in_tasks_of_a_size_and_keys_keep_to_a_partition(spark, at):
    publish(spark, f"{at}/spool", 0, 100)
    publish(spark, f"{at}/spool", 100, 150)
    raw = queues.messages(spark, client="spool", path=f"{at}/spool", topics="t", task_messages=7)
    assert raw.rdd.getNumPartitions() >= 150 // 7
    got = raw.collect()
    assert len({(r.partition, r.offset) for r in got}) == 150 and all(r.topic == "t" and r.timestamp is not None for r in got)
    assert len({(bytes(r.key), r.partition) for r in got}) == len({bytes(r.key) for r in got}) == 5
    by_partition = {}
    for r in got:
        by_partition.setdefault(r.partition, []).append(r.offset)
    assert all(sorted(o) == list(range(len(o))) for o in by_partition.values())
    assert sorted(r.id for r in read(spark, spec(at), "id long, k long").collect()) == list(range(150))


def test_an_empty_topic_has_no_messages(spark, at):
    assert queues.messages(spark, client="spool", path=f"{at}/spool", topics="none").count() == 0


def test_lost_messages_are_an_error(spark, at):
    publish(spark, f"{at}/spool", 0, 20, 1)
    publish(spark, f"{at}/spool", 20, 40, 1)
    client = queues.Spool({"path": f"{at}/spool", "topics": "t"})
    end = client.bounds()[1]
    client.fs.delete_file(client.segments("t/0")[0][2])
    options = {"client": "spool", "path": f"{at}/spool", "topics": "t"}
    with pytest.raises(ValueError, match="gone"):
        queues._Stream(options).partitions({"t/0": 5}, end)
    assert [(r.start, r.end) for r in queues._Stream(options | {"fail_on_data_loss": "false"}).partitions({"t/0": 5}, end)] == [(20, 40)]


@pytest.mark.parametrize(("format", "schema", "value", "want"), [("JSONEachRow", "a int, b string", b'{"a": 1, "b": "x"}', (1, "x")), ("CSV", "a int, b string", b"1,x", (1, "x")), ("TSV", "a int, b string", b"1\tx", (1, "x")), ("LineAsString", "line string", b"1,x", ("1,x",)), ("JSONEachRow", "a int", b"{", (None,)), ("RawBLOB", "b binary", b"\x00\xff", (b"\x00\xff",))])
def test_messages_are_parsed_by_format(spark, format, schema, value, want):
    got = queues.parsed_messages(spark.createDataFrame([(bytearray(value),)], "value binary"), format, schema).first()
    assert tuple(bytes(v) if isinstance(v, bytearray) else v for v in got) == want
    with pytest.raises(ValueError, match="Avro"):
        queues.parsed_messages(spark.createDataFrame([(bytearray(value),)], "value binary"), "Avro", schema)


class Record(types.SimpleNamespace):
    pass


def kafka_stand_in(messages):
    """A package with the calls of kafka-python that the client makes, over messages by (topic, partition): some offsets are compacted away."""
    module = types.ModuleType("kafka")
    module.TopicPartition = lambda topic, partition: (topic, partition)
    module.OffsetAndMetadata = lambda offset, metadata, epoch: offset
    module.committed = {}

    class KafkaConsumer:
        def __init__(self, bootstrap_servers, group_id, enable_auto_commit, **own):
            assert not enable_auto_commit
            self.config = {"group_id": group_id}

        def partitions_for_topic(self, topic):
            return {p for t, p in messages if t == topic} or None

        def beginning_offsets(self, at):
            return {p: messages[p][0][0] for p in at}

        def end_offsets(self, at):
            return {p: messages[p][-1][0] + 1 for p in at}

        def assign(self, at):
            (self.at,) = at

        def seek(self, at, offset):
            self.place = offset

        def position(self, at):
            return self.place

        def poll(self, timeout_ms, max_records):
            found = [m for m in messages[self.at] if m[0] >= self.place][:3]
            if found:
                self.place = found[-1][0] + 1
            return {self.at: [Record(key=None, value=v, offset=o, timestamp=7) for o, v in found]}

        def commit(self, offsets):
            module.committed.update(offsets)

        def close(self):
            pass

    module.KafkaConsumer = KafkaConsumer
    return module


def test_kafka_client_reads_ranges_over_gaps_and_commits(monkeypatch):
    messages = {("a", 0): [(o, b"%d" % o) for o in (3, 4, 7, 8, 9, 12)], ("a", 1): [(0, b"x")]}
    monkeypatch.setitem(sys.modules, "kafka", fake := kafka_stand_in(messages))
    client = queues.Kafka({"broker_list": "h:1", "topic_list": "a", "group_name": "g"})
    assert client.bounds() == ({"a/0": 3, "a/1": 0}, {"a/0": 13, "a/1": 1})
    assert [m[2] for m in client.fetch("a/0", 4, 12)] == [4, 7, 8, 9]
    assert [m for m in client.fetch("a/0", 12, 13)] == [(None, b"12", 12, 7000)]
    client.commit({"a/0": 13})
    assert fake.committed == {("a", 0): 13}


def rabbit_stand_in(messages):
    module = types.ModuleType("pika")
    module.ConnectionParameters = module.URLParameters = lambda where: where

    class Channel:
        def queue_declare(self, queue, durable, arguments):
            assert arguments == {"x-queue-type": "stream"}

        def queue_bind(self, *how):
            self.bound = how

        def basic_qos(self, prefetch_count):
            pass

        def basic_ack(self, tag):
            pass

        def cancel(self):
            pass

        def consume(self, queue, arguments, inactivity_timeout):
            at = arguments["x-stream-offset"]
            start = {"first": 0, "last": max(0, len(messages) - 2)}.get(at, at)
            for n in range(start, len(messages)):
                yield Record(delivery_tag=n), Record(headers={"x-stream-offset": n}, message_id=f"m{n}", timestamp=2), messages[n]
            yield None, None, None

    class BlockingConnection:
        def __init__(self, where):
            pass

        def channel(self):
            return Channel()

        def close(self):
            pass

    module.BlockingConnection = BlockingConnection
    return module


def test_rabbitmq_client_reads_stream_queues_by_number(monkeypatch):
    monkeypatch.setitem(sys.modules, "pika", rabbit_stand_in([b"a", b"b", b"c", b"d"]))
    client = queues.RabbitMq({"host": "h", "queue": "q", "exchange_name": "e"})
    assert client.bounds() == ({"q/0": 0}, {"q/0": 4})
    assert list(client.fetch("q/0", 1, 3)) == [(b"m1", b"b", 1, 2_000_000), (b"m2", b"c", 2, 2_000_000)]
    with pytest.raises(TimeoutError):
        list(client.fetch("q/0", 3, 6))
    monkeypatch.setitem(sys.modules, "pika", rabbit_stand_in([]))
    assert queues.RabbitMq({"host": "h", "queue": "q"}).bounds() == ({"q/0": 0}, {"q/0": 0})


def nats_stand_in(messages):
    """messages: (sequence, subject, data)."""
    import datetime

    module, js, api = types.ModuleType("nats"), types.ModuleType("nats.js"), types.ModuleType("nats.js.api")
    module.errors = types.SimpleNamespace(TimeoutError=type("TimeoutError", (Exception,), {}))
    api.AckPolicy, api.DeliverPolicy = types.SimpleNamespace(NONE=0), types.SimpleNamespace(BY_START_SEQUENCE=1)
    api.ConsumerConfig = lambda **how: how

    class Consumer:
        def __init__(self, config):
            self.left = [m for m in messages if m[0] >= config["opt_start_seq"] and m[1] in config["filter_subjects"]]

        async def fetch(self, n, timeout):
            if not self.left:
                raise module.errors.TimeoutError
            now, self.left = self.left[:2], self.left[2:]
            stamp = datetime.datetime(1970, 1, 1, 0, 0, 1, tzinfo=datetime.timezone.utc)
            return [Record(subject=s, data=d, metadata=Record(sequence=Record(stream=q), timestamp=stamp)) for q, s, d in now]

        async def unsubscribe(self):
            pass

    class JetStream:
        async def stream_info(self, name):
            return Record(state=Record(first_seq=messages[0][0] if messages else 0, last_seq=messages[-1][0] if messages else 0))

        async def pull_subscribe(self, subject, stream, config):
            return Consumer(config)

    class Connection:
        def jetstream(self):
            return JetStream()

        async def close(self):
            pass

    async def connect(where):
        return Connection()

    module.connect = connect
    return {"nats": module, "nats.js": js, "nats.js.api": api}


def test_nats_client_reads_a_stream_by_sequence_and_subject(monkeypatch):
    for name, module in nats_stand_in([(2, "s", b"a"), (3, "x", b"b"), (5, "s", b"c"), (6, "s", b"d"), (8, "x", b"e")]).items():
        monkeypatch.setitem(sys.modules, name, module)
    client = queues.Nats({"url": "n", "subjects": "s", "stream": "q"})
    assert client.bounds() == ({"q/0": 2}, {"q/0": 9})
    assert [m[1:3] for m in client.fetch("q/0", 2, 6)] == [(b"a", 2), (b"c", 5)]
    assert [m[1:3] for m in client.fetch("q/0", 6, 9)] == [(b"d", 6)]
    client.close()
