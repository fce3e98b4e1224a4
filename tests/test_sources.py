import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from logloom.decode.base import JsonDecoder, Registry
from logloom.decode.batches import Metadata
from logloom.errors import CallbackError, ContainerError, EmptyDerivedSchema, MessageDecode, MetadataColumnCollision, MultipleChannels, NoDecoder, SchemaNotAvailable, StatsNotAvailable, SummaryNotAvailable, TopicNotFound
from logloom.ir import field
from logloom.sources import container as c
from logloom.sources import mcap
from logloom.sources.reader import LogReader, ReadOptions
from logloom.sources.scan import chunks, scan_topic, skipped
from logloom.testkit import models
from logloom.testkit.mcap_writer import McapWriter

VALUE = JsonDecoder((field("value", "I64", True),))


def write(path, n=10, compression="", chunk_bytes=1, bad=None, **kw):
    with McapWriter(str(path), compression, chunk_bytes, **kw) as w:
        s = w.add_schema("test.Msg", "jsonschema", b"{}")
        a, b = w.add_channel("/decoded", "json", s), w.add_channel("/raw", "application/octet-stream")
        for i in range(n):
            w.write(a, i + 1, b"oops" if i == bad else b'{"value":%d}' % i, publish_time=i + 1)
        w.write(b, n + 1, b"\1\2\3")
    return str(path)


def reader():
    return LogReader().register(VALUE)


@pytest.mark.parametrize("compression", ["", "zstd", "lz4"])
@pytest.mark.parametrize("chunk_bytes", [1, 100, 1 << 20])
def test_container_round_trip(tmp_path, compression, chunk_bytes):
    p = write(tmp_path / "a.mcap", 20, compression, chunk_bytes)
    got = list(reader().prepare(p, "/decoded").rows())
    assert got == [(i + 1, i + 1, {"value": i}) for i in range(20)]
    assert list(reader().raw_messages(p, "/raw")) == [(21, 21, b"\1\2\3")]


def test_hand_built_header_bytes(tmp_path):
    p = write(tmp_path / "a.mcap", 1)
    raw = open(p, "rb").read()
    assert raw[:8] == bytes.fromhex("89 4d 43 41 50 30 0d 0a") == raw[-8:]
    assert raw[8] == 1 and raw[-37] == 2 and int.from_bytes(raw[-36:-28], "little") == 20


def test_damaged_files(tmp_path):
    p = write(tmp_path / "a.mcap", 3)
    raw = bytearray(open(p, "rb").read())
    for name, change in (("start", 0), ("end", len(raw) - 1), ("crc", len(raw) - 60)):
        bad = bytearray(raw)
        bad[change] ^= 0xFF
        q = str(tmp_path / f"{name}.mcap")
        open(q, "wb").write(bad)
        with pytest.raises(ContainerError):
            c.read_summary(c.open_file(q))
    q = str(tmp_path / "short.mcap")
    open(q, "wb").write(raw[:20])
    with pytest.raises(ContainerError):
        c.read_summary(c.open_file(q))
    at = raw.find(b'{"value":1}')
    raw[at + 9] ^= 1
    open(q, "wb").write(raw)
    with pytest.raises(ContainerError, match="checksum"):
        list(reader().prepare(q, "/decoded").rows())


def test_errors(tmp_path):
    with pytest.raises(SummaryNotAvailable, match="MCAP summary not available"):
        reader().topics(write(tmp_path / "a.mcap", summary=False))
    p = write(tmp_path / "b.mcap", statistics=False)
    with pytest.raises(StatsNotAvailable):
        reader().message_count(p, "/decoded")
    assert reader().topics(p)[0].message_count is None
    with pytest.raises(TopicNotFound, match="topic not found"):
        reader().prepare(p, "/none")
    with pytest.raises(SchemaNotAvailable):
        reader().prepare(p, "/raw")
    with pytest.raises(NoDecoder):
        LogReader().prepare(p, "/decoded")
    with pytest.raises(EmptyDerivedSchema, match="test.Msg"):
        LogReader().register(JsonDecoder(())).prepare(p, "/decoded").batch_schema()
    with pytest.raises(MetadataColumnCollision):
        LogReader().register(JsonDecoder((field("log_time", "I64"),))).prepare(p, "/decoded").batch_schema()
    with pytest.raises(OSError):
        reader().topics(str(tmp_path / "absent.mcap"))


def test_duplicate_topics(tmp_path):
    p = str(tmp_path / "d.mcap")
    with McapWriter(p) as w:
        s = w.add_schema("t", "jsonschema", b"")
        for side in ("left", "right"):
            w.write(w.add_channel("/dup", "json", s, {"source": side}), 1, b'{"value":1}')
    (info,) = reader().topics(p, with_status=True)
    assert (info.message_count, info.channel_count, info.decodable, info.decode_error) == (2, 2, False, "multiple channels found for requested topic")
    with pytest.raises(MultipleChannels):
        reader().message_count(p, "/dup")


def test_options_and_early_stop(tmp_path):
    p = write(tmp_path / "a.mcap", 10, bad=6)
    t = reader().prepare(p, "/decoded")
    val = lambda o: [r[2]["value"] for r in t.rows(o)]
    assert val(ReadOptions(3, 6)) == [2, 3, 4]
    assert val(ReadOptions(3, 7, offset=1, limit=2)) == [3, 4]
    assert val(ReadOptions(limit=6)) == [0, 1, 2, 3, 4, 5]
    assert val(ReadOptions(limit=0)) == [] == val(ReadOptions(offset=99, parallel=False))
    assert val(ReadOptions(offset=7, parallel=False)) == [7, 8, 9]  # the bad row is skipped undecoded
    with pytest.raises(MessageDecode):
        val(ReadOptions(offset=7, parallel=True))


def test_a_bad_row_ends_the_scan(tmp_path):
    p, got = write(tmp_path / "a.mcap", 40, chunk_bytes=200, bad=23), {}
    for parallel in (False, True):
        got[parallel] = []
        with pytest.raises(MessageDecode):
            for r in reader().prepare(p, "/decoded").rows(ReadOptions(parallel=parallel)):
                got[parallel].append(r[2]["value"])
    assert got[False] == list(range(23)) and got[True] == list(range(len(got[True]))) and len(got[True]) < 23
    q = write(tmp_path / "b.mcap", 40, chunk_bytes=200)
    t = reader().prepare(q, "/decoded")
    assert list(t.rows(ReadOptions(3, 30, 2, parallel=True))) == list(t.rows(ReadOptions(3, 30, 2, parallel=False)))


def test_callbacks_are_wrapped_once(tmp_path):
    p, seen = write(tmp_path / "a.mcap"), []

    def cb(log, pub, value):
        seen.append(log)
        if log == 3:
            raise KeyError("mine")

    with pytest.raises(CallbackError) as e:
        reader().each_message(p, "/decoded", cb)
    assert isinstance(e.value.__cause__, KeyError) and seen == [1, 2, 3]
    sizes = []
    reader().each_batch(p, "/decoded", lambda b: sizes.append(b.num_rows), size=4)
    assert sizes == [4, 4, 2]


def test_unindexed_messages_are_invisible_to_decoded_scans(tmp_path):
    for kw in ({"chunk_bytes": None}, {"index_channels": False}):
        p = write(tmp_path / "u.mcap", 4, **kw)
        assert list(reader().prepare(p, "/decoded").rows()) == []
        assert len(list(reader().raw_messages(p, "/decoded"))) == 4


def test_matching_chunks_are_the_only_ones_read(tmp_path, monkeypatch):
    p = str(tmp_path / "b.mcap")
    models.write_bench(p, "flat", shape=models.FileShape(payload_bytes=1 << 18, select=1, clustered=True, chunk_bytes=1 << 12, compression="zstd"))
    read = []
    real = c.read_chunk
    monkeypatch.setattr(c, "read_chunk", lambda f, o, n: read.append(o) or real(f, o, n))
    t = LogReader.default().prepare(p, "/bench")
    n = len(list(t.rows()))
    assert len(read) == len(c.matching(t.summary, t.channel, None, None)) < len(t.summary.chunks) / 10
    assert n == LogReader.default().message_count(p, "/bench") > 0


# --- the Spark source ------------------------------------------------------------------------


@pytest.fixture
def load(spark):
    mcap.register(spark, [VALUE])

    def go(path, **o):
        r = spark.read.format("mcap").option("topic", "/decoded")
        for k, v in o.items():
            r = r.option(k, str(v))
        return r.load(path)

    return go


def test_source_modes(spark, load, tmp_path):
    p = write(tmp_path / "a.mcap", 5)
    assert rows(load(p)) == [(i + 1, i + 1, i) for i in range(5)]
    assert rows(load(p, topic="/raw", mode="raw")) == [(6, 6, bytearray(b"\1\2\3"))]
    assert rows(load(p, topic="/raw", mode="auto").select("data")) == [(bytearray(b"\1\2\3"),)]
    assert load(p, mode="auto").columns == ["log_time", "publish_time", "value"]
    t = rows(load(p, mode="topics").select("topic", "message_count", "decodable", "decode_error"))
    assert t == [("/decoded", 5, True, None), ("/raw", 1, False, "schema not available")]
    assert load(p, metadataPrefix="@", timeFormat="timestamp").schema.simpleString() == "struct<@log_time:timestamp,@publish_time:timestamp,value:bigint>"


def test_source_partitions_options_and_filters(spark, load, tmp_path):
    for k in range(3):
        write(tmp_path / f"f{k}.mcap", 30, "zstd", 60)
    whole = str(tmp_path)
    want = [(i + 1, i) for i in range(30)] * 3
    for o in ({}, {"numPartitions": 7}, {"parallel": "false"}):
        assert rows(load(whole, **o).select("log_time", "value")) == sorted(want, key=repr)
    assert load(whole, numPartitions=7).rdd.getNumPartitions() >= 7 and load(whole, parallel="false").rdd.getNumPartitions() == 1
    q = load(whole).where((F.col("log_time") >= 5) & (F.col("log_time") < 8))
    assert rows(q.select("log_time")) == sorted([(5,), (6,), (7,)] * 3)
    assert load(whole, startTime=5, endTime=8).count() == 9
    one = str(tmp_path / "f0.mcap")
    assert [r.value for r in load(one, startTime=5, offset=2, limit=3).collect()] == [6, 7, 8]
    assert load(one, limit=0).count() == 0
    pos = load(one, position="true").where("value < 3").select("_chunk", "_pos", "value").collect()
    assert [r.value for r in sorted(pos, key=lambda r: (r._chunk, r._pos))] == [0, 1, 2]


def test_source_errors(spark, load, tmp_path):
    p = write(tmp_path / "a.mcap")
    for o, text in (({"topic": "/none"}, "topic not found"), ({"fields": "nope"}, "not found in schema"), ({"mode": "odd"}, "unknown mode")):
        with pytest.raises(Exception, match=text):
            load(p, **o).collect()


def test_scan_of_a_file_table(spark, tmp_path):
    paths = [write(tmp_path / f"s{k}.mcap", 12, "lz4", 40) for k in range(4)]
    open(tmp_path / "broken.mcap", "wb").write(b"no container")
    files = spark.createDataFrame([(p,) for p in [*paths, str(tmp_path / "broken.mcap"), str(tmp_path / "absent.mcap")]], "path string")
    plan = chunks(files)
    assert plan.where("error is not null").count() == 2
    df = scan_topic(files, "/decoded", VALUE.fields, 3, 9, Registry().register(VALUE))
    assert rows(df.select("log_time", "value")) == sorted([(i + 1, i) for i in range(2, 8)] * 4, key=repr)
    assert df.select("path").distinct().count() == 4


@pytest.mark.parametrize("encoding", ["ros2msg", "ros2idl", "protobuf"])
def test_bench_files_one_task_equals_many(spark, tmp_path, encoding):
    p = str(tmp_path / "b.mcap")
    n = models.write_bench(p, "nested", encoding, models.FileShape(payload_bytes=1 << 16, select=50, chunk_bytes=1 << 12))
    mcap.register(spark)
    r = spark.read.format("mcap").option("topic", "/bench")
    one, many = r.option("parallel", "false").load(p), r.option("parallel", "true").option("numPartitions", "5").load(p)
    assert one.count() == n > 0 and one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert os.path.getsize(p) > 0 and Metadata().names == ("log_time", "publish_time")


def test_stream_of_arriving_files(spark, load, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write(folder / "b.mcap", 3)

    def drain():
        df = spark.readStream.format("mcap").option("topic", "/decoded").load(str(folder))
        df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    assert drain() == 3
    os.utime(folder / "b.mcap", (1, 1))
    write(folder / "a.mcap", 5)
    assert drain() == 8 == drain()
    write(folder / "late.mcap", 2)
    os.utime(folder / "late.mcap", (0, 0))
    assert drain() == 10 == drain()
    os.remove(folder / "a.mcap")
    write(folder / "c.mcap", 1)
    assert drain() == 11


def test_names_that_differ_in_case_only(spark, tmp_path):
    fields = (field("a", "I32"), field("A", "I32"))
    p = str(tmp_path / "c.mcap")
    with McapWriter(p) as w:
        w.write(w.add_channel("/c", "cdr", w.add_schema("p/msg/C", "ros2msg", models.msg_text(fields, "p").encode())), 1, models.cdr(fields, {"a": 1, "A": 2}))
    before = spark.conf.get("spark.sql.caseSensitive")
    mcap.register(spark)
    assert spark.conf.get("spark.sql.caseSensitive") == before
    try:
        mcap.register(spark, case_sensitive=True)
        df = spark.read.format("mcap").option("topic", "/c").load(p)
        assert rows(df.select("a", "A")) == [(1, 2)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def test_scan_reports_unreadable_files_and_lets_io_errors_through(spark, tmp_path):
    good, bad = write(tmp_path / "g.mcap", 3), str(tmp_path / "bad.mcap")
    open(bad, "wb").write(b"no container")
    files = spark.createDataFrame([(good,), (bad,)], "path string")
    scan = lambda f, **kw: scan_topic(f, "/decoded", VALUE.fields, 0, 99, Registry().register(VALUE), **kw)
    assert scan(files).count() == 3 and [r.path for r in skipped(files).collect()] == [bad]
    with pytest.raises(Exception, match="bad.mcap"):
        scan(files, unreadable="fail").collect()
    with pytest.raises(Exception, match="OSError|IsADirectory"):  # no absent file and no broken container: to be retried
        chunks(spark.createDataFrame([(str(tmp_path),)], "path string")).collect()
