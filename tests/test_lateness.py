import os
import random
import time

import pytest

from conftest import rows
from logloom.operators import lateness
from logloom.streaming import lateness as stream

S = lateness.SECOND
SCHEMA = "msg_id bigint, file_id bigint, topic string, log_time bigint, publish_time bigint, data binary, extra int"


def make(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        log = 1_000 * S + i * 2 * S + rng.randrange(S)
        pub = log - rng.choice([0, 1, 1, 30, 50, 90, 200]) * S
        pub = {0: None, 1: 0, 2: log + 9 * S}.get(rng.randrange(40), pub)
        out.append((i, i % 2, "/t", log, pub, b"x" * (i % 5), 1))
    out += [(i, f, t, log + 500 * S, p, d, 2) for i, f, t, log, p, d, _ in out[:30]] + out[50:60]
    rng.shuffle(out)
    return out


def brute(data):
    first = {}
    for r in data:
        if r[0] not in first or r[3] < first[r[0]][3]:
            first[r[0]] = r
    out, top = {}, {}
    for r in sorted(first.values(), key=lambda r: (r[3], r[0])):
        k, pub = r[1], r[4]
        if pub is None or pub == 0 or pub > r[3] + 5 * S:
            out[r[0]] = "invalid"
            continue
        behind = max(top.get(k, pub) - pub, 0)
        out[r[0]] = "dropped" if behind > 60 * S else "late" if behind else "on_time"
        top[k] = max(top.get(k, pub), pub)
    return out


def test_classify_against_brute_force(spark, monkeypatch):
    data = make()
    monkeypatch.setattr(lateness, "BLOCK_NS", 30 * S)
    got = {r.msg_id: r.status for r in lateness.classify(spark.createDataFrame(data, SCHEMA), ["file_id", "topic"]).collect()}
    assert got == brute(data)
    assert len(set(got.values())) == 4


def test_incomplete_rows_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "/t", 5, 5, None, 0), (1, 1, "/t", None, 5, None, 0), (2, None, "/t", 9, 5, None, 0), (3, 1, "/t", 7, 6, None, 0)], SCHEMA)
    got = rows(lateness.classify(df, ["file_id", "topic"]).select("msg_id", "status", "n_bytes"))
    assert got == [(1, "invalid", 0), (2, "invalid", 0), (3, "on_time", 0), (None, "invalid", 0)]
    assert lateness.classify(df.limit(0), ["file_id", "topic"]).collect() == []


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, "/t", 100 * S, 100 * S, b"ab", 0), (2, 1, "/t", 101 * S, 70 * S, b"c", 0), (3, 1, "/t", 102 * S, 10 * S, b"d", 0)], SCHEMA)
    got = rows(lateness.windows(lateness.classify(df, ["file_id", "topic"]), ["topic"]))
    assert got == [("/t", 0, 0, 0, 0, 0, 1), ("/t", 60 * S, 1, 2, 3, 1, 0)]


@pytest.mark.parametrize("pieces", [1, 4])
def test_stream_equals_batch(spark, tmp_path, pieces):
    data = sorted(make(200, 5), key=lambda r: r[3])
    src = tmp_path / "in"
    step = -(-len(data) // pieces)
    for k in range(pieces):
        spark.createDataFrame(data[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.parquet(str(src / f"p{k}"))
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    if pieces > 1:  # files are taken in order of their time
        import os

        for k in range(pieces):
            for p in (src / f"p{k}").glob("*.parquet"):
                os.utime(p, (1_000_000 + 100 * k, 1_000_000 + 100 * k))
    out = str(tmp_path / "out")
    stream.sink(stream.stream_windows(df, ["file_id", "topic"]), out, str(tmp_path / "ck"), ["file_id", "topic"], availableNow=True).awaitTermination()
    batch = lateness.classify(spark.createDataFrame(data, SCHEMA), ["file_id", "topic"])
    want = rows(lateness.windows(batch, ["file_id", "topic"]).where("n_messages > 0").select("file_id", "window_start", "n_first", "n_messages", "n_bytes", "n_late"))
    assert rows(stream.current(spark, out, ["file_id", "topic"]).select("file_id", "window_start", "n_first", "n_messages", "n_bytes", "n_late")) == want
    apart = rows(stream.apart(spark, out, ["file_id", "topic"]).where("kind = 'dropped'").select("msg_id"))
    assert apart == rows(batch.where("status = 'dropped'").select("msg_id"))


def test_stream_of_sources_days_apart_in_reverse(spark, tmp_path):
    day = 86_400 * S
    later, earlier = ([(100 * f + i, f, "/t", at + i * 40 * S + 1, at + (i - 5 * (i % 4 == 3)) * 40 * S + 1, b"ab", 0) for i in range(20)] for f, at in ((1, 20_000 * day), (2, 19_000 * day)))
    odd = [(None, 2, "/t", 5, 5, None, 0), (7, 2, "/t", None, 5, None, 0), (8, None, "/t", 9, 5, None, 0), (9, 2, "/t", earlier[-1][3], None, None, 0)]
    pieces = [later, [*earlier, *odd, *earlier[:3]], [*earlier[5:8], (300, 2, "/t", earlier[0][3] - 3 * 3600 * S, earlier[0][3] - 3 * 3600 * S, b"", 0)]]
    src = tmp_path / "in"
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.parquet(str(src / f"p{k}"))
        for p in (src / f"p{k}").glob("*.parquet"):
            os.utime(p, (1_000_000 + 100 * k, 1_000_000 + 100 * k))
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    out, source = str(tmp_path / "out"), ["file_id", "topic"]
    stream.sink(stream.stream_windows(df, source), out, str(tmp_path / "ck"), source, availableNow=True).awaitTermination()
    batch = lateness.classify(spark.createDataFrame([*later, *earlier, *odd], SCHEMA), source)
    cols = ["file_id", "window_start", "n_first", "n_messages", "n_bytes", "n_late"]
    assert rows(stream.current(spark, out, source).select(cols)) == rows(lateness.windows(batch, source).where("n_messages > 0").select(cols))
    cols = ["kind", "file_id", "msg_id", "log_time", "publish_time"]
    want = batch.withColumnRenamed("status", "kind").where("kind in ('dropped', 'invalid')").select(cols)
    beyond = ("dropped", 2, 300, pieces[2][-1][3], pieces[2][-1][4])
    assert rows(stream.apart(spark, out, source).select(cols)) == sorted([*rows(want), beyond], key=repr)


def test_a_table_replayed_in_triggers_with_copies_hours_later(spark, tmp_path):
    data = make(300, 8)
    data += [(i, f, t, log + 5 * 3600 * S, p, d, 2) for i, f, t, log, p, d, _ in data[:40]]
    random.Random(1).shuffle(data)
    df, source = spark.createDataFrame(data, SCHEMA).repartition(5), ["file_id", "topic"]
    folder = str(tmp_path / "r")
    arrivals = stream.replay(df, source, f"{folder}/arrivals", trigger_rows=100)
    out = f"{folder}/updates"
    query = stream.sink(stream.stream_windows(arrivals, source), out, f"{folder}/state", source)
    query.awaitTermination()
    assert len(query.recentProgress) >= 2
    batch = lateness.classify(df, source)
    cols = ["file_id", "window_start", "n_first", "n_messages", "n_bytes", "n_late"]
    assert rows(stream.current(spark, out, source).select(cols)) == rows(lateness.windows(batch, source).where("n_messages > 0").select(cols))
    cols = ["kind", "file_id", "msg_id", "log_time", "publish_time", "behind_ns"]
    assert rows(stream.apart(spark, out, source).select(cols)) == rows(batch.withColumnRenamed("status", "kind").where("kind in ('dropped', 'invalid')").select(cols))
    none = stream.replayed(df.limit(0), source, str(tmp_path / "e"))
    assert stream.current(spark, none, source).collect() == [] == stream.apart(spark, none, source).collect()


def test_horizon_and_idle_sources(spark, tmp_path):
    """With a horizon ids are forgotten, so state stays bounded; a state given up starts anew."""
    data = [(1, 1, "/t", 10 * S, 10 * S, b"a", 0), (2, 1, "/t", 20 * S, 20 * S, b"a", 0), (1, 1, "/t", 30 * S, 10 * S, b"a", 0), (3, 1, "/t", 9000 * S, 9000 * S, b"a", 0), (4, 1, "/t", 100 * S, 100 * S, b"a", 0)]
    df, source = spark.createDataFrame(data[:4], SCHEMA), ["file_id", "topic"]
    out = stream.replayed(df, source, str(tmp_path / "a"), dedupe_within="1 hour")
    assert rows(stream.current(spark, out, source).select("window_start", "n_messages")) == [(0, 2), (9000 * S, 1)]
    src = tmp_path / "in"
    for k, piece in enumerate((data[:4], data[4:])):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.parquet(str(src / f"p{k}"))
        for p in (src / f"p{k}").glob("*.parquet"):
            os.utime(p, (1_000_000 + 100 * k, 1_000_000 + 100 * k))
    two = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    stream.sink(stream.stream_windows(two, source, dedupe_within="1 hour"), str(tmp_path / "o"), str(tmp_path / "k"), source).awaitTermination()
    assert [r.msg_id for r in stream.apart(spark, str(tmp_path / "o"), source).where("kind = 'dropped'").collect()] == [4]


def test_state_of_an_idle_source_is_given_up(spark, tmp_path):
    spark.createDataFrame(make(20), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = stream.sink(stream.stream_windows(df, ["file_id", "topic"], idle="1 second"), str(tmp_path / "o"), str(tmp_path / "k"), ["file_id", "topic"], processingTime="500 milliseconds")
    try:
        held, end = [], time.time() + 60
        while time.time() < end and not (held and held[-1] == 0 and max(held) == 2):
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            time.sleep(0.5)
        assert max(held) == 2 and held[-1] == 0
    finally:
        query.stop()
