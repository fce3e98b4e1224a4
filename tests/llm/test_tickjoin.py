import random

from pyspark.sql import functions as F

from conftest import rows
from logloom.llm import tickjoin

MS = tickjoin.MILLI
def key():
    return {"e": (F.col("e"), F.col("e"))}



def frames(spark, left, right):
    return spark.createDataFrame(left, "sid bigint, e string, log_time bigint, topic string"), spark.createDataFrame(right, "fid bigint, e string, log_time bigint, topic string")


def test_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("abc"), rng.randrange(0, 3000 * MS), "l") for i in range(300)] + [(900, "a", None, "l"), (901, None, 5, "l")]
    right = [(i, rng.choice("ab"), rng.choice([rng.randrange(0, 3000 * MS), 40 * MS * rng.randrange(60)]), "r") for i in range(400)] + [(500, "a", None, "r"), (None, "a", 7, "r")]
    left += left[:20]
    right += right[:20]
    want = set()
    for s, e, t, _ in left:
        near = [(abs(u - t), f) for f, e2, u, _ in right if t is not None and u is not None and f is not None and e is not None and e == e2 and abs(u - t) <= 40 * MS]
        if near:
            want.add((s, min(near)[1]))
    a, b = frames(spark, left, right)
    for tick in (5, 20, 40, 100):
        got = tickjoin.nearest(a, b, key(), "sid", "fid", tick_ns=tick * MS)
        assert rows(got.select("sid", "fid")) == sorted(want, key=repr)


def test_ties_bounds_and_unmatched(spark):
    a, b = frames(spark, [(1, "a", 100 * MS, ""), (2, "a", 500 * MS, ""), (3, "a", -30 * MS, "")], [(9, "a", 60 * MS, ""), (4, "a", 140 * MS, ""), (5, "a", 541 * MS, "")])
    assert rows(tickjoin.nearest(a, b, key(), "sid", "fid")) == [(1, 4, 40 * MS)]
    assert rows(tickjoin.nearest(a, b, key(), "sid", "fid", keep_unmatched=True)) == [(1, 4, 40 * MS), (2, None, None), (3, None, None)]
    assert tickjoin.nearest(a.limit(0), b, key(), "sid", "fid").collect() == []
    assert tickjoin.nearest(a, b.limit(0), key(), "sid", "fid").collect() == []


def test_mount(spark):
    df = spark.createDataFrame([("/lidar/left/points",), ("/tf",), (None,), ("/camera/rear/image",)], "topic string")
    assert rows(df.select(tickjoin.mount())) == [("left",), ("rear",), (None,), (None,)]
