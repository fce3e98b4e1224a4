from collections import Counter

from pyspark.sql import functions as F

from conftest import rows
from logloom.operators import eager


def test_distinct_per_key_with_hot_key_nulls_and_repeats(spark):
    data = [("hot", i % 500) for i in range(3000)] + [("cold", 1), ("cold", 1), ("cold", None), (None, 4)]
    df = spark.createDataFrame(data, "k string, id bigint")
    assert rows(eager.distinct_per_key(df, ["k"], "id", "n")) == [("cold", 1), ("hot", 500), (None, 1)]


def test_rollup_equals_the_plain_join(spark):
    left = [(i % 3, "a" if i % 2 else "b", i) for i in range(60)] + [(None, "a", 1), (9, "c", 5)]
    right = [(i % 2, i) for i in range(40)] + [(None, 7)]
    a = spark.createDataFrame(left, "k int, g string, x int")
    b = spark.createDataFrame(right, "k int, y int")
    n, sx, sy = Counter(), Counter(), Counter()
    for k, g, x in left:
        for k2, y in right:
            if k is not None and k == k2:
                n[g] += 1
                sx[g] += x
                sy[g] += y
    got = rows(eager.joined_rollup(a, b, ["k"], ["g"], {"sx": F.col("x")}, {"sy": F.col("y")}))
    assert got == sorted((g, n[g], sx[g], sy[g]) for g in n)
    kept = {r[0]: r[1] for r in eager.joined_rollup(a, b, ["k"], ["g"], {}, {}, keep_left=True).collect()}
    assert kept["c"] == 0


def test_audit(spark):
    cat = spark.createDataFrame([(1, "/a", 2, False), (1, "/a", 2, False), (1, "/b", 3, False), (2, "/a", None, False), (2, "/c", 0, False), (3, "/d", 5, True)], "file_id bigint, topic string, message_count bigint, decodable boolean")
    raw = spark.createDataFrame([(10, 1, "/a"), (10, 1, "/a"), (11, 1, "/a"), (12, 1, "/b")], "msg_id bigint, file_id bigint, topic string")
    assert rows(eager.count_audit(cat, raw)) == [(1, "/a", 2, 2, 0), (1, "/b", 3, 1, -2), (2, "/a", None, 0, None), (2, "/c", 0, 0, 0)]
    assert eager.count_audit(cat.limit(0), raw).collect() == []
