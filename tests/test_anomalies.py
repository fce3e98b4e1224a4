import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from logloom.operators import anomalies as an
from logloom.operators.readings import reading

SCHEMA = "file_id bigint, topic string, msg_id bigint, log_time bigint, reading double, other int"
LIMITS = "topic string, min_possible double, max_possible double"


def flags(spark, xs, limits=(("/t", 0.0, 100.0),), **kw):
    df = spark.createDataFrame([(1, "/t", i, i * 10, None if x is None else float(x), 0) for i, x in enumerate(xs)], SCHEMA)
    got = an.flag(df, spark.createDataFrame(list(limits), LIMITS), **kw).collect()
    return {k: sorted(r.msg_id for r in got if r[k]) for k in ("is_range", "is_stuck", "is_spike")}


def noise(n, seed=0, level=50.0, s=0.3):
    return list(level + s * np.random.default_rng(seed).standard_normal(n))


def test_range_stuck_and_spike_are_told_apart(spark):
    x = noise(200)
    x[20] = -5.0
    x[60:62] = [58.0, 58.5]
    x[100:112] = [50.1] * 12
    x[150:159] = [49.9] * 9
    assert flags(spark, x) == {"is_range": [20], "is_stuck": list(range(100, 112)), "is_spike": [60, 61]}


def test_lasting_changes_are_normal(spark):
    step = noise(80) + noise(80, 1, 70.0)
    switch = [v + (12 if (i // 9) % 2 else 0) for i, v in enumerate(noise(160, 2))]
    saw = [v + 0.25 * (i % 60) for i, v in enumerate(noise(180, 3))]
    four = noise(100, 4)
    four[50:54] = [60.0, 60.2, 59.9, 60.1]
    for x in (step, switch, saw, four):
        assert flags(spark, x)["is_spike"] == []


def test_three_long_spike_on_a_slope_and_quantized(spark):
    x = [v + 0.05 * i for i, v in enumerate(noise(200, 5))]
    for k in range(90, 93):
        x[k] -= 9.0
    q = [round(v / 0.4) * 0.4 for v in noise(200, 6)]
    q[30] += 6.0
    assert flags(spark, x)["is_spike"] == [90, 91, 92]
    assert flags(spark, q)["is_spike"] == [30]


def test_nulls_copies_limits_and_empty(spark):
    df = spark.createDataFrame([(1, "/t", 1, 10, 500.0, 0)] * 2 + [(1, "/t", 2, 20, None, 0), (1, "/u", 3, 30, 1e9, 0), (None, "/t", 4, 1, -1.0, 0), (1, "/t", 5, None, -1.0, 0)], SCHEMA)
    lim = spark.createDataFrame([("/t", None, 100.0), (None, 0.0, 1.0)], LIMITS)
    assert rows(an.flag(df, lim).select("msg_id", "is_range")) == [(1, True), (3, False)]
    assert an.flag(df.limit(0), lim).collect() == []


def test_segments_do_not_change_the_result(spark, monkeypatch):
    x = noise(3000, 7)
    for k in (500, 1023, 1024, 1499, 2047):
        x[k] += 7.0
    x[995:1010] = [50.0] * 15
    whole = flags(spark, x)
    monkeypatch.setattr(an.segmented, "__defaults__", (300, 64))
    assert flags(spark, x) == whole
    assert whole["is_spike"] == [500, 1023, 1024, 1499, 2047] and len(whole["is_stuck"]) == 15


def test_segments_stay_bounded_however_large_the_source(spark, monkeypatch):
    """A million readings at the real constants: every segment has at most SEGMENT readings of its own, in order, and none is lost."""
    df = spark.range(1_000_003).select(F.lit(1).cast("bigint").alias("file_id"), F.lit("/t").alias("topic"), F.col("id").alias("msg_id"), (F.col("id") * 7_000_000).alias("log_time"), F.col("id").cast("double").alias("reading"))
    cut = an.segmented(df.withColumn("_block", F.expr(f"log_time div {an.BLOCK_NS}")))
    seg = cut.groupBy("seg").agg(F.count(F.when(F.col("own"), 1)).alias("own"), F.count(F.when(~F.col("own"), 1)).alias("halo"), F.min(F.when(F.col("own"), F.col("msg_id"))).alias("a"), F.max(F.when(F.col("own"), F.col("msg_id"))).alias("z"), F.min("msg_id").alias("la"), F.max("msg_id").alias("lz")).orderBy("seg").collect()
    assert len(seg) == 245 and max(r.own for r in seg) <= an.SEGMENT and min(r.own for r in seg) > 0.9 * an.SEGMENT and sum(r.own for r in seg) == 1_000_003
    for p, q in zip(seg, seg[1:]):
        assert q.a == p.z + 1 and q.la == q.a - an.HALO and p.lz == p.z + an.HALO


def test_season_decides(spark, monkeypatch):
    """A source that swings every twelve readings: its own swings are normal, an excursion smaller than a swing is not; without the season it is lost."""
    rng = np.random.default_rng(11)
    base = np.array([50 + 20 * (k % 12 in (3, 4)) - 15 * (k % 12 == 8) for k in range(480)], float) + 0.01 * np.arange(480) + 0.3 * rng.standard_normal(480)
    x = base.copy()
    x[200] += 8.0
    x[301:303] -= 7.0
    with_season = flags(spark, x)["is_spike"]
    assert with_season == [200, 301, 302] and flags(spark, base)["is_spike"] == []
    plain = an.decompose
    assert an.spikes(x)[0].nonzero()[0].tolist() == with_season
    monkeypatch.setattr(an, "decompose", lambda y: (plain(y)[0], np.zeros(len(y)), y - plain(y)[0]))
    assert an.spikes(x)[0].nonzero()[0].tolist() != with_season


def test_scatter_is_that_of_the_source_however_it_is_cut(spark, monkeypatch):
    quiet, loud = noise(1500, 8, s=0.1), noise(1500, 9, s=1.0)
    x = [v for k in range(0, 1500, 300) for v in (*quiet[k : k + 300], *loud[k : k + 300])]
    for k, by in ((150, 1.2), (450, 9.0), (1050, 9.0), (2990, 9.0)):
        x[k] = 50.0 + by
    constant = [50.0] * 2990 + [50.5] * 10
    constant[700], constant[1500] = 53.0, 60.0  # the least step, 0.5, and the spikes lie in different segments
    whole = [flags(spark, v) for v in (x, constant)]
    monkeypatch.setattr(an.segmented, "__defaults__", (300, 64))
    assert [flags(spark, v) for v in (x, constant)] == whole
    assert {450, 1050, 2990} <= set(whole[0]["is_spike"]) and 150 not in whole[0]["is_spike"]
    assert whole[1]["is_spike"] == [700, 1500]


def test_copies_neither_swell_a_segment_nor_fill_the_halo(spark, monkeypatch):
    x = noise(1200, 10)
    for k in range(96, 1190, 100):  # a run of ten and a spike around and beside every cut
        x[k : k + 10] = [50.0 + k / 1000] * 10
        x[k + 14] += 8.0
    once = [(1, "/t", i, i * 10, float(v), 0) for i, v in enumerate(x)]
    many = [r for r in once for _ in range(70 if r[2] % 100 in (0, 1, 99) else 1)] + [once[600]] * 3000
    lim = spark.createDataFrame([("/t", 0.0, 100.0)], LIMITS)
    seen = []
    plain = an.segmented

    def spy(rows, segment=100, halo=64):
        got = plain(rows, segment, halo)
        seen.append(got)
        return got

    monkeypatch.setattr(an, "segmented", spy)
    kinds = ("msg_id", "is_range", "is_stuck", "is_spike")
    want = rows(an.flag(spark.createDataFrame(once, SCHEMA), lim).select(*kinds))
    assert rows(an.flag(spark.createDataFrame(many, SCHEMA), lim).select(*kinds)) == want
    assert sum(r[2] for r in want) == 110 and sum(r[3] for r in want) == 11
    sizes = [r["count"] for r in seen[-1].where("own").groupBy("seg").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 130


def test_segments_are_of_equal_size(spark):
    df = spark.range(1001).selectExpr("1L file_id", "'/t' topic", "id msg_id", "id log_time")
    cut = an.segmented(df.withColumn("_block", F.expr(f"log_time div {an.BLOCK_NS}")), 250, 8)
    sizes = [r["count"] for r in cut.where("own").groupBy("seg").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 180


def test_season_is_found_where_there_is_one():
    t = np.arange(400)
    y = 10 + 3 * np.sin(2 * np.pi * t / 9) + 0.05 * np.random.default_rng(1).standard_normal(400)
    _, season, rest = an.decompose(y)
    assert season.std() > 0.5 and np.median(np.abs(rest)) < 0.1


def test_extreme_deviates():
    x = np.random.default_rng(2).standard_normal(300)
    x[[5, 50, 250]] = [9, -12, 15]
    assert sorted(np.flatnonzero(an.extreme_deviates(x, 1.0))) == [5, 50, 250]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a":1,"reading":2.5}', 2.5), ('{"x":{"level":"3.25"},"u":"level"}', 3.25), ('{"reading":null}', None), ('{"value":""}', None), ('{"value":"NaN"}', None),
        ('{"measurement": -1e3 }', -1000.0), ('{"value":{"reading":7}}', 7.0), ('{"note":"\\"reading\\": 5","level":6}', 6.0), (None, None), ("", None),
    ],
)
def test_reading(spark, text, want):
    got = spark.createDataFrame([(text,)], "v string").select(reading(F.col("v"))).first()[0]
    assert got == want
