import numpy as np
import pandas as pd

from conftest import rows
from logloom.operators import readings
from logloom.operators import ssa_grid as g

S = g.SECOND
SCHEMA = "file_id bigint, topic string, msg_id bigint, log_time bigint, reading double"


def test_grid_slots_means_copies_and_marks(spark):
    df = spark.createDataFrame([(1, "/t", 1, 5 * S, 1.0), (1, "/t", 1, 5 * S, 1.0), (1, "/t", 2, 9 * S, 3.0), (1, "/t", 3, 31 * S, 5.0), (1, "/t", 4, 12 * S, None), (2, "/t", 5, -5 * S, 7.0), (1, "/t", 6, None, 1.0)], SCHEMA)
    got = rows(g.regular_grid(df).select("file_id", "slot", "value", "n_readings", "how"))
    assert got == [(1, 0, 2.0, 2, "reading"), (1, 1, 3.0, 0, "line"), (1, 2, 4.0, 0, "line"), (1, 3, 5.0, 1, "reading"), (2, -1, 7.0, 1, "reading")]
    assert g.regular_grid(df.limit(0)).collect() == []


def test_periodic_series_is_continued():
    t = np.arange(200)
    x = np.sin(2 * np.pi * t / 20) + 0.01 * t
    missing = np.zeros(200, bool)
    missing[60:72] = missing[130:135] = True
    (y, how), = g.hankel_fill([(np.where(missing, np.nan, x), missing)])
    assert how == "spectrum"
    line = np.interp(t, t[~missing], x[~missing])
    assert np.abs(y - x)[missing].max() < 0.3 * np.abs(line - x)[missing].max()
    assert (y[~missing] == x[~missing]).all()


def test_constant_and_short_series():
    m = np.array([False, True, True, False])
    m2 = np.zeros(40, bool)
    m2[10:20] = True
    (a, how_a), (b, how_b) = g.hankel_fill([(np.array([2.0, np.nan, np.nan, 2.0]), m), (np.where(m2, np.nan, 4.0), m2)])
    assert a.tolist() == [2.0, 2.0, 2.0, 2.0] and np.allclose(b, 4.0) and how_a == how_b == "line"


def test_spikes_do_not_reach_the_gaps():
    x = np.sin(np.arange(120) / 9.0)
    x[50] = 400.0
    missing = np.zeros(120, bool)
    missing[[48, 49, 51, 52]] = True
    (y, _), = g.hankel_fill([(np.where(missing, np.nan, x), missing)])
    assert np.abs(y[missing]).max() < 1.5 and y[50] == 400.0


def test_series_are_filled_alike_alone_and_together():
    rng = np.random.default_rng(4)
    many = []
    for n in (8, 20, 33, 33, 150):
        m = rng.random(n) < 0.3
        m[[0, -1]] = False
        many.append((np.where(m, np.nan, rng.standard_normal(n).cumsum()), m))
    for one, (y, how) in zip(many, g.hankel_fill(many), strict=True):
        (z, alone), = g.hankel_fill([one])
        assert np.allclose(y, z, atol=1e-9) and how == alone


def test_unsettled_gaps_say_so():
    rng = np.random.default_rng(1)
    m = np.zeros(80, bool)
    m[20:60] = True
    (_, how), = g.hankel_fill([(np.where(m, np.nan, np.sin(np.arange(80.0)) + rng.standard_normal(80)), m)], rounds=1)
    assert how == "unsettled"


def test_held_out_periods_are_filled_better_than_by_a_line(spark):
    """On the given readings, single periods and runs of eight left out: on every topic at least as good as the straight line."""
    df = g.regular_grid(readings.with_reading(spark.read.parquet("/root/testdata/sf0.1/decoded_messages.parquet"))).toPandas()
    for kind in ("single", "run"):
        series, held = [], []
        for seed in range(3):
            rng = np.random.default_rng(seed)
            for (_, topic), d in df.sort_values("slot").groupby(["file_id", "topic"]):
                x, missing = d["value"].to_numpy(), d["filled"].to_numpy()
                n, seen = len(x), np.flatnonzero(~missing)
                if len(seen) < 12 or n < 20:
                    continue
                at = int(rng.integers(2, n - 10))
                out = rng.choice(seen[1:-1], max(len(seen) // 10, 1), replace=False) if kind == "single" else np.setdiff1d(np.arange(at, at + 8), np.flatnonzero(missing))
                scatter = np.median(np.abs(x[seen] - np.median(x[seen])))
                if scatter and len(out):
                    m = missing.copy()
                    m[out] = True
                    series.append((np.where(m, np.nan, x), m))
                    held.append((topic, x, out, scatter))
        off = []
        for (topic, x, out, scatter), (y, _), (_, m) in zip(held, g.hankel_fill(series), series, strict=True):
            line = np.interp(np.arange(len(x)), np.flatnonzero(~m), x[~m])
            off += [(topic, min(abs(y[k] - x[k]) / scatter, 5), min(abs(line[k] - x[k]) / scatter, 5)) for k in out]
        by = pd.DataFrame(off, columns=["topic", "spectrum", "line"]).groupby("topic")
        assert len(by) == 8
        for stat in (by.mean(), by.median()):
            assert (stat["spectrum"] <= stat["line"]).all(), (kind, stat)


def test_one_scan(spark, sf):
    text = g.regular_grid(readings.with_reading(spark.read.parquet(f"{sf}/decoded_messages.parquet")))
    text.collect()
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_long_gaps_across_segments(spark):
    far = 3 * g.SEGMENT + 17
    df = spark.createDataFrame([(1, "/t", 1, 0, 1.0), (1, "/t", 2, 10 * S * far, 4.0)], SCHEMA)
    got = g.regular_grid(df)
    assert got.count() == far + 1 and got.where("filled").count() == far - 1 and got.where("value is null or isnan(value)").count() == 0
