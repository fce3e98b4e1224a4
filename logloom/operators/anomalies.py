"""Implausible measurements per source: impossible values, stuck stretches and spikes.

Three checks over the usable readings of a source in order of time:

* ``range``: outside the physical limits of its topic;
* ``stuck``: part of at least ``min_run`` successive readings that are exactly equal;
* ``spike``: the source is decomposed robustly into a trend (running median), a
  seasonal part (median per phase, where a period explains the rest clearly) and
  a remainder.  Remainders beyond the limits of the generalised extreme
  studentised deviate test are suspects; a suspect stretch of at most
  ``max_spike`` readings counts if it lies outside the band between the local
  levels before and after it by more than ``factor`` times the source's usual
  scatter, and its neighbours do not.  Lasting steps, switching between levels,
  filling and emptying thereby stay unflagged.

The rule of the task fixes the factor, and at eight scatters a remainder passes any limit of the test; so
the test chooses what is looked at, and the band decides.  The season does decide: what a source does every
period is neither in its scatter nor an excursion.

A source is cut into equal segments of at most ``SEGMENT`` readings by their number in
order of time, each seeing ``HALO`` readings on either side, so a source of any size is
spread over tasks; readings are numbered by counts per time block and offsets.  Runs and neighbourhoods are far shorter than the halo.  The
scatter and the limits of the test are those of the whole source whatever its size:
segments count remainders and differences by narrow bins, the counts of a source add
up, and every segment is judged by what they yield.  Trend and season are local.

Defined cases: unusable readings (null, empty, NaN, no number), rows without
time or source are not judged; copies of a message count once and are removed before
a source is cut (the smallest reading counts if they differ); equal times are
ordered by message id; topics without limits have no range check; null limits do
not limit; a source shorter than five readings has no spikes; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.exact import floor_div
from logloom.session import tasks

SEGMENT, HALO = 4096, 64
#: Nanoseconds of log time numbered together.
BLOCK_NS = 600_000_000_000
_ROWS = "file_id bigint, topic string, msg_id bigint, log_time bigint, reading double, trend double, season double, is_range boolean, is_stuck boolean, is_spike boolean"


def _running_median(y: np.ndarray, width: int) -> np.ndarray:
    half = width // 2
    padded = np.pad(y, half, mode="reflect" if len(y) > half else "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)


def _mad(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def decompose(y: np.ndarray, width: int = 11, strength: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, season, remainder).  A season is only taken where medians per phase remove most of what the trend leaves."""
    n = len(y)
    trend = _running_median(y, width)
    rest = y - trend
    season = np.zeros(n)
    scatter = _mad(rest)
    if n >= 4 * width and scatter > 0:
        z = np.clip(rest / scatter, -3, 3)
        z = z - z.mean()
        power = np.fft.irfft(np.abs(np.fft.rfft(z, 2 * n)) ** 2)[: n // 4]
        lags = power[2:] / max(power[0], 1e-12)
        if len(lags) and lags.max() > strength:
            period = int(np.argmax(lags)) + 2
            phase = np.arange(n) % period
            table = np.array([np.median(rest[phase == p]) for p in range(period)])
            # Swings may take few phases, which the median deviation does not see; single spikes must not count much.
            most = np.quantile(np.abs(rest), 0.98)
            size = lambda v: np.minimum(np.abs(v), most).mean()
            if size(rest - table[phase]) < (1 - strength) * size(rest):
                season = table[phase]
    return trend, season, y - trend - season


def _t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t quantile by the Cornish-Fisher expansion around the normal one (Acklam's form in the upper tail)."""
    q = np.sqrt(-2 * np.log(1 - p))
    z = q - (2.515517 + q * (0.802853 + q * 0.010328)) / (1 + q * (1.432788 + q * (0.189269 + q * 0.001308)))
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / df + g2 / df**2 + g3 / df**3


def _bins(x: np.ndarray) -> np.ndarray:
    """Signed bin numbers, 1,024 bins an octave; only zero and the smallest subnormal numbers lie in bin 0."""
    b = np.abs(x).astype(np.float64).view(np.int64) >> 42
    return np.where(x < 0, -b, b)


def _middles(bins: np.ndarray) -> np.ndarray:
    b = np.abs(bins).astype(np.int64)
    return np.where(b == 0, 0.0, np.sign(bins) * ((b << 42) + (1 << 41)).view(np.float64))


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the finite values."""
    return np.unique(_bins(x[np.isfinite(x)]), return_counts=True)


def _median_of(v: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(v)
    upto, last = np.cumsum(n[order]), int(n.sum()) - 1
    return float(v[order][np.searchsorted(upto, [last // 2, (last + 1) // 2], "right")].mean())


def _mad_of(v: np.ndarray, n: np.ndarray) -> float:
    return 1.4826 * _median_of(np.abs(v - _median_of(v, n)), n) if len(v) else 0.0


def _deviate_limit(v: np.ndarray, n: np.ndarray, scatter: float, alpha: float, share: float) -> tuple[float, float]:
    """(centre, limit) of the generalised ESD test over values ``v`` that occur ``n`` times."""
    total = int(n.sum())
    k = int(total * share)
    if total < 5 or k < 1:
        return 0.0, np.inf
    centre = _median_of(v, n)
    dev = np.abs(v - centre)
    order = np.argsort(-dev, kind="stable")
    d, c = dev[order], n[order].astype(np.int64)
    last = np.cumsum(c)
    i = np.minimum(last, k)
    tail = np.cumsum((c * d**2)[::-1])[::-1] - (i - (last - c) - 1) * d**2
    few = last - c < k  # bins whose first value is among the k largest
    d, tail, i = d[few], tail[few], i[few]
    bound = lambda r: _esd_bound(total, r, alpha)
    spread = np.maximum(np.sqrt(np.maximum(tail, 0) / np.maximum(total - i, 1)), max(scatter / 2, 1e-300))
    over = np.flatnonzero((d / spread > bound(i)) & (d > 0))
    # In the tail a share of the largest hides the spread of all: whatever exceeds the limit by the robust scatter counts too.
    plain = float(bound(np.array([1]))[0]) * max(scatter, 1e-300)
    return centre, min(plain, float(np.nextafter(d[over[-1]], 0)) if len(over) else np.inf)


def _esd_bound(total: int, i: np.ndarray, alpha: float) -> np.ndarray:
    m = np.maximum(total - i - 1, 3)
    t = _t_quantile(1 - alpha / (2 * (total - i + 1)), m)
    return (total - i) * t / np.sqrt((m + t**2) * (total - i + 1))


def extreme_deviates(rest: np.ndarray, scatter: float, alpha: float = 0.05, share: float = 0.25) -> np.ndarray:
    """Generalised ESD: mask of the remainders that are outliers at level ``alpha``, at most ``share`` of them.

    Deviations are taken from the median and scaled by the spread of what remains once the larger ones are out
    (never below the robust scatter's half), so outliers do not hide each other.
    """
    bins, n = counted(rest)
    return _beyond(rest, *_deviate_limit(_middles(bins), n, scatter, alpha, share))


def _beyond(rest: np.ndarray, centre: float, limit: float) -> np.ndarray:
    return np.abs(_middles(_bins(rest)) - centre) > limit


def usual(rest: tuple[np.ndarray, np.ndarray], steps: tuple[np.ndarray, np.ndarray], quantum: float, alpha: float = 0.05, share: float = 0.25) -> tuple[float, float, float]:
    """(scatter, centre, limit) of a source from the counted remainders and successive differences.

    The scatter is robust and not below half a ``quantum``, the least step between the values that occur; remainders
    further than ``limit`` from ``centre`` are suspects.
    """
    v, n = _middles(rest[0]), rest[1]
    scatter = max(_mad_of(v, n), _mad_of(_middles(steps[0]), steps[1]) / np.sqrt(2)) or 0.5 * quantum
    return scatter, *_deviate_limit(v, n, scatter, alpha, share)


def spikes(y: np.ndarray, max_spike: int = 3, factor: float = 8.0, side: int = 5, known: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is_spike, trend, season) of a series of plausible readings; ``known`` is the source's ``usual`` where the series is a part of it."""
    n = len(y)
    out = np.zeros(n, bool)
    if n < 5:
        return out, np.full(n, np.median(y) if n else 0.0), np.zeros(n)
    trend, season, rest = decompose(y)
    scatter, centre, limit = known or usual(counted(rest), counted(np.diff(y - season)), float(np.diff(np.unique(y)).min(initial=np.inf)) if y.min() < y.max() else 0.0)
    suspect = _beyond(rest, centre, limit)
    if scatter == 0 or not suspect.any():
        return out, trend, season
    z = y - season
    padded = np.pad(z, side, mode="edge")
    level = np.median(np.lib.stride_tricks.sliding_window_view(padded, side), axis=1)
    at = np.flatnonzero(suspect)
    for length in range(1, max_spike + 1):
        i = at[(at > 0) & (at + length < n)]
        i = i[np.logical_and.reduce([suspect[i + j] for j in range(length)])] if len(i) else i
        if not len(i):
            continue
        before, after = level[i], level[i + length + side]  # medians of the readings just before i and from i + length on
        lo, hi = np.minimum(before, after), np.maximum(before, after)
        part = z[i[:, None] + np.arange(length)]
        up, down = (part - hi[:, None]).min(1), (lo[:, None] - part).min(1)
        dev = np.maximum(up, down)
        sign = np.where(up >= down, 1.0, -1.0)
        edge = np.where(sign > 0, hi, lo)
        away = lambda v, s=sign, e=edge: s * (v - e)
        ok = (dev > factor * scatter) & (away(z[i - 1]) < 0.5 * dev) & (away(z[i + length]) < 0.5 * dev)
        for j in i[ok]:
            out[j : j + length] = True
    return out, trend, season


def equal_runs(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal successive values that each value belongs to."""
    if not len(x):
        return np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return np.repeat(np.diff(np.r_[start, len(x)]), np.diff(np.r_[start, len(x)]))


def judge(x: np.ndarray, lo: float, hi: float, min_run: int, max_spike: int, factor: float, known: tuple[float, float, float] | None = None) -> tuple[np.ndarray, ...]:
    """(trend, season, range, stuck, spike) of one stretch of a source in order of time."""
    out = (x < lo) | (x > hi)
    stuck = equal_runs(x) >= min_run
    spike, trend, season = np.zeros(len(x), bool), np.full(len(x), np.nan), np.zeros(len(x))
    ok = ~out
    if ok.any():
        spike[ok], trend[ok], season[ok] = spikes(x[ok], max_spike, factor, known=known)
    return trend, season, out, stuck, spike


def _by_segment(done: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``done`` over whole segments of a partition sorted by them, given the rows and where segments start; a segment may span batches."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        new[1:] = (t.column("seg").to_numpy()[1:] != t.column("seg").to_numpy()[:-1]) | (t.column("file_id").to_numpy()[1:] != t.column("file_id").to_numpy()[:-1])
        code = pc.dictionary_encode(t.column("topic").combine_chunks()).indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
        return np.append(np.flatnonzero(new), len(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = pa.Table.from_batches([b.slice(b.num_rows - 1)])
            if rest and len(starts(pa.Table.from_batches([rest[0].slice(0, 1), *last.to_batches()]).combine_chunks())) == 2:
                rest.append(b)  # all of one segment
                continue
            t = pa.Table.from_batches([*rest, b]).combine_chunks()
            at = starts(t)
            if len(at) > 2:
                yield done(t.slice(0, at[-2]), at[:-1])
            rest = t.slice(at[-2]).to_batches()
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            yield done(t, starts(t))

    return run


def _bounds(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return t.column("lo").fill_null(-np.inf).to_numpy(), t.column("hi").fill_null(np.inf).to_numpy()


def _judge_sorted(min_run: int, max_spike: int, factor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def done(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        x, own = t.column("reading").to_numpy(), t.column("own").to_numpy()
        lo, hi = _bounds(t)
        scatter, centre, limit = (t.column(c).to_numpy() for c in ("scatter", "centre", "limit"))
        known = lambda a: None if np.isnan(scatter[a]) else (scatter[a], centre[a], limit[a])
        parts = [judge(x[a:b], lo[a], hi[a], min_run, max_spike, factor, known(a)) for a, b in zip(at[:-1], at[1:], strict=True)]
        got = [np.concatenate(c)[own] for c in zip(*parts, strict=True)]
        keep = t.filter(pa.array(own))
        cols = [keep.column(c).combine_chunks() for c in names[:5]]
        return pa.RecordBatch.from_arrays([*cols, *map(pa.array, got)], names)

    return _by_segment(done)


_COUNTS = pa.schema([("file_id", pa.int64()), ("topic", pa.string()), ("kind", pa.int32()), ("bin", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])
#: Kinds of counts: remainders, differences, the source's least step, its segments, its distinct values.
_REST, _STEP, _QUANTUM, _SEGMENT, _VALUE = range(5)


def _count_sorted() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per segment of a cut source the counted remainders and successive differences of its own plausible readings, its number and their distinct values."""

    def done(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        x, own = t.column("reading").to_numpy(), t.column("own").to_numpy()
        file, topic, seg = t.column("file_id").to_numpy(), t.column("topic"), t.column("seg").to_numpy()
        lo, hi = _bounds(t)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            ok = (x[a:b] >= lo[a]) & (x[a:b] <= hi[a])
            y, mine = x[a:b][ok], own[a:b][ok]
            if not len(y):
                continue
            _, season, rest = decompose(y)
            parts = [(_REST, *counted(rest[mine]), None), (_STEP, *counted(np.diff(y - season)[mine[1:]]), None), (_SEGMENT, np.array([seg[a]]), np.ones(1, int), None)]
            values = np.unique(y[mine])
            parts.append((_VALUE, np.zeros(len(values), int), np.ones(len(values), int), values))
            for kind, bins, n, v in parts:
                m = len(n)
                out.append(pa.Table.from_arrays([pa.array(np.full(m, file[a])), pa.array([topic[a].as_py()] * m, pa.string()), pa.array(np.full(m, kind, np.int32)), pa.array(bins.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(m, pa.float64()) if v is None else pa.array(v)], schema=_COUNTS))
        batches = pa.concat_tables([_COUNTS.empty_table(), *out]).combine_chunks().to_batches()
        return batches[0] if batches else pa.RecordBatch.from_pylist([], _COUNTS)

    return _by_segment(done)


def _usual_of(counts: pd.DataFrame) -> pd.DataFrame:
    rest, steps = ((c["bin"].to_numpy(), c["n"].to_numpy().astype(np.int64)) for c in (counts[counts["kind"] == _REST], counts[counts["kind"] == _STEP]))
    quantum = counts.loc[counts["kind"] == _QUANTUM, "n"].min()
    segments, first = counts.loc[counts["kind"] == _SEGMENT, "bin"].to_numpy(), counts.iloc[0]
    got = usual(rest, steps, 0.0 if pd.isna(quantum) else float(quantum)) if len(rest[0]) else (0.0, 0.0, np.inf)
    return pd.DataFrame([(first["file_id"], first["topic"], k, *got) for k in segments], columns=["file_id", "topic", "seg", "scatter", "centre", "limit"])


def _usuals(cut: DataFrame) -> DataFrame:
    """``(file_id, topic, seg, scatter, centre, limit)`` of every segment of the sources that are cut, given sorted.

    A source's counts are a bounded number of bins; they are added up before they meet.
    """
    keys = ["file_id", "topic"]
    told = cut.mapInArrow(_count_sorted(), "file_id bigint, topic string, kind int, bin bigint, n bigint, value double")
    counts = told.where(F.col("kind") != _VALUE).groupBy(*keys, "kind", "bin").agg(F.sum("n").cast("double").alias("n"))
    # The least step between plausible values: inside and between ranges of values, each small enough for a task.
    values = told.where(F.col("kind") == _VALUE).select(*keys, F.col("value").alias("reading")).distinct()
    octave = F.when(F.col("reading") == 0, 0.0).otherwise(F.signum("reading") * (F.floor(F.log2(F.abs("reading")) * 64) + 1e6))
    inside = values.withColumn("range", octave).withColumn("step", F.col("reading") - F.lag("reading").over(Window.partitionBy(*keys, "range").orderBy("reading")))
    ranges = inside.groupBy(*keys, "range").agg(F.min("reading").alias("least"), F.max("reading").alias("most"), F.min("step").alias("step"))
    gaps = ranges.withColumn("gap", F.col("least") - F.lag("most").over(Window.partitionBy(*keys).orderBy("least")))
    quanta = gaps.groupBy(*keys).agg(F.min(F.least("step", "gap")).alias("n")).where("n is not null")
    every = counts.unionByName(quanta.select(*keys, F.lit(_QUANTUM).alias("kind"), F.lit(0).cast("bigint").alias("bin"), "n"))
    return every.groupBy(*keys).applyInPandas(_usual_of, "file_id bigint, topic string, seg bigint, scatter double, centre double, limit double")


def segmented(rows: DataFrame, segment: int = SEGMENT, halo: int = HALO) -> DataFrame:
    """Rows of ``(file_id, topic)`` series with ``seg``, ``own`` and ``n_seg``, small sources whole and large ones cut: equal segments of at most ``segment`` rows, with ``halo`` foreign rows on each side.

    Sources of up to two segments stay whole.  The rows of larger ones are numbered by their place in a block of
    time and the number of rows in earlier blocks, whatever their number.  ``rows`` has ``_block`` and is partitioned by
    source and block, where it stays; only counts of blocks move.
    """
    keys = ["file_id", "topic"]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("log_time", "msg_id"))
    at = rows.withColumn("_r", rank).join(offsets, [*keys, "_block"]).withColumn("_i", F.col("_offset") + F.col("_r") - 1)
    parts = F.expr(f"CASE WHEN _n <= {2 * segment} THEN 1L ELSE (_n + {segment - 1}) div {segment} END")
    at = at.withColumn("n_seg", parts).withColumn("seg", F.expr("(_i * n_seg) div _n"))
    # Row numbers at which the row's own segment and the next one begin.
    start, end = F.expr("(seg * _n + n_seg - 1) div n_seg"), F.expr("((seg + 1) * _n + n_seg - 1) div n_seg")
    before = F.when((F.col("_i") - start < halo) & (F.col("seg") > 0), F.col("seg") - 1)
    after = F.when((end - F.col("_i") <= halo) & (F.col("seg") < F.col("n_seg") - 1), F.col("seg") + 1)
    homes = F.filter(F.array(F.col("seg"), before, after), lambda v: v.isNotNull())
    return at.withColumn("home", F.explode(homes)).withColumn("own", F.col("home") == F.col("seg")).drop("seg", "_n", "_block", "_r", "_offset", "_i").withColumnRenamed("home", "seg")


def flag(readings: DataFrame, limits: DataFrame, min_run: int = 10, max_spike: int = 3, factor: float = 8.0) -> DataFrame:
    """Every judged reading with its decomposition and its three flags.

    ``readings`` has ``file_id, topic, msg_id, log_time, reading``; ``limits`` has ``topic, min_possible, max_possible``.
    """
    n = tasks(readings.sparkSession)
    ok = readings.where(F.col("reading").isNotNull() & ~F.isnan("reading") & F.col("log_time").isNotNull() & F.col("file_id").isNotNull() & F.col("topic").isNotNull() & F.col("msg_id").isNotNull())
    message = ["file_id", "topic", "_block", "msg_id", "log_time"]
    # All copies of a message lie in one block of time, so one exchange serves to remove them and to number the rest.
    blocks = ok.select("file_id", "topic", "msg_id", "log_time", F.col("reading").cast("double").alias("reading")).withColumn("_block", floor_div(F.col("log_time"), BLOCK_NS)).where(F.col("_block").isNotNull())
    # The filter keeps the reading in the branch that only counts, so that both share this exchange.
    rows = blocks.repartition(n, *message[:3]).groupBy(*message).agg(F.min("reading").alias("reading")).where(F.col("reading").isNotNull())
    bounds = limits.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.max("min_possible").alias("lo"), F.min("max_possible").alias("hi"))
    order = ["file_id", "topic", "seg", "log_time", "msg_id"]
    parts = segmented(rows).join(bounds, "topic", "left").select(*order, "reading", "lo", "hi", "own", "n_seg")
    dealt = parts.repartition(n, *order[:3])
    # Where a partition is asked for, the condition stays above the exchange, so that both uses share it.
    cut = dealt.where(F.when(F.spark_partition_id() >= 0, F.col("n_seg")) > 1)
    usuals = _usuals(cut.sortWithinPartitions(*order))
    known = dealt.join(usuals, order[:3], "left")
    own = [F.when(F.col("n_seg") == 1, float("nan")).otherwise(F.coalesce("scatter", F.lit(0.0))).alias("scatter"), F.coalesce("centre", F.lit(0.0)).alias("centre"), F.coalesce("limit", F.lit(float("inf"))).alias("limit")]
    return known.select(*order, "reading", "lo", "hi", "own", *own).sortWithinPartitions(*order).mapInArrow(_judge_sorted(min_run, max_spike, factor), _ROWS)
