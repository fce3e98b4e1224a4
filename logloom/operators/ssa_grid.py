"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Readings are averaged per source and period.  The periods between a source's
first and last reading form its grid; the missing ones are filled by singular-
spectrum analysis: embed the series in a Hankel trajectory matrix, keep its
leading singular vectors, average along anti-diagonals, put the result into the
gaps, repeat until the gaps stop moving.

Before that a series is centred and scaled by median and median deviation, and
readings that leap out of their neighbourhood take no part in the fit (their own
periods keep them).  Window and rank are chosen per series among ``SHAPES`` by the
error at held-out periods; the narrowest shape has the straight line for its fixed point,
so erratic series are filled by a line and smooth or periodic ones by more.

Every period says where its value comes from: ``how`` is ``reading``, ``spectrum``,
``unsettled`` (the gaps still moved after ``ROUNDS`` rounds) or ``line`` (segments with fewer than
``LEAST`` readings, constant ones, and those without any, between the readings on either side).

A source is cut into segments of ``SEGMENT`` periods that see ``HALO`` periods of
their neighbours, so no task holds a source of unbounded length, and the
trajectory matrix has a bounded size.  The series of a batch are filled together.

Defined cases: null or unusable readings and rows without time or source count as no reading;
repeated rows (same message id) count once; several readings in a period are averaged;
a source with a single reading has one period; a constant source is filled with
the constant; an empty table gives an empty grid; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.exact import floor_div
from logloom.session import tasks

SECOND = 1_000_000_000
SEGMENT, HALO = 1024, 64


#: (window, rank) of the trajectory matrices that are tried; rounds at most; movement, in scatters, below which gaps stand still.
SHAPES, ROUNDS, TOLERANCE = ((2, 1), (3, 1), (4, 1), (6, 2), (12, 2)), 2000, 1e-3
#: Readings a series needs; rounds and folds (which readings are held out, of how many) when shapes are compared; numbers in the trajectories of a block of series.
LEAST, TRIAL, FOLDS, EVERY, CELLS = 6, 12, (1, 4), 6, 1 << 20


def leaps(y: np.ndarray, factor: float = 6.0) -> np.ndarray:
    """Mask of readings further from the median of their five neighbours than ``factor`` times what is usual."""
    if len(y) < 7:
        return np.zeros(len(y), bool)
    mid = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, 2, mode="edge"), 5), axis=1)
    off = np.abs(y - mid)
    return off > factor * max(1.4826 * np.median(off), np.median(np.abs(np.diff(y))), 1e-300)


def spectrum(z: np.ndarray, n: np.ndarray, gap: np.ndarray, window: int, rank: int, rounds: int, tol: float = TOLERANCE) -> np.ndarray:
    """Fill the gaps of many series in place, row by row of ``z`` with lengths ``n``; a mask of those that stand still.

    A round costs ``O(length * window)`` numbers per series, whatever the gaps.
    """
    still = ~gap.any(1)
    active = np.flatnonzero(~still)
    k = z.shape[1] - window + 1
    valid = (np.arange(k)[None, :] + window <= n[:, None]).astype(float)
    weight = np.zeros(z.shape)
    for j in range(window):
        weight[:, j : j + k] += valid
    np.maximum(weight, 1, out=weight)
    step = np.zeros(z.shape)
    for r in range(rounds):
        if not len(active):
            break
        y, g = z[active], gap[active]
        traj = np.lib.stride_tricks.sliding_window_view(y, window, axis=1) * valid[active][:, :, None]
        _, vec = np.linalg.eigh(traj.transpose(0, 2, 1) @ traj)
        lead = vec[:, :, -rank:]
        low = traj @ (lead @ lead.transpose(0, 2, 1))
        total = np.zeros(y.shape)
        for j in range(window):
            total[:, j : j + k] += low[:, :, j]
        new = np.where(g, total / weight[active], y)
        now, last = new - y, step[active]
        moved = np.abs(now).max(1)
        if r % 4 == 3:
            # Steps that shrink by a steady ratio are summed up at once (Aitken); the next rounds go on from there.
            ratio = np.clip((now * last).sum(1) / np.maximum((last * last).sum(1), 1e-300), 0, 0.98)
            new += now * np.where(moved < tol, 0, ratio / (1 - ratio))[:, None]
        step[active] = now
        z[active] = new
        still[active[moved < tol]] = True
        active = active[moved >= tol]
    return still


def _block(series: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> list[tuple[np.ndarray, bool]]:
    """(values, settled) of scaled series, given with the mask of what is to be filled; all are padded to the longest."""
    n = np.array([len(z) for z, _ in series])
    m = np.arange(n.max())
    z, gap = np.zeros((len(n), len(m))), np.zeros((len(n), len(m)), bool)
    for k, (y, g) in enumerate(series):
        z[k, : n[k]], gap[k, : n[k]] = y, g
    inside = m[None, :] < n[:, None]

    def line(open_: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = z[rows].copy()
        for j, r in enumerate(rows):
            seen = np.flatnonzero(~open_[j] & inside[r])
            out[j, : n[r]] = np.interp(m[: n[r]], seen, z[r, seen])
        return out

    # How far each shape is off at held-out readings.
    place = np.cumsum(~gap & inside, 1) - 1
    error = np.full((len(n), len(SHAPES)), np.inf)
    for s, (window, rank) in enumerate(SHAPES):
        rows = np.flatnonzero(n >= 2 * window + 2)
        if not len(rows):
            continue
        error[rows, s] = 0.0
        for fold in FOLDS:
            held = (place[rows] % EVERY == fold) & ~gap[rows] & inside[rows]
            open_ = gap[rows] | held
            y = line(open_, rows)
            spectrum(y, n[rows], open_, window, rank, TRIAL)
            error[rows, s] += np.minimum(np.abs(y - z[rows]) * held, 3).sum(1)
    best = error.argmin(1)
    # A wider window must earn its place.
    best[error[np.arange(len(n)), best] > 0.97 * error[:, 0]] = 0
    out: list = [None] * len(n)
    for s, (window, rank) in enumerate(SHAPES):
        rows = np.flatnonzero(best == s)
        if not len(rows):
            continue
        y = line(gap[rows], rows)
        still = spectrum(y, n[rows], gap[rows], window, rank, rounds)
        for j, r in enumerate(rows):
            out[r] = y[j, : n[r]], bool(still[j])
    return out


def hankel_fill(series: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> list[tuple[np.ndarray, str]]:
    """Each of many series ``(x, missing)`` with its gaps filled by iterative SSA, and how."""
    out: list[tuple[np.ndarray, str]] = []
    todo: list[tuple[int, np.ndarray, np.ndarray, float, float]] = []
    for k, (x, missing) in enumerate(series):
        seen = np.flatnonzero(~missing)
        y = np.interp(np.arange(len(x)), seen, x[seen]) if len(seen) else x
        out.append((y, "line"))
        if len(seen) < LEAST or not missing.any():
            continue
        centre = float(np.median(x[seen]))
        scale = 1.4826 * float(np.median(np.abs(x[seen] - centre))) or float(x[seen].std())
        if not scale or not np.isfinite(scale):
            continue
        open_ = missing.copy()
        open_[seen[leaps(x[seen])]] = True
        if (~open_).sum() >= LEAST:
            todo.append((k, (x - centre) / scale, open_, centre, scale))
    todo.sort(key=lambda t: len(t[1]))
    block: list = []

    def settle() -> None:
        for (k, z, open_, centre, scale), (y, still) in zip(block, _block([(np.where(t[2], 0.0, t[1]), t[2]) for t in block], rounds), strict=True):
            fit = z[~open_]
            lo, hi = fit.min(), fit.max()
            x, missing = series[k]
            filled = np.clip(y, lo - 0.5 * (hi - lo), hi + 0.5 * (hi - lo)) * scale + centre
            out[k] = np.where(missing, filled, x), "spectrum" if still else "unsettled"
        block.clear()

    for t in todo:
        if block and (len(block) + 1) * len(t[1]) * SHAPES[-1][0] > CELLS:
            settle()
        block.append(t)
    if block:
        settle()
    return out


_OUT = pa.schema([("file_id", pa.int64()), ("topic", pa.string()), ("slot", pa.int64()), ("value", pa.float64()), ("n_readings", pa.int64()), ("filled", pa.bool_()), ("how", pa.string())])


def _starts(t: pa.Table) -> np.ndarray:
    """Row numbers at which another segment begins, and the number of rows."""
    topic = t.column("topic").combine_chunks()
    code = pc.dictionary_encode(topic).indices.to_numpy() if len(topic) else np.empty(0, int)
    new = np.ones(len(t), bool)
    new[1:] = code[1:] != code[:-1]
    for c in ("file_id", "seg"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(t))


def _fill(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    slot, seg = t.column("slot").to_numpy(), t.column("seg").to_numpy()
    x = t.column("value").to_numpy(zero_copy_only=False).astype(float)
    n = t.column("n_readings").to_numpy()
    around = [t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("ps", "pv", "ns", "nv")]
    missing = n == 0
    how = np.where(missing, "line", "reading").astype(object)
    open_: list[tuple[int, int]] = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if missing[a:b].all():
            ps, pv, ns, nv = (c[a] for c in around)
            x[a:b] = np.interp(slot[a:b], [ps, ns], [pv, nv])
        elif missing[a:b].any():
            open_.append((a, b))
    for (a, b), (y, kind) in zip(open_, hankel_fill([(x[a:b], missing[a:b]) for a, b in open_]), strict=True):
        x[a:b] = y
        how[a:b][missing[a:b]] = kind
    own = slot // SEGMENT == seg
    topic = t.column("topic").combine_chunks().filter(pa.array(own))
    return pa.RecordBatch.from_arrays([pa.array(t.column("file_id").to_numpy()[own]), topic.cast(pa.string()), pa.array(slot[own]), pa.array(x[own]), pa.array(n[own]), pa.array(missing[own]), pa.array(how[own], pa.string())], schema=_OUT)


def _fill_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill each segment of a partition sorted by segment and slot; a segment may span batches."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*rest, b]).combine_chunks()
        at = _starts(t)
        if len(at) > 2:
            yield _fill(t.slice(0, at[-2]), at[:-1])
        rest = t.slice(at[-2]).to_batches()
    if rest:
        t = pa.Table.from_batches(rest).combine_chunks()
        yield _fill(t, _starts(t))


def regular_grid(readings: DataFrame, period_ns: int = 10 * SECOND) -> DataFrame:
    """``(file_id, topic, slot, value, n_readings, filled, how)`` for every period from a source's first to its last reading.

    ``readings`` has ``file_id, topic, msg_id, log_time, reading``; ``slot`` is ``floor(log_time / period_ns)``.
    """
    n = tasks(readings.sparkSession)
    slot = floor_div(F.col("log_time"), period_ns)
    ok = readings.where(F.col("reading").isNotNull() & ~F.isnan("reading") & F.col("log_time").isNotNull() & F.col("file_id").isNotNull() & F.col("topic").isNotNull())
    rows = ok.select("file_id", "topic", slot.alias("slot"), "msg_id", F.col("reading").cast("double").alias("reading"))
    # What the join below asks of the slot is asked here, so that both uses of the means share one scan and exchange.
    rows = rows.where(F.col("slot").isNotNull())
    # Copies of a message lie in the same slot, so one exchange serves both steps.
    once = rows.repartition(n, "file_id", "topic", "slot").groupBy("file_id", "topic", "slot", "msg_id").agg(F.min("reading").alias("reading"))
    filled = once.groupBy("file_id", "topic", "slot").agg(F.avg("reading").alias("value"), F.count("reading").alias("n_readings"))
    seg = lambda c: floor_div(c, SEGMENT)
    # One row per segment with readings, unfolded to those without up to the next; their anchors are what stands before and after.
    by_seg = filled.groupBy("file_id", "topic", seg(F.col("slot")).alias("seg")).agg(F.min("slot").alias("s0"), F.max("slot").alias("s1"), F.min_by("value", "slot").alias("v0"), F.max_by("value", "slot").alias("v1"))
    source = Window.partitionBy("file_id", "topic")
    ahead = source.orderBy("seg")
    segs = by_seg.select(
        "file_id", "topic", F.min("s0").over(source).alias("lo"), F.max("s1").over(source).alias("hi"), F.col("seg").alias("from"),
        F.coalesce(F.lead("seg").over(ahead) - 1, F.col("seg")).alias("to"), F.col("s1").alias("ps"), F.col("v1").alias("pv"),
        F.lead("s0").over(ahead).alias("ns"), F.lead("v0").over(ahead).alias("nv"),
    ).withColumn("seg", F.explode(F.sequence("from", "to")))
    frame = segs.select("file_id", "topic", "seg", "ps", "pv", "ns", "nv", F.explode(F.sequence(F.greatest("lo", F.col("seg") * SEGMENT - HALO), F.least("hi", (F.col("seg") + 1) * SEGMENT - 1 + HALO))).alias("slot"))
    grid = frame.join(filled, ["file_id", "topic", "slot"], "left").select("file_id", "topic", "seg", "slot", "value", F.coalesce("n_readings", F.lit(0)).alias("n_readings"), "ps", "pv", "ns", "nv")
    parts = grid.repartition(n, "file_id", "topic", "seg").sortWithinPartitions("file_id", "topic", "seg", "slot")
    return parts.mapInArrow(_fill_sorted, "file_id bigint, topic string, slot bigint, value double, n_readings bigint, filled boolean, how string")
