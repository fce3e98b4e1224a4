"""Late and out-of-order events on a stream: keyed state, upserts, diverted messages.

Each source keeps the largest event time seen and its open windows.  A micro-batch
replays a source's new messages in order of arrival: on-time and late ones change
their window, whose new totals are emitted as an upsert; messages behind the
watermark by more than the allowed lateness are emitted apart.  A window leaves the
state once no message can change it any more.

``sink`` writes both kinds of rows per micro-batch into folders named by the batch, which
makes a repeated batch overwrite itself; ``current`` reads the latest totals and ``apart`` what was diverted.
``replay`` lays a stored table out as a stream: slices in order of arrival, of which a
trigger reads one, so that a trigger holds a bounded number of messages.  A source's new messages of
one trigger are one group, handled as arrays; no group holds a source's past.

Defined cases are those of ``logloom.operators.lateness``.  Every source is judged by its own
times only, so sources may be any time apart and arrive in any order.  A source keeps the ids it has seen, so a copy
is left out however late it comes.  For sources without end a horizon ``dedupe_within`` may be set: then ids leave the state that
far behind the largest arrival time, a message further back, which can no longer be told from a copy, is set apart
as ``dropped``, and a copy that comes later than the horizon counts again.  With ``idle`` a source's state is given up
after that long without messages (of running queries; one that ends with its input, as ``availableNow``, needs none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.session import checkpointed, ship, tasks

SECOND = 1_000_000_000
#: Messages of a trigger, about, when a table is replayed.
TRIGGER_ROWS = 2_000_000
_STATE = "top bigint, start array<bigint>, first array<bigint>, late array<bigint>, bytes array<bigint>, seen bigint, ids array<bigint>, id_at array<bigint>"
_TOTALS = "kind string, window_start bigint, n_first bigint, n_messages bigint, n_bytes bigint, n_late bigint, msg_id bigint, log_time bigint, publish_time bigint, behind_ns bigint"
_NAMES = [x.split()[0] for x in _TOTALS.split(", ")]
_LEAST = np.iinfo(np.int64).min


def _apart(kind: str, rows: pd.DataFrame, start: np.ndarray | None = None, behind: np.ndarray | None = None) -> pd.DataFrame:
    out = pd.DataFrame({"kind": [kind] * len(rows)})
    for c in _NAMES[1:]:
        out[c] = pd.array([None] * len(rows), dtype="Int64")
    for c in ("msg_id", "log_time", "publish_time"):
        out[c] = pd.arrays.IntegerArray(rows[c].to_numpy(np.int64).copy(), rows[f"no_{c}"].to_numpy(bool).copy())
    if start is not None:
        out["window_start"], out["behind_ns"] = pd.array(start, dtype="Int64"), pd.array(behind, dtype="Int64")
    return out


def stream_windows(messages: DataFrame, source: list[str], window_ns: int = 60 * SECOND, lateness_ns: int = 60 * SECOND, max_ahead_ns: int = 5 * SECOND, dedupe_within: str | None = None, idle: str | None = None) -> DataFrame:
    """Rows of ``kind`` ``window`` (new totals of one window), ``dropped`` and ``invalid`` (single messages), with the source columns.

    ``messages`` has ``msg_id, log_time, publish_time`` and either ``data`` or ``n_bytes``.
    """
    ship(messages.sparkSession)
    within = pd.Timedelta(dedupe_within).value if dedupe_within else None
    wait = int(pd.Timedelta(idle).value // 10**6) if idle else None
    # Nulls travel as flags: pandas would turn the column into doubles, which cannot hold nanoseconds.
    times = ["msg_id", "log_time", "publish_time"]
    size = F.col("n_bytes") if "n_bytes" in messages.columns else F.octet_length("data")
    rows = messages.select(*source, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in times], *[F.col(c).isNull().alias(f"no_{c}") for c in times], F.coalesce(size, F.lit(0)).cast("bigint").alias("n_bytes"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in source)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        top, start, first, late, size, seen, ids, id_at = state.get if state.exists else (None, [], [], [], [], None, [], [])
        new = pd.concat(list(frames), ignore_index=True)
        lacking = (new["no_msg_id"] | new["no_log_time"]).to_numpy(bool) | any(pd.isna(k) for k in key)
        # Most sources set nothing apart, and an empty frame costs as much as a full one.
        out = [_apart("invalid", new[lacking])] if lacking.any() else []
        new = (new[~lacking] if out else new).sort_values(["log_time", "msg_id", "publish_time", "n_bytes"], kind="stable").drop_duplicates("msg_id")
        known, known_at = np.array(ids, np.int64), np.array(id_at, np.int64)
        if len(known):
            new = new[~np.isin(new["msg_id"].to_numpy(np.int64), known)]
        log, pub = new["log_time"].to_numpy(np.int64), new["publish_time"].to_numpy(np.int64)
        old = np.zeros(len(new), bool)
        if within is not None and len(new):
            past = np.maximum.accumulate(np.r_[_LEAST if seen is None else seen, log])[:-1]
            old = (past != _LEAST) & (log < past - within)
        if len(new):
            seen = int(max(log.max(), _LEAST if seen is None else seen))
        known = np.r_[known, new["msg_id"].to_numpy(np.int64)[~old]]
        if within is not None:
            known_at = np.r_[known_at, log[~old]]
            held = known_at >= (seen if seen is not None else _LEAST) - within if len(known_at) else np.zeros(0, bool)
            known, known_at = known[held], known_at[held]
        bad = new["no_publish_time"].to_numpy(bool) | (pub == 0) | (pub > log + max_ahead_ns)
        good = new
        if bad.any():
            out.append(_apart("invalid", new[bad]))
            good, pub, old = new[~bad], pub[~bad], old[~bad]
        # The watermark before each message; one that is set apart never raises it.
        marks = np.maximum.accumulate(np.r_[_LEAST if top is None else top, np.where(old, _LEAST, pub)])
        behind = np.where(marks[:-1] == _LEAST, 0, np.maximum(marks[:-1] - pub, 0))
        at = pub // window_ns * window_ns
        drop = old | (behind > lateness_ns)
        if drop.any():
            out.append(_apart("dropped", good[drop], at[drop], behind[drop]))
        if len(marks) > 1 and marks[-1] != _LEAST:
            top = int(marks[-1])
        open_ = {s: [f, n, b] for s, f, n, b in zip(start, first, late, size, strict=True)}
        changed, where = np.unique(at[~drop], return_inverse=True)
        if len(changed):
            on_time = behind[~drop] == 0
            sums = [np.bincount(where, w, len(changed)).astype(np.int64) for w in (on_time, ~on_time)]
            total = np.zeros(len(changed), np.int64)
            np.add.at(total, where, good["n_bytes"].to_numpy(np.int64)[~drop])
            totals = []
            for s, f, n, b in zip(changed.tolist(), *map(list, (sums[0].tolist(), sums[1].tolist(), total.tolist())), strict=True):
                w = open_.setdefault(s, [0, 0, 0])
                w[0], w[1], w[2] = w[0] + f, w[1] + n, w[2] + b
                totals.append(w)
            got = pd.DataFrame({"kind": ["window"] * len(changed), "window_start": pd.array(changed, dtype="Int64")})
            for c, v in (("n_first", [w[0] for w in totals]), ("n_messages", [w[0] + w[1] for w in totals]), ("n_bytes", [w[2] for w in totals]), ("n_late", [w[1] for w in totals])):
                got[c] = pd.array(v, dtype="Int64")
            for c in _NAMES[6:]:
                got[c] = pd.array([None] * len(changed), dtype="Int64")
            out.append(got)
        kept = sorted(s for s in open_ if top is None or s + window_ns > top - lateness_ns)
        state.update((top, kept, [open_[s][0] for s in kept], [open_[s][1] for s in kept], [open_[s][2] for s in kept], seen, known.tolist(), known_at.tolist()))
        if wait is not None:
            state.setTimeoutDuration(wait)
        for part in out:
            if len(part):
                for k, c in enumerate(source):
                    part.insert(k, c, key[k])
                yield part

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(*source).applyInPandasWithState(step, f"{kinds}, {_TOTALS}", _STATE, "update", timeout)


def sink(updates: DataFrame, folder: str, checkpoint: str, source: list[str], **trigger: object):
    """Start the query; ``trigger`` as of ``DataStreamWriter.trigger``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def current(spark: SparkSession, folder: str, source: list[str]) -> DataFrame:
    """The latest totals of every window."""
    latest = Window.partitionBy(*source, "window_start").orderBy(F.desc("batch"))
    rows = spark.read.parquet(folder).where("kind = 'window'").withColumn("_r", F.row_number().over(latest)).where("_r = 1")
    return rows.select(*source, "window_start", "n_first", "n_messages", "n_bytes", "n_late")


def apart(spark: SparkSession, folder: str, source: list[str]) -> DataFrame:
    """Messages that were set apart, with why."""
    return spark.read.parquet(folder).where("kind <> 'window'").select("kind", *source, "window_start", "msg_id", "log_time", "publish_time", "behind_ns")


def replay(messages: DataFrame, source: list[str], folder: str, trigger_rows: int = TRIGGER_ROWS) -> DataFrame:
    """A stored table as a stream of its messages in order of arrival.

    Slices of arrival time are written one after the other, each with a source's messages in one file; a trigger reads one
    slice.  Payloads are not copied, only their sizes.
    """
    spark = messages.sparkSession
    slim = checkpointed(messages.select(*source, "msg_id", "log_time", "publish_time", F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint").alias("n_bytes")))
    n = tasks(spark)
    slices = max(2, -(-slim.count() // trigger_rows))
    cuts = slim.agg(F.percentile_approx("log_time", [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = slim.where((F.lit(True) if hi is None else F.coalesce("log_time", F.lit(hi)) <= hi) & (F.lit(True) if lo is None else F.col("log_time") > lo))
        part.repartition(n, *source).write.mode("append").parquet(folder)
    # A slice has at most one file per partition, and files are read in the order of their times.
    return spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", n).parquet(folder)


def replayed(messages: DataFrame, source: list[str], folder: str, **options: object) -> str:
    """Run ``stream_windows`` over a stored table to its end; the folder that ``current`` and ``apart`` read."""
    stream = replay(messages, source, f"{folder}/arrivals")
    query = sink(stream_windows(stream, source, **options), f"{folder}/updates", f"{folder}/state", source)
    query.awaitTermination()
    return f"{folder}/updates"
