"""Late and out-of-order events: event-time windows with a lateness cut-off, over a finished table.

Messages are replayed in order of arrival.  The watermark of a source is the
largest event time that arrived before; a message behind it by at most the
allowed lateness still corrects its window, one further behind is diverted.
``logloom.streaming.lateness`` does the same on a stream with keyed state; here
the running maximum is computed in parallel: maxima per time block of a source,
a prefix maximum over those few rows, then a running maximum inside blocks.  No
task holds a whole source.

Defined cases:

* a message stored several times counts once, at its earliest arrival (on a
  tie, with the smallest event time, then size);
* an event time that is null, 0 or further ahead of the arrival than
  ``max_ahead_ns`` is unusable: such messages are set apart as ``invalid`` and
  move no watermark;
* messages without id, arrival time or source are ``invalid`` too, each as it is;
* equal arrivals are ordered by id; null payloads have 0 bytes;
* an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.exact import floor_div
from logloom.session import tasks

SECOND = 1_000_000_000
#: Arrival time handled by one window partition.
BLOCK_NS = 120 * SECOND


def classify(df: DataFrame, source: list[str], lateness_ns: int = 60 * SECOND, max_ahead_ns: int = 5 * SECOND) -> DataFrame:
    """Each message once: ``(source..., msg_id, log_time, publish_time, n_bytes, behind_ns, status)``.

    ``status`` is ``on_time`` (at or ahead of the watermark), ``late`` (behind,
    within the cut-off), ``dropped`` (beyond it) or ``invalid``.
    """
    keyed = F.col("msg_id").isNotNull() & F.col("log_time").isNotNull()
    for c in source:
        keyed = keyed & F.col(c).isNotNull()
    rows = df.select(*source, "msg_id", "log_time", "publish_time", F.coalesce(F.octet_length("data"), F.lit(0)).alias("n_bytes"))
    n = tasks(df.sparkSession)
    # One exchange finds the earliest copy; copies are too rare for combining before it to pay.
    copies = Window.partitionBy(*source, "msg_id").orderBy("log_time", "publish_time", "n_bytes")
    first = rows.where(keyed).repartition(n, "msg_id").withColumn("_r", F.row_number().over(copies)).where("_r = 1").drop("_r")
    usable = F.col("publish_time").isNotNull() & (F.col("publish_time") != 0) & (F.col("publish_time") <= F.col("log_time") + max_ahead_ns)
    tagged = first.withColumn("_block", F.when(usable, floor_div(F.col("log_time"), BLOCK_NS)))
    invalid = tagged.where(F.col("_block").isNull()).drop("_block").unionByName(rows.where(~keyed))

    # Both the maxima of the blocks and the rows read the same exchange.
    by_block = [*source, "_block"]
    good = tagged.where(F.col("_block").isNotNull()).repartition(n, *by_block)
    blocks = good.groupBy(*by_block).agg(F.max("publish_time").alias("_top"))
    prior = Window.partitionBy(*source).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by_block, F.max("_top").over(prior).alias("_carried"))
    inside = Window.partitionBy(*by_block).orderBy("log_time", "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    run = good.withColumn("_seen", F.max("publish_time").over(inside))
    behind = F.greatest(F.coalesce(F.greatest("_seen", "_carried"), F.col("publish_time")) - F.col("publish_time"), F.lit(0))
    done = run.join(carried, by_block).withColumn("behind_ns", behind)
    status = F.when(F.col("behind_ns") > lateness_ns, "dropped").when(F.col("behind_ns") > 0, "late").otherwise("on_time")
    return done.select(*source, "msg_id", "log_time", "publish_time", "n_bytes", "behind_ns", status.alias("status")).unionByName(invalid.select(*source, "msg_id", "log_time", "publish_time", "n_bytes", F.lit(None).cast("bigint").alias("behind_ns"), F.lit("invalid").alias("status")))


def windows(classified: DataFrame, keys: list[str], window_ns: int = 60 * SECOND) -> DataFrame:
    """Corrected aggregates per key and window of event time.

    ``(keys..., window_start, n_first, n_messages, n_bytes, n_late, n_beyond)``: ``n_first`` is what stood
    before corrections, ``n_messages`` and ``n_bytes`` hold on-time and late messages, ``n_beyond`` counts
    those set apart.
    """
    start = (floor_div(F.col("publish_time"), window_ns) * window_ns).alias("window_start")
    is_ = lambda *s: F.col("status").isin(*s)
    number = lambda cond: F.count(F.when(cond, 1))
    return classified.where(F.col("status") != "invalid").groupBy(*keys, start).agg(
        number(is_("on_time")).alias("n_first"),
        number(is_("on_time", "late")).alias("n_messages"),
        F.coalesce(F.sum(F.when(is_("on_time", "late"), F.col("n_bytes"))), F.lit(0)).alias("n_bytes"),
        number(is_("late")).alias("n_late"),
        number(is_("dropped")).alias("n_beyond"),
    )
