"""Matching records by nearest time: an as-of join by tick expansion.

Time is cut into ticks.  Every right record is copied to each tick within
tolerance of it, so left and right meet by an equi-join on (entity, tick) and no
range join or sort over an entity is needed.  Per entity-tick only records that
can be nearest to some instant of the tick are kept: the last one before it, the
first one after it, and those inside.  Where ticks are as fine as the clock that
is a single record; with nanosecond clocks the left picks the nearest among the few.

Both sides are exchanged once, by entity and a block of time that holds many ticks: a
right record goes to each block its ticks reach, mostly one, and is copied to its ticks only there.
The ticks of a block become one compact map that its left rows look themselves up in.  A hot entity is spread over
its blocks; a block holds what one entity records in ``block_ns``, which does not grow with the table.

Defined cases: rows with a null time or entity match nothing (``keep_unmatched``
keeps such left rows); equal distances are decided by the smaller right id;
repeated rows count once; several left rows may take the same right row; empty
tables give an empty result; only the named columns are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.exact import floor_div
from logloom.session import tasks

MILLI = 1_000_000


def nearest(left: DataFrame, right: DataFrame, entity: dict[str, tuple[Column, Column]], left_id: str, right_id: str, left_time: str = "log_time", right_time: str = "log_time", tolerance_ns: int = 40 * MILLI, tick_ns: int = 20 * MILLI, block_ns: int = 2000 * MILLI, keep_unmatched: bool = False) -> DataFrame:
    """For each left row the right row of the same entity nearest in time within ``tolerance_ns``.

    ``entity`` names each part of the key with its expression on either side.
    Returns ``(left_id, right_id, gap_ns)``, ``gap_ns`` being right minus left.
    """
    keys = list(entity)
    n = tasks(left.sparkSession)
    per_block = max(block_ns // tick_ns, 1)
    tick = lambda c: floor_div(c, tick_ns)
    block = lambda c: floor_div(tick(c), per_block)
    le = left.select(*[e[0].alias(k) for k, e in entity.items()], F.col(f"`{left_id}`").alias("_lid"), F.col(f"`{left_time}`").alias("_lt"))
    le = le.withColumn("_block", block(F.col("_lt"))).repartition(n, *keys, "_block").distinct()
    ri = right.select(*[e[1].alias(k) for k, e in entity.items()], F.col(f"`{right_id}`").alias("_rid"), F.col(f"`{right_time}`").alias("_rt"))
    known = F.col("_rt").isNotNull() & F.col("_rid").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    near_blocks = F.sequence(block(F.col("_rt") - tolerance_ns), block(F.col("_rt") + tolerance_ns))
    ri = ri.where(known).withColumn("_block", F.explode(near_blocks)).repartition(n, *keys, "_block")
    one = ri.groupBy(*keys, "_block", "_rt").agg(F.min("_rid").alias("_rid"))
    # The ticks of the block that the record reaches.
    low, high = F.greatest(tick(F.col("_rt") - tolerance_ns), F.col("_block") * per_block), F.least(tick(F.col("_rt") + tolerance_ns), F.col("_block") * per_block + (per_block - 1))
    spread = one.select(*keys, "_block", "_rt", "_rid", F.explode(F.sequence(low, high)).alias("_tick"))
    rec = F.struct(F.col("_rt").alias("t"), F.col("_rid").alias("id"))
    first, end = F.col("_tick") * tick_ns, (F.col("_tick") + 1) * tick_ns
    # min_by/max_by on longs aggregate in hash tables; the rows inside a tick are few.
    per_tick = spread.groupBy(*keys, "_block", "_tick").agg(
        F.max(F.when(F.col("_rt") < first, F.col("_rt"))).alias("bt"),
        F.max_by(F.col("_rid"), F.when(F.col("_rt") < first, F.col("_rt"))).alias("bid"),
        F.min(F.when(F.col("_rt") >= end, F.col("_rt"))).alias("at"),
        F.min_by(F.col("_rid"), F.when(F.col("_rt") >= end, F.col("_rt"))).alias("aid"),
        F.collect_list(F.when((F.col("_rt") >= first) & (F.col("_rt") < end), rec)).alias("inside"),
    )
    edge = lambda t, i: F.when(F.col(t).isNotNull(), F.array(F.struct(F.col(t).alias("t"), F.col(i).alias("id")))).otherwise(F.array().cast("array<struct<t:bigint,id:bigint>>"))
    near = F.concat(F.col("inside"), edge("bt", "bid"), edge("at", "aid"))
    index = per_tick.groupBy(*keys, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_tick", near.alias("near")))).alias("_ticks"))
    ranked = F.array_min(F.transform(F.try_element_at("_ticks", tick(F.col("_lt"))), lambda r: F.struct(F.abs(r["t"] - F.col("_lt")).alias("d"), r["id"].alias("id"), r["t"].alias("t"))))
    met = le.join(index, [*keys, "_block"], "left" if keep_unmatched else "inner").withColumn("_best", ranked)
    hit = F.col("_best.d") <= tolerance_ns
    got = met.select(F.col("_lid").alias(left_id), F.when(hit, F.col("_best.id")).alias(right_id), F.when(hit, F.col("_best.t") - F.col("_lt")).alias("gap_ns"))
    return got if keep_unmatched else got.where(F.col(right_id).isNotNull())


def mount(topic: str = "topic") -> Column:
    """MOUNT of a topic like ``/lidar/MOUNT/points``; null where the topic has no such form."""
    m = F.regexp_extract(F.col(topic), r"^/[^/]+/([^/]+)/[^/]+$", 1)
    return F.when(m != "", m)
