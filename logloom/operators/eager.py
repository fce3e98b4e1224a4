"""Per-key results without skew: eager aggregation through a join.

Both inputs are aggregated by join key *before* they meet, so the join moves one
compact state per key instead of rows, and a key that holds a third of all rows
costs the join no more than any other.  The joined states combine algebraically:
over ``left JOIN right`` a count is ``n_left * n_right``, and a sum of a left
column is ``sum_left * n_right``; then the states roll up to the group columns.

Distinct counts are such a state as well: rows go once to (key, slice of ids), in which
no hot key exists; what meets there is de-duplicated and counted, and only a
count per (key, slice) moves on.

Defined cases: null keys form a group of their own in the aggregates but, as in
SQL, join nothing (``keep_left`` keeps left groups without partner, with counts
and sums of the right side 0); null ids and null measures are not counted; empty inputs give empty results;
further columns, also with equal names on both sides, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import tasks

#: Slices per key of a distinct count.
SLICES = 64


def distinct_per_key(df: DataFrame, keys: list[str], id_col: str, out: str = "n_distinct") -> DataFrame:
    """Exact number of distinct non-null ``id_col`` per key; the rows are exchanged once, spread by slices of the ids."""
    k = [F.col(f"`{c}`") for c in keys]
    ids = df.select(*k, F.col(f"`{id_col}`").alias("_id")).withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)))
    dealt = ids.repartition(tasks(df.sparkSession), *keys, "_slice")
    once = dealt.groupBy(*k, "_slice", "_id").agg(F.lit(1).alias("_one"))
    part = once.groupBy(*k, "_slice").agg(F.count("_id").alias("_n"))
    return part.groupBy(*k).agg(F.sum("_n").alias(out))


def state(df: DataFrame, keys: list[str], sums: dict[str, Column], count: str) -> DataFrame:
    """One row per key: ``count`` rows and the given sums; combined on the map side before the exchange."""
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias(count), *[F.sum(c).alias(n) for n, c in sums.items()])


def joined_rollup(left: DataFrame, right: DataFrame, on: list[str], group: list[str], left_sums: dict[str, Column], right_sums: dict[str, Column], keep_left: bool = False) -> DataFrame:
    """``SELECT group, count(*) AS n_rows, sums FROM left JOIN right USING (on) GROUP BY group``, by compact states.

    ``group`` and the sums of ``left_sums`` are of ``left``, those of ``right_sums`` of ``right``.
    """
    keys = list(dict.fromkeys([*on, *group]))
    return combined(state(left, keys, left_sums, "_n_left"), state(right, on, right_sums, "_n_right"), on, group, list(left_sums), list(right_sums), keep_left)


def combined(a: DataFrame, b: DataFrame, on: list[str], group: list[str], left_sums: list[str], right_sums: list[str], keep_left: bool = False) -> DataFrame:
    """The roll-up of two sides that are states already: ``a`` with ``_n_left`` rows per key, ``b`` with ``_n_right``."""
    j = a.join(b, on, "left" if keep_left else "inner")
    right = (lambda c: F.coalesce(F.col(c), F.lit(0))) if keep_left else F.col
    return j.groupBy(*[F.col(f"`{c}`") for c in group]).agg(
        F.sum(F.col("_n_left") * right("_n_right")).alias("n_rows"),
        *[F.sum(F.col(n) * right("_n_right")).alias(n) for n in left_sums],
        *[F.sum(right(n) * F.col("_n_left")).alias(n) for n in right_sums],
    )


def count_audit(catalog: DataFrame, messages: DataFrame) -> DataFrame:
    """The true number of messages per (file, topic) of the undecodable topics beside the catalogue's count.

    ``(file_id, topic, stated, actual, gap)``; ``gap``, actual less stated, is null where the catalogue states nothing.
    """
    keys = ["file_id", "topic"]
    # The catalogue's state: one per distinct statement, however often its row is stored.
    stated = catalog.where(~F.col("decodable")).select(*keys, F.col("message_count").alias("stated")).distinct().withColumn("_n_left", F.lit(1).cast("bigint"))
    # The messages' state: their distinct ids, counted once per key.
    actual = distinct_per_key(messages, keys, "msg_id", "actual").withColumn("_n_right", F.lit(1).cast("bigint"))
    j = combined(stated, actual, keys, [*keys, "stated"], [], ["actual"], keep_left=True)
    return j.select(*keys, "stated", "actual", (F.col("actual") - F.col("stated")).alias("gap"))
