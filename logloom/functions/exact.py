"""Integer arithmetic on nanoseconds, which doubles cannot hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(c: Column, n: int) -> Column:
    """Exact ``floor(c / n)`` of a bigint, also below zero."""
    n_ = F.lit(n).cast("bigint")
    return F.call_function("div", c - F.pmod(c, n_), n_)
