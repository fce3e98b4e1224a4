"""The one numeric reading of a decoded message, whatever its schema calls it and however deep it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a reading may stand.
NAMES = ("reading", "value", "measurement", "level")
_NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def reading(value: Column, names: tuple[str, ...] = NAMES) -> Column:
    """The reading as double, or null where it is null, empty, NaN or missing.

    Works inside the JVM on the JSON text: a key is told from a string by the
    colon behind it, and a scalar from an object by what follows the colon.
    """
    found = F.regexp_extract(value, rf'"(?:{"|".join(names)})"\s*:\s*"?\s*({_NUMBER})\s*[",}}\]\s]', 1)
    return F.when(found != "", found.try_cast("double"))


def with_reading(df: DataFrame) -> DataFrame:
    """``(file_id, topic, msg_id, log_time, reading)`` of every message; ``reading`` is null where it is not usable."""
    return df.select("file_id", "topic", "msg_id", "log_time", reading(F.col("value")).alias("reading"))
