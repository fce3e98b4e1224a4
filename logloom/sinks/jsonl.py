"""JSON Lines with defined nulls, non-finite numbers, wide integers and nanosecond times.

Spark's own JSON writer cannot say that NaN is written as ``null`` while a null
field is left out, so lines are made in Arrow batches by serializers compiled
once from the schema.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.exact import floor_div
from logloom.errors import SinkError
from logloom.ir import ITEM_KIND, KIND
from logloom.session import ship


@dataclass(frozen=True)
class JsonOptions:
    """``non_finite``: ``null`` or ``string`` (``"NaN"``, ``"Infinity"``, ``"-Infinity"``).  ``integer64``: ``number`` or ``string``.

    ``explicit_nulls``: whether null struct fields and null map values are written or left out; nulls in lists always are.
    """

    non_finite: str = "null"
    integer64: str = "number"
    explicit_nulls: bool = False

    def __post_init__(self) -> None:
        if self.non_finite not in ("null", "string") or self.integer64 not in ("number", "string"):
            raise SinkError("non_finite is null or string, integer64 is number or string")


Write = Callable[[object], str]
_text = json.JSONEncoder(ensure_ascii=False).encode


def _float(short: bool, o: JsonOptions) -> Write:
    names = {True: '"Infinity"', False: '"-Infinity"'}

    def write(v: object) -> str:
        if math.isfinite(v):
            return str(np.float32(v)) if short else repr(v)
        if o.non_finite == "null":
            return "null"
        return '"NaN"' if v != v else names[v > 0]

    return write


def _time(v: datetime) -> str:
    v = v if v.tzinfo is None else v.astimezone(timezone.utc).replace(tzinfo=None)
    return f'"{v.isoformat(timespec="microseconds").rstrip("0").rstrip(".")}Z"'


def _key(dt: T.DataType) -> Write:
    if isinstance(dt, T.BooleanType):
        return lambda k: f'"{str(k).lower()}"'
    if isinstance(dt, (T.IntegralType, T.DecimalType)):
        return lambda k: f'"{int(k)}"'
    if isinstance(dt, T.StringType):
        return _text
    raise SinkError(f"maps keyed by {dt.simpleString()} have no JSON form")


def serializer(dt: T.DataType, o: JsonOptions, metadata: dict | None = None) -> Write:
    """Text of a non-null value of the type."""
    metadata = metadata or {}
    if isinstance(dt, T.StructType):
        parts = [(_text(f.name) + ":", f.name, serializer(f.dataType, o, f.metadata)) for f in dt.fields]

        def write_struct(v: dict) -> str:
            out = []
            for head, name, one in parts:
                x = v[name]
                if x is not None:
                    out.append(head + one(x))
                elif o.explicit_nulls:
                    out.append(head + "null")
            return "{" + ",".join(out) + "}"

        return write_struct
    if isinstance(dt, T.ArrayType):
        one = serializer(dt.elementType, o, {KIND: metadata[ITEM_KIND], ITEM_KIND: metadata[ITEM_KIND]} if ITEM_KIND in metadata else {})
        return lambda v: "[" + ",".join("null" if x is None else one(x) for x in v) + "]"
    if isinstance(dt, T.MapType):
        key, one = _key(dt.keyType), serializer(dt.valueType, o, {KIND: metadata[ITEM_KIND], ITEM_KIND: metadata[ITEM_KIND]} if ITEM_KIND in metadata else {})

        def write_map(v: list) -> str:
            out = []
            for k, x in v:
                if k is None:
                    raise SinkError("map keys must not be null")
                if x is not None or o.explicit_nulls:
                    out.append(f"{key(k)}:{'null' if x is None else one(x)}")
            return "{" + ",".join(out) + "}"

        return write_map
    if isinstance(dt, T.BooleanType):
        return lambda v: "true" if v else "false"
    if isinstance(dt, T.DecimalType):
        wide = o.integer64 == "string" and dt.scale == 0
        return (lambda v: f'"{v}"') if wide else str
    if isinstance(dt, T.LongType):
        return (lambda v: f'"{v}"') if o.integer64 == "string" and metadata.get(KIND) != "U32" else str
    if isinstance(dt, T.IntegralType):
        return str
    if isinstance(dt, T.FloatType):
        return _float(True, o)
    if isinstance(dt, T.DoubleType):
        return _float(False, o)
    if isinstance(dt, T.BinaryType):
        return lambda v: f'"{bytes(v).hex()}"'
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return _time
    if isinstance(dt, T.DateType):
        return lambda v: f'"{date.isoformat(v)}"'
    if isinstance(dt, T.NullType):
        return lambda v: "null"
    return lambda v: _text(str(v))


def json_lines(df: DataFrame, o: JsonOptions = JsonOptions()) -> DataFrame:
    """One column ``value``: each row as a JSON object."""
    ship(df.sparkSession)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = serializer(schema, o)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line(r) for r in b.to_pylist()], pa.string())], ["value"])

    return df.mapInArrow(run, "value string")


def with_rfc3339(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nanosecond columns as RFC 3339 text with nanoseconds, which a JSON timestamp needs and Spark's timestamp has not."""
    for c in columns:
        ns = F.col(f"`{c}`")
        micros = F.timestamp_micros(floor_div(ns, 1000))
        whole = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), micros.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
        df = df.withColumn(c, F.concat(whole, F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), F.lit("Z")))
    return df
