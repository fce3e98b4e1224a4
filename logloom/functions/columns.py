"""Column functions of log tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.exact import floor_div
from logloom import ir
from logloom.decode.base import ProtobufDecoder, Ros2IdlDecoder, Ros2MsgDecoder, TopicDecoder
from logloom.decode.batches import to_array
from logloom.ir import Field


def format_timestamp(ns: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` in UTC of nanoseconds; null stays null.  Built in, whatever the session's time zone."""
    local = F.to_utc_timestamp(F.timestamp_micros(floor_div(ns, 1000)), "UTC")
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSS")


def hex_bytes(data: Column) -> Column:
    """Lower-case hexadecimal text of bytes."""
    return F.lower(F.hex(data))


def unix_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp; one without zone is taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def decode_payload(data: Column, decoder: TopicDecoder) -> Column:
    """Struct of the decoder's fields from payload bytes, column-wise where the decoder can; null where the payload is."""
    fields: tuple[Field, ...] = decoder.fields
    out = T.StructType([T.StructField(f.name, ir.spark_type(f.element.type), True) for f in fields])

    @F.arrow_udf(out)
    def run(payloads: pa.Array) -> pa.Array:
        some = [p for p in payloads.to_pylist() if p is not None]
        cols = decoder.columns(some, fields)
        if cols is None:
            rows = [decoder.decode(p) for p in some]
            cols = [to_array([r.get(f.name) for r in rows], f, ir.arrow_type(f.element.type)) for f in fields]
        kinds = [pa.field(f.name, ir.arrow_type(f.element.type)) for f in fields]
        got = pa.StructArray.from_arrays([c if c.type == k.type else c.cast(k.type) for c, k in zip(cols, kinds, strict=True)], fields=kinds)
        there = payloads.is_valid().to_numpy(zero_copy_only=False)
        return got if there.all() else got.take(pa.array(np.cumsum(there) - 1, mask=~there))

    return run(data)


def decode_protobuf(data: Column, name: str, fds: bytes, nulls: bool = True) -> Column:
    """Struct of protobuf message ``name`` of a serialized descriptor set."""
    return decode_payload(data, ProtobufDecoder(nulls).topic(name, fds))


def decode_cdr(data: Column, schema_name: str, schema: str, grammar: str = "ros2msg") -> Column:
    """Struct of a ROS 2 message, its schema given as ``.msg`` or IDL text."""
    decoder = {"ros2msg": Ros2MsgDecoder, "ros2idl": Ros2IdlDecoder}[grammar]()
    return decode_payload(data, decoder.topic(schema_name, schema.encode()))
