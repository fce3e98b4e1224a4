"""Decoded messages into Arrow record batches with the two metadata columns in front."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

from logloom import ir
from logloom.decode.base import TopicDecoder
from logloom.errors import ConvertError, EmptyRows, MetadataColumnCollision, ValueTypeError
from logloom.ir import Field

BATCH = 1024
_MAX_NS = 2**63 - 1


@dataclass(frozen=True)
class Metadata:
    """Naming and form of the metadata columns; ``unix_ns`` keeps nanoseconds, ``timestamp`` has Spark's microseconds."""

    prefix: str = ""
    time_format: str = "unix_ns"

    def __post_init__(self) -> None:
        if self.time_format not in ("unix_ns", "timestamp"):
            raise ConvertError(f"unknown time format '{self.time_format}'")

    @property
    def names(self) -> tuple[str, str]:
        return f"{self.prefix}log_time", f"{self.prefix}publish_time"

    def spark(self, fields: tuple[Field, ...]) -> T.StructType:
        clash = [n for n in self.names if n in {f.name for f in fields}]
        if clash:
            raise MetadataColumnCollision(clash)
        kind = T.LongType() if self.time_format == "unix_ns" else T.TimestampType()
        return T.StructType([T.StructField(n, kind, False) for n in self.names] + ir.spark_schema(fields).fields)

    def arrow(self, fields: tuple[Field, ...]) -> pa.Schema:
        kind = pa.int64() if self.time_format == "unix_ns" else pa.timestamp("us", "UTC")
        return pa.schema([pa.field(n, kind, False) for n in self.names] + [pa.field(f.name, ir.arrow_type(f.element.type), True) for f in fields])

    def times(self, ns: list[int]) -> pa.Array:
        if any(t > _MAX_NS for t in ns):
            raise ConvertError("timestamp exceeds the range of 64-bit signed nanoseconds")
        return pa.array(ns, pa.int64()) if self.time_format == "unix_ns" else pa.array([t // 1000 for t in ns], pa.timestamp("us", "UTC"))


def to_array(values: list, f: Field, arrow: pa.DataType) -> pa.Array:
    t = f.element.type
    if t.kind == "Array":
        for v in values:
            if v is not None and len(v) != t.size:
                raise ValueTypeError(f"FixedSizeList(length={t.size})", f"Array(length={len(v)})")
    try:
        return pa.array(values, arrow)
    except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError, OverflowError):
        for v in values:
            ir.checked(v, f.element, f.name)
        raise


def record_batch(rows: list[tuple[int, int, dict | None]], fields: tuple[Field, ...], meta: Metadata, schema: pa.Schema | None = None) -> pa.RecordBatch:
    """Rows of ``(log_time, publish_time, value)``; a null value nulls all payload columns."""
    if not rows:
        raise EmptyRows
    schema = schema or meta.arrow(fields)
    cols: list[pa.Array] = [meta.times([r[0] for r in rows]), meta.times([r[1] for r in rows])]
    for k, f in enumerate(fields):
        cols.append(to_array([None if r[2] is None else r[2].get(f.name) for r in rows], f, schema.field(k + 2).type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def payload_batches(rows: Iterable[tuple[int, int, bytes | memoryview]], decoder: TopicDecoder, fields: tuple[Field, ...], meta: Metadata, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of still encoded rows, column-wise where the decoder can."""
    schema = meta.arrow(fields)

    def batch(held: list) -> pa.RecordBatch:
        cols = decoder.columns([r[2] for r in held], fields)
        if cols is None:
            return record_batch([(log, pub, decoder.decode(data)) for log, pub, data in held], fields, meta, schema)
        arrays = [meta.times([r[0] for r in held]), meta.times([r[1] for r in held]), *[c if c.type == schema.field(k + 2).type else c.cast(schema.field(k + 2).type) for k, c in enumerate(cols)]]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def batched(rows: Iterable[tuple[int, int, dict | None]], fields: tuple[Field, ...], meta: Metadata, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows (0 counts as 1); the rest is flushed, an empty batch never comes."""
    size = max(size, 1)
    schema = meta.arrow(fields)
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield record_batch(held, fields, meta, schema)
            held = []
    if held:
        yield record_batch(held, fields, meta, schema)
