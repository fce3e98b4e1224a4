"""The ``mcap`` data source: topics of log files as DataFrames.

    register(spark)
    spark.read.format("mcap").option("topic", "/imu").load("run.mcap")

Options:

* ``mode``: ``decoded`` (default), ``raw`` (payload bytes of every message), ``topics`` (the catalogue) or
  ``auto`` (decoded, or raw where no decoder or schema fits);
* ``topic``; ``startTime``, ``endTime`` (nanoseconds, half-open); ``offset``, ``limit`` (of the whole read; they read in order,
  so the scan is one task that stops early);
* ``fields``: comma-separated top-level payload fields to keep; others are decoded over but never built;
* ``metadataPrefix``, ``timeFormat`` (``unix_ns`` or ``timestamp``), ``position`` (adds ``_chunk`` and ``_pos``);
* ``numPartitions``, ``parallel`` (``false``: one task); ``presence`` (``default`` gives unset protobuf fields their default).

``readStream`` takes files of a folder as they arrive.  ``path`` is a file, a folder or a glob; all files must give the topic the same schema (for drifting ones
see ``scan``).  Chunks that do not index the channel or do not overlap the time range are never read;
comparisons of ``log_time`` with literals are pushed into that test.
"""

from __future__ import annotations

import glob as globs
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from logloom.decode.base import MessageDecoder, ProtobufDecoder, Registry
from logloom.decode.batches import BATCH, Metadata, payload_batches
from logloom.errors import DecoderError, EmptyDerivedSchema, NoDecoder, SchemaNotAvailable, TopicNotFound
from logloom.session import ship
from logloom.sources import container as c
from logloom.sources.reader import LogReader

TOPICS = "path string, topic string, message_count bigint, schema_name string, schema_encoding string, message_encoding string, channel_count int, decodable boolean, decode_error string, note string"


def register(spark: SparkSession, decoders: list[MessageDecoder] | None = None, case_sensitive: bool = False) -> None:
    """Make ``mcap`` readable in the session; ``decoders`` are used beside the built-in ones until the next call.

    Spark makes sources in processes of their own, so the decoders travel as part of the registered class.
    Filters are pushed into the source.  Field names of messages are case-sensitive; ``case_sensitive`` makes the session so,
    which only topics need whose names differ by case alone.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if case_sensitive:
        spark.conf.set("spark.sql.caseSensitive", "true")
    spark.dataSource.register(type("RegisteredSource", (McapSource,), {"decoders": tuple(decoders or ())}))


def paths_of(path: str) -> list[str]:
    if "://" in path:
        return [path]
    if os.path.isdir(path):
        return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".mcap"))
    found = sorted(globs.glob(path)) if globs.has_magic(path) else [path]
    if not found:
        raise FileNotFoundError(path)
    return found


@dataclass
class Part(InputPartition):
    """Chunks of one file, as (position in the index, offset, length)."""

    path: str
    chunks: list[tuple[int, int, int]]
    start: int | None
    end: int | None


def _true(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() in ("true", "1", "yes")


class McapSource(DataSource):
    decoders: tuple[MessageDecoder, ...] = ()

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        o = self.options
        self.mode = o.get("mode", "decoded").lower()
        if self.mode not in ("decoded", "raw", "topics", "auto"):
            raise ValueError(f"unknown mode '{self.mode}'")
        self.meta = Metadata(o.get("metadataPrefix", ""), o.get("timeFormat", "unix_ns"))
        self.paths = paths_of(o["path"])
        self.topic = o.get("topic")
        self._prepared = None
        if self.mode != "topics" and not self.topic:
            raise ValueError("option 'topic' is needed")

    @classmethod
    def name(cls) -> str:
        return "mcap"

    def log_reader(self) -> LogReader:
        registry = Registry.default()
        if self.options.get("presence") == "default":
            registry.register(ProtobufDecoder(nulls=False))
        for d in self.decoders:
            registry.register(d)
        return LogReader(registry)

    def prepared(self):
        """The topic in the first file that has it, and the fields kept."""
        if self._prepared is None:
            first: Exception | None = None
            for p in self.paths:
                try:
                    topic = self.log_reader().prepare(p, self.topic)
                except TopicNotFound as e:
                    first = first or e
                    continue
                break
            else:
                raise first or TopicNotFound()
            if not topic.fields:
                raise EmptyDerivedSchema(topic.schema.name)
            names = [n.strip() for n in self.options.get("fields", "").split(",") if n.strip()]
            missing = [n for n in names if n not in {f.name for f in topic.fields}]
            if missing:
                from logloom.errors import ProjectionError

                raise ProjectionError(f"field '{missing[0]}' not found in schema")
            self._prepared = topic.decoder, tuple(f for f in topic.fields if not names or f.name in names)
        return self._prepared

    def raw(self) -> bool:
        if self.mode == "raw":
            return True
        if self.mode == "auto":
            try:
                self.prepared()
            except (NoDecoder, SchemaNotAvailable, DecoderError):
                return True
        return False

    def schema(self) -> T.StructType | str:
        if self.mode == "topics":
            return TOPICS
        if self.raw():
            a, b = self.meta.names
            kind = self.meta.spark(()).fields[0].dataType
            out = T.StructType([T.StructField(a, kind, False), T.StructField(b, kind, False), T.StructField("data", T.BinaryType(), False)])
        else:
            out = self.meta.spark(self.prepared()[1])
        if _true(self.options.get("position"), False):
            out = T.StructType([*out.fields, T.StructField("_chunk", T.IntegerType(), False), T.StructField("_pos", T.IntegerType(), False)])
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if self.mode == "topics":
            return CatalogReader(self)
        return TopicReader(self)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        if self.mode == "topics":
            raise ValueError("the catalogue cannot be streamed")
        return ArrivalReader(self)


class ArrivalReader(DataSourceStreamReader):
    """Files of a folder as they arrive.  An offset names the files that were there, so each is read exactly once whatever its
    time of change; those that were moved away since leave it, which keeps it short.  Files must be put in place whole, as
    a log without summary cannot be read.
    """

    def __init__(self, source: McapSource) -> None:
        self.path, self.inner = source.options["path"], TopicReader(source)

    def _arrived(self) -> list[str]:
        return sorted(paths_of(self.path))

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": self._arrived()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = set(start["files"])
        self.inner.paths = [p for p in end["files"] if p not in known]
        return self.inner.partitions() if self.inner.paths else [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)


class CatalogReader(DataSourceReader):
    def __init__(self, source: McapSource) -> None:
        self.paths, self.reader = source.paths, source.log_reader()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for t in self.reader.topics(partition.value, with_status=True):
            note = "duplicate topic is not supported" if t.channel_count > 1 else "no messages" if t.message_count == 0 else None
            yield (partition.value, t.topic, t.message_count, t.schema_name, t.schema_encoding, t.message_encoding, t.channel_count, t.decodable, t.decode_error, note)


class TopicReader(DataSourceReader):
    def __init__(self, source: McapSource) -> None:
        o = source.options
        self.paths, self.topic, self.meta, self.is_raw = source.paths, source.topic, source.meta, source.raw()
        self.decoder, self.fields = (None, ()) if self.is_raw else source.prepared()
        self.position = _true(o.get("position"), False)
        number = lambda k: int(o[k]) if o.get(k) is not None else None
        self.start, self.end, self.limit, self.offset = number("startTime"), number("endTime"), number("limit"), number("offset") or 0
        self.wanted, self.parallel = number("numPartitions"), _true(o.get("parallel"), True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of log time narrow the range; Spark still checks every filter.  With offset or limit the range is the options' alone."""
        unit = 1 if self.meta.time_format == "unix_ns" else 0
        for f in filters:
            if unit and not self.offset and self.limit is None and isinstance(getattr(f, "value", None), int) and getattr(f, "attribute", None) == (self.meta.names[0],):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.start = low if self.start is None else max(self.start, low)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = f.value + (not isinstance(f, LessThan))
                    self.end = high if self.end is None else min(self.end, high)
            yield f

    def partitions(self) -> list[InputPartition]:
        nothing = [InputPartition([])]  # an empty list would mean one partition of None
        if self.limit == 0:
            return nothing
        serial = self.offset > 0 or self.limit is not None or not self.parallel
        found: list[tuple[str, list[tuple[int, c.ChunkIndex]]]] = []
        for p in self.paths:
            f = c.open_file(p)
            summary = c.read_summary(f)
            try:
                channel = summary.channel_of(self.topic)
            except TopicNotFound:
                if len(self.paths) == 1:
                    raise
                continue
            if self.is_raw:
                found.append((p, []))
            else:
                numbered = {id(x): k for k, x in enumerate(summary.chunks)}
                found.append((p, [(numbered[id(x)], x) for x in c.matching(summary, channel, self.start, self.end)]))
        if serial:
            return [InputPartition([Part(p, [(k, x.offset, x.length) for k, x in chunks], self.start, self.end) for p, chunks in found])]
        if self.is_raw:
            return [InputPartition([Part(p, [], self.start, self.end)]) for p, _ in found] or nothing
        total = sum(x.compressed_size for _, chunks in found for _, x in chunks)
        # Tasks of even size, from 4 to 128 MiB of compressed chunks unless a number is asked for.
        share = max(total // self.wanted, 1) if self.wanted else min(max(total // 64, 4 << 20), 128 << 20)
        out: list[InputPartition] = []
        for p, chunks in found:
            held: list[tuple[int, int, int]] = []
            size = 0
            for k, x in chunks:
                held.append((k, x.offset, x.length))
                size += x.compressed_size
                if size >= share:
                    out.append(InputPartition([Part(p, held, self.start, self.end)]))
                    held, size = [], 0
            if held:
                out.append(InputPartition([Part(p, held, self.start, self.end)]))
        return out or nothing

    def _messages(self, parts: list[Part]) -> Iterator[tuple[int, int, memoryview, int, int]]:
        for part in parts:
            f = c.open_file(part.path)
            channel = c.read_summary(f).channel_of(self.topic).id
            if self.is_raw:
                for pos, (_, _, log, pub, data) in enumerate(c.all_messages(f, channel)):
                    if (part.start is None or log >= part.start) and (part.end is None or log < part.end):
                        yield log, pub, data, -1, pos
                continue
            for k, offset, length in part.chunks:
                for pos, (_, _, log, pub, data) in enumerate(c.messages(c.read_chunk(f, offset, length), channel, part.start, part.end)):
                    yield log, pub, data, k, pos

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = self._messages(partition.value)
        places: list[tuple[int, int]] = []

        def wanted() -> Iterator[tuple[int, int, object]]:
            skip, left = self.offset, self.limit
            for log, pub, data, chunk, pos in rows:
                if skip:
                    skip -= 1
                    continue
                places.append((chunk, pos))
                yield log, pub, (bytes(data) if self.is_raw else data)
                if left is not None:
                    left -= 1
                    if left == 0:
                        return

        batches = _raw_batches(wanted(), self.meta) if self.is_raw else payload_batches(wanted(), self.decoder, self.fields, self.meta)
        for b in batches:
            if self.position:
                here, places[:] = places[: b.num_rows], places[b.num_rows :]
                b = pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in here], pa.int32()), pa.array([y for _, y in here], pa.int32())], [*b.schema.names, "_chunk", "_pos"])
            yield b


def _raw_batches(rows: Iterator[tuple[int, int, bytes]], meta: Metadata) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([meta.times([r[0] for r in held]), meta.times([r[1] for r in held]), pa.array([r[2] for r in held], pa.binary())], [*meta.names, "data"])

    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()
