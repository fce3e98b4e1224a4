"""One topic over very many files: planning and decoding as Spark jobs.

``spark.read.format("mcap")`` reads summaries on the driver, which suits some
thousand files.  Here the list of files is itself a DataFrame: summaries are read
by the tasks (``chunks``), pruning is a filter on the chunk table, chunks are
spread evenly over tasks by size, and each task decodes its chunks with the schema
given, or, without one, with the schema of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import ir
from logloom.decode.base import MessageDecoder, Registry, TopicDecoder
from logloom.decode.batches import Metadata, payload_batches
from logloom.errors import LogError
from logloom.ir import Field
from logloom.session import ship
from logloom.sources import container as c

CHUNKS = "path string, topic string, channel int, schema_name string, schema_encoding string, message_encoding string, schema_data binary, chunk int, offset bigint, length bigint, compressed_size bigint, start bigint, end bigint, error string"


def chunks(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per file, topic and chunk that indexes it; a file that is absent or no container gives one row with ``error``.

    Other I/O errors fail the task, so that it is retried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for p in b.column(0).to_pylist():
                try:
                    s = c.read_summary(c.open_file(p))
                    for k, x in enumerate(s.chunks):
                        for ch in sorted(x.channels):
                            channel = s.channels.get(ch)
                            if channel is None:
                                continue
                            schema = s.schemas.get(channel.schema_id)
                            rows.append({"path": p, "topic": channel.topic, "channel": ch, "schema_name": schema and schema.name, "schema_encoding": schema.encoding if schema else "", "message_encoding": channel.message_encoding, "schema_data": schema and schema.data, "chunk": k, "offset": x.offset, "length": x.length, "compressed_size": x.compressed_size, "start": x.start, "end": x.end})
                except (LogError, FileNotFoundError, pa.ArrowInvalid) as e:
                    rows.append({"path": p, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, _CHUNKS)

    ship(files.sparkSession)
    return files.select(F.col(f"`{path}`").alias("path")).mapInArrow(run, CHUNKS)


_CHUNKS = pa.schema(
    [("path", pa.string()), ("topic", pa.string()), ("channel", pa.int32()), ("schema_name", pa.string()), ("schema_encoding", pa.string()), ("message_encoding", pa.string()), ("schema_data", pa.binary()), ("chunk", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("compressed_size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("error", pa.string())]
)


def scan_topic(files: DataFrame, topic: str, fields: tuple[Field, ...], start: int | None = None, end: int | None = None, registry: Registry | None = None, meta: Metadata = Metadata(), partitions: int | None = None, unreadable: str = "skip") -> DataFrame:
    """All messages of ``topic`` in all files, with ``path``; ``fields`` is the table's schema.

    A file whose own schema lacks a field gives null there; one whose field has another type fails the read.
    A file that is absent or no container fails the read with ``unreadable="fail"``; with ``"skip"`` it is left out,
    and ``skipped`` tells which those are.
    """
    if unreadable not in ("skip", "fail"):
        raise ValueError(f"unreadable is 'skip' or 'fail', not {unreadable!r}")
    registry = registry or Registry.default()
    wanted = F.col("topic") == topic
    if start is not None:
        wanted = wanted & (F.col("end") >= start)
    if end is not None:
        wanted = wanted & (F.col("start") < end)
    plan = chunks(files).where(F.col("error").isNotNull() | wanted if unreadable == "fail" else F.col("error").isNull() & wanted)
    n = partitions or max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = plan.repartition(n, "path", "chunk")
    body = meta.spark(tuple(Field(f.name, ir.Element(f.element.type, True)) for f in fields))
    out = "path string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, object] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["error"]:
                    raise LogError(f"{r['path']}: {r['error']}")
                key = (r["schema_name"], r["schema_encoding"], r["message_encoding"], r["schema_data"])
                if key not in made:
                    made[key] = registry.find(key[1], key[2]).topic(key[0], key[3])
                decoder = made[key]
                rows = ((log, pub, data) for _, _, log, pub, data in c.messages(c.read_chunk(c.open_file(r["path"]), r["offset"], r["length"]), r["channel"], start, end))
                # Only a file of the very schema can be read column-wise.
                one = decoder if decoder.fields == fields else _OneByOne(decoder)
                for x in payload_batches(rows, one, fields, meta):
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * x.num_rows, pa.string()), *x.columns], ["path", *x.schema.names])

    got = plan.mapInArrow(run, out)
    # Field metadata (fixed lengths, bounds) does not pass through a schema text; it is attached again.
    return got.select("path", *[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in body.fields])


def skipped(files: DataFrame) -> DataFrame:
    """``(path, error)`` of the files that ``scan_topic`` leaves out."""
    return chunks(files).where(F.col("error").isNotNull()).select("path", "error")


class _OneByOne(TopicDecoder):
    def __init__(self, inner: TopicDecoder) -> None:
        self.inner, self.fields = inner, inner.fields

    def decode(self, data: bytes | memoryview) -> dict:
        return self.inner.decode(data)


__all__ = ["MessageDecoder", "chunks", "scan_topic", "skipped"]
