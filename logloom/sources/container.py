"""The MCAP container: summary, chunks and records, read by byte ranges.

Layout after the public MCAP specification.  A file is any object with
``size()`` and ``read_at(length, offset)``, so only the ranges needed are read,
from local or remote storage alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs

from logloom.errors import ContainerError, MultipleChannels, SchemaNotAvailable, StatsNotAvailable, SummaryNotAvailable, TopicNotFound

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = range(1, 9)
STATISTICS, SUMMARY_OFFSET, DATA_END = 0x0B, 0x0E, 0x0F
_RECORD = struct.Struct("<BQ")
_MESSAGE = struct.Struct("<HIQQ")


class Cursor:
    """Sequential reads of little-endian fields from bytes."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ContainerError("record ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, fmt: str) -> int:
        s = struct.Struct("<" + fmt)
        return s.unpack(self.take(s.size))[0]

    def text(self) -> str:
        return bytes(self.take(self.num("I"))).decode()

    def pairs(self, read) -> dict:
        inner = Cursor(self.take(self.num("I")))
        out = {}
        while inner.at < len(inner.data):
            k, v = read(inner)
            out[k] = v
        return out


@dataclass(frozen=True)
class Schema:
    id: int
    name: str
    encoding: str
    data: bytes


@dataclass(frozen=True)
class Channel:
    id: int
    schema_id: int
    topic: str
    message_encoding: str
    metadata: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class ChunkIndex:
    start: int
    end: int
    offset: int
    length: int
    channels: frozenset
    compression: str
    compressed_size: int
    uncompressed_size: int


@dataclass
class Summary:
    schemas: dict[int, Schema]
    channels: dict[int, Channel]
    chunks: list[ChunkIndex]
    counts: dict[int, int] | None  # per channel; None without statistics

    def channel_of(self, topic: str) -> Channel:
        found = [c for c in self.channels.values() if c.topic == topic]
        if not found:
            raise TopicNotFound
        if len(found) > 1:
            raise MultipleChannels
        return found[0]

    def schema_of(self, channel: Channel) -> Schema:
        if channel.schema_id not in self.schemas:
            raise SchemaNotAvailable
        return self.schemas[channel.schema_id]

    def message_count(self, topic: str) -> int:
        """From the statistics, without a scan."""
        channel = self.channel_of(topic)
        if self.counts is None:
            raise StatsNotAvailable
        return self.counts.get(channel.id, 0)


def open_file(path: str) -> pa.NativeFile:
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)
    return pa.memory_map(path) if not path.startswith("file:") else pa.memory_map(path[5:])


def records(data: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    view, at = memoryview(data), 0
    while at < len(view):
        if at + 9 > len(view):
            raise ContainerError("record ends early")
        op, n = _RECORD.unpack_from(view, at)
        if at + 9 + n > len(view):
            raise ContainerError("record ends early")
        yield op, view[at + 9 : at + 9 + n]
        at += 9 + n


def parse_schema(body: memoryview) -> Schema:
    c = Cursor(body)
    return Schema(c.num("H"), c.text(), c.text(), bytes(c.take(c.num("I"))))


def parse_channel(body: memoryview) -> Channel:
    c = Cursor(body)
    return Channel(c.num("H"), c.num("H"), c.text(), c.text(), c.pairs(lambda x: (x.text(), x.text())))


def parse_chunk_index(body: memoryview) -> ChunkIndex:
    c = Cursor(body)
    start, end, offset, length = (c.num("Q") for _ in range(4))
    channels = frozenset(c.pairs(lambda x: (x.num("H"), x.num("Q"))))
    c.num("Q")
    return ChunkIndex(start, end, offset, length, channels, c.text(), c.num("Q"), c.num("Q"))


def read_summary(f: pa.NativeFile) -> Summary:
    size = f.size()
    tail = 29 + len(MAGIC)
    if size < len(MAGIC) + tail or f.read_at(len(MAGIC), 0) != MAGIC:
        raise ContainerError("bad magic")
    end = f.read_at(tail, size - tail)
    if end[-len(MAGIC) :] != MAGIC or end[0] != FOOTER:
        raise ContainerError("bad magic at the end")
    start, _, crc = struct.unpack_from("<QQI", end, 9)
    if start == 0:
        raise SummaryNotAvailable
    if start > size - tail:
        raise ContainerError("summary lies beyond the file")
    data = f.read_at(size - tail - start, start)
    if crc and zlib.crc32(end[:25], zlib.crc32(data)) != crc:
        raise ContainerError("summary checksum mismatch")
    out = Summary({}, {}, [], None)
    for op, body in records(data):
        if op == SCHEMA:
            s = parse_schema(body)
            out.schemas[s.id] = s
        elif op == CHANNEL:
            ch = parse_channel(body)
            out.channels[ch.id] = ch
        elif op == CHUNK_INDEX:
            out.chunks.append(parse_chunk_index(body))
        elif op == STATISTICS:
            c = Cursor(body)
            c.take(8 + 2 + 4 * 4 + 8 + 8)
            out.counts = c.pairs(lambda x: (x.num("H"), x.num("Q")))
    return out


def inflate(compression: str, data: memoryview, size: int) -> bytes | memoryview:
    if compression == "":
        return data
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=size) if size else b""
    if compression == "lz4":
        return pa.decompress(bytes(data), decompressed_size=size, codec="lz4", asbytes=True) if size else b""
    raise ContainerError(f"unsupported compression '{compression}'")


def chunk_records(body: bytes | memoryview) -> bytes | memoryview:
    """The records of a chunk, inflated and checked."""
    c = Cursor(body)
    c.take(16)
    size, crc, compression = c.num("Q"), c.num("I"), c.text()
    data = inflate(compression, c.take(c.num("Q")), size)
    if crc and zlib.crc32(data) != crc:
        raise ContainerError("chunk checksum mismatch")
    return data


def read_chunk(f: pa.NativeFile, offset: int, length: int) -> bytes | memoryview:
    raw = memoryview(f.read_buffer_at(length, offset) if hasattr(f, "read_buffer_at") else f.read_at(length, offset))
    op, n = _RECORD.unpack_from(raw, 0)
    if op != CHUNK or n + 9 > len(raw):
        raise ContainerError("no chunk where the index says")
    return chunk_records(raw[9 : 9 + n])


def messages(data: bytes | memoryview, channel: int | None, start: int | None = None, end: int | None = None) -> Iterator[tuple[int, int, int, int, memoryview]]:
    """``(channel, sequence, log_time, publish_time, payload)`` in stored order; other messages are stepped over unread."""
    view, at, size = memoryview(data), 0, len(data)
    while at < size:
        if at + 9 > size:
            raise ContainerError("record ends early")
        op, n = _RECORD.unpack_from(view, at)
        body = at + 9
        at = body + n
        if at > size:
            raise ContainerError("record ends early")
        if op == MESSAGE:
            ch, seq, log, pub = _MESSAGE.unpack_from(view, body)
            if (channel is None or ch == channel) and (start is None or log >= start) and (end is None or log < end):
                yield ch, seq, log, pub, view[body + 22 : at]


def all_messages(f: pa.NativeFile, channel: int | None) -> Iterator[tuple[int, int, int, int, memoryview]]:
    """Every message of the stream, in or outside of chunks, indexed or not."""
    at, size = len(MAGIC), f.size() - len(MAGIC)
    while at < size:
        op, n = _RECORD.unpack(f.read_at(9, at))
        if op in (MESSAGE, CHUNK):
            body = f.read_at(n, at + 9)
            if op == CHUNK:
                yield from messages(chunk_records(body), channel)
            else:
                ch, seq, log, pub = _MESSAGE.unpack_from(body)
                if channel is None or ch == channel:
                    yield ch, seq, log, pub, memoryview(body)[22:]
        elif op in (DATA_END, FOOTER):
            return
        at += 9 + n


def matching(summary: Summary, channel: Channel, start: int | None, end: int | None) -> list[ChunkIndex]:
    """Chunks that index the channel and overlap ``[start, end)``, in index order."""
    return [c for c in summary.chunks if channel.id in c.channels and (start is None or c.end >= start) and (end is None or c.start < end)]
