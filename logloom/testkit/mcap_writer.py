"""Writes MCAP files for tests, queries and benchmarks."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa

from logloom.sources.container import CHANNEL, CHUNK, CHUNK_INDEX, DATA_END, FOOTER, HEADER, MAGIC, MESSAGE, MESSAGE_INDEX, SCHEMA, STATISTICS


def _record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def _pairs(items: list[bytes]) -> bytes:
    b = b"".join(items)
    return struct.pack("<I", len(b)) + b


def _deflate(compression: str, data: bytes) -> bytes:
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if compression == "lz4":
        return pa.compress(data, codec="lz4", asbytes=True)
    return data


@dataclass
class McapWriter:
    """``chunk_bytes`` None writes messages outside of chunks; ``summary`` and ``statistics`` can be left out."""

    path: str
    compression: str = ""
    chunk_bytes: int | None = 1 << 20
    summary: bool = True
    statistics: bool = True
    index_channels: bool = True
    profile: str = ""
    library: str = "logloom"
    _out: list[bytes] = field(default_factory=list)
    _at: int = 0

    def __post_init__(self) -> None:
        self._schemas: dict[int, bytes] = {}
        self._channels: dict[int, bytes] = {}
        self._chunk: list[bytes] = []
        self._chunk_size = 0
        self._times: list[int] = []
        self._index: dict[int, list[tuple[int, int]]] = {}
        self._chunk_indexes: list[bytes] = []
        self._counts: dict[int, int] = {}
        self._file = open(self.path, "wb")  # noqa: SIM115
        self._range: list[int] = []
        self._put(MAGIC + _record(HEADER, _text(self.profile) + _text(self.library)))

    def _put(self, b: bytes) -> None:
        self._file.write(b)
        self._at += len(b)

    def add_schema(self, name: str, encoding: str, data: bytes) -> int:
        i = len(self._schemas) + 1
        self._schemas[i] = _record(SCHEMA, struct.pack("<H", i) + _text(name) + _text(encoding) + struct.pack("<I", len(data)) + data)
        return i

    def add_channel(self, topic: str, message_encoding: str, schema: int = 0, metadata: dict[str, str] | None = None) -> int:
        i = len(self._channels) + 1
        meta = _pairs([_text(k) + _text(v) for k, v in (metadata or {}).items()])
        self._channels[i] = _record(CHANNEL, struct.pack("<HH", i, schema) + _text(topic) + _text(message_encoding) + meta)
        return i

    def write(self, channel: int, log_time: int, data: bytes, publish_time: int | None = None, sequence: int = 0) -> None:
        rec = _record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log_time, log_time if publish_time is None else publish_time) + data)
        self._counts[channel] = self._counts.get(channel, 0) + 1
        self._range += [log_time] if not self._range else []
        self._range = [min(self._range[0], log_time), max(self._range[-1], log_time)]
        if self.chunk_bytes is None:
            self._put(rec)
            return
        self._index.setdefault(channel, []).append((log_time, self._chunk_size))
        self._chunk.append(rec)
        self._chunk_size += len(rec)
        self._times.append(log_time)
        if self._chunk_size >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        """End the chunk in progress."""
        if not self._chunk:
            return
        data = b"".join(self._chunk)
        packed = _deflate(self.compression, data)
        start, end, at = min(self._times), max(self._times), self._at
        body = struct.pack("<QQQI", start, end, len(data), zlib.crc32(data)) + _text(self.compression) + struct.pack("<Q", len(packed)) + packed
        rec = _record(CHUNK, body)
        self._put(rec)
        offsets, begin = [], self._at
        if self.index_channels:
            for ch, entries in self._index.items():
                offsets.append(struct.pack("<HQ", ch, self._at))
                self._put(_record(MESSAGE_INDEX, struct.pack("<H", ch) + _pairs([struct.pack("<QQ", *e) for e in entries])))
        self._chunk_indexes.append(_record(CHUNK_INDEX, struct.pack("<QQQQ", start, end, at, len(rec)) + _pairs(offsets) + struct.pack("<Q", self._at - begin) + _text(self.compression) + struct.pack("<QQ", len(packed), len(data))))
        self._chunk, self._chunk_size, self._times, self._index = [], 0, [], {}

    def close(self) -> None:
        self.flush()
        self._put(_record(DATA_END, struct.pack("<I", 0)))
        start = 0
        body = b""
        if self.summary:
            start = self._at
            body = b"".join([*self._schemas.values(), *self._channels.values()])
            if self.statistics:
                lo, hi = self._range or (0, 0)
                counts = _pairs([struct.pack("<HQ", c, n) for c, n in self._counts.items()])
                body += _record(STATISTICS, struct.pack("<QHIIIIQQ", sum(self._counts.values()), len(self._schemas), len(self._channels), 0, 0, len(self._chunk_indexes), lo, hi) + counts)
            body += b"".join(self._chunk_indexes)
            self._put(body)
        head = struct.pack("<BQQQ", FOOTER, 20, start, 0)
        crc = zlib.crc32(head, zlib.crc32(body)) if self.summary else 0
        self._put(head + struct.pack("<I", crc) + MAGIC)
        self._file.close()

    def __enter__(self) -> McapWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
