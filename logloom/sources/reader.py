"""Reading topics without Spark: the catalogue, prepared topics and message loops of one file.

The Spark side (``mcap``, ``scan``) plans and decodes with the same pieces.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa

from logloom.decode.base import MessageDecoder, Registry, TopicDecoder
from logloom.decode.batches import BATCH, Metadata, batched
from logloom.errors import CallbackError, EmptyDerivedSchema, LogError
from logloom.ir import Field
from logloom.sources import container as c


@dataclass(frozen=True)
class ReadOptions:
    """``[start, end)`` of log time in nanoseconds, then offset, then limit; ``parallel`` overrides the reader's."""

    start: int | None = None
    end: int | None = None
    offset: int = 0
    limit: int | None = None
    parallel: bool | None = None


@dataclass(frozen=True)
class TopicInfo:
    topic: str
    message_count: int | None
    schema_name: str | None
    schema_encoding: str
    message_encoding: str
    channel_count: int
    decodable: bool | None = None
    decode_error: str | None = None


@dataclass
class PreparedTopic:
    """An opened topic: summary read and schema derived once, for any number of scans."""

    path: str
    topic: str
    channel: c.Channel
    schema: c.Schema
    decoder: TopicDecoder
    summary: c.Summary
    file: pa.NativeFile
    parallel: bool = False

    @property
    def schema_name(self) -> str:
        return self.schema.name

    @property
    def fields(self) -> tuple[Field, ...]:
        return self.decoder.fields

    def batch_schema(self, meta: Metadata = Metadata()) -> pa.Schema:
        if not self.fields:
            raise EmptyDerivedSchema(self.schema.name)
        meta.spark(self.fields)
        return meta.arrow(self.fields)

    def rows(self, options: ReadOptions = ReadOptions()) -> Iterator[tuple[int, int, dict]]:
        """Messages in chunk-index order, then as stored.

        One after the other, skipped and filtered messages are not decoded and a reached limit ends the scan.  In parallel
        whole chunks are inflated and decoded ahead, in order, skipped messages included: of a chunk with a bad message nothing comes.
        A limit always reads one after the other.
        """
        if options.limit == 0:
            return
        parallel = self.parallel if options.parallel is None else options.parallel
        skip, left = options.offset, options.limit
        if parallel and left is None:
            for log, pub, value in itertools.chain.from_iterable(self._ahead(options)):
                if skip:
                    skip -= 1
                else:
                    yield log, pub, value
            return
        for ch in self._chunks(options):
            for _, _, log, pub, data in c.messages(c.read_chunk(self.file, ch.offset, ch.length), self.channel.id, options.start, options.end):
                if skip:
                    skip -= 1
                    continue
                yield log, pub, self.decoder.decode(data)
                if left is not None:
                    left -= 1
                    if left == 0:
                        return

    def _chunks(self, options: ReadOptions) -> list[c.ChunkIndex]:
        return c.matching(self.summary, self.channel, options.start, options.end)

    def _ahead(self, options: ReadOptions, depth: int = 8) -> Iterator[list[tuple[int, int, dict]]]:
        """Decoded chunks in order, at most ``depth`` of them under way."""

        def whole(ch: c.ChunkIndex) -> list[tuple[int, int, dict]]:
            return [(log, pub, self.decoder.decode(data)) for _, _, log, pub, data in c.messages(c.read_chunk(self.file, ch.offset, ch.length), self.channel.id, options.start, options.end)]

        with ThreadPoolExecutor() as pool:
            waiting: deque = deque()
            try:
                for ch in self._chunks(options):
                    waiting.append(pool.submit(whole, ch))
                    if len(waiting) >= depth:
                        yield waiting.popleft().result()
                while waiting:
                    yield waiting.popleft().result()
            finally:
                for f in waiting:
                    f.cancel()

    def batches(self, options: ReadOptions = ReadOptions(), meta: Metadata = Metadata(), size: int = BATCH) -> Iterator[pa.RecordBatch]:
        self.batch_schema(meta)
        return batched(self.rows(options), self.fields, meta, size)


@dataclass
class LogReader:
    """Reader with a set of decoders; ``LogReader()`` has none, ``LogReader.default()`` the built-in ones."""

    registry: Registry = field(default_factory=Registry)
    parallel: bool = True

    @staticmethod
    def default(parallel: bool = True) -> LogReader:
        return LogReader(Registry.default(), parallel)

    def register(self, decoder: MessageDecoder) -> LogReader:
        self.registry.register(decoder)
        return self

    # --- catalogue ---
    def topics(self, path: str, with_status: bool = False) -> list[TopicInfo]:
        """Sorted by topic; counts are summed over a topic's channels and None without statistics."""
        summary = c.read_summary(c.open_file(path))
        by: dict[str, list[c.Channel]] = {}
        for ch in summary.channels.values():
            by.setdefault(ch.topic, []).append(ch)
        out = []
        for topic in sorted(by):
            chs = by[topic]
            schema = summary.schemas.get(chs[0].schema_id)
            count = None if summary.counts is None else sum(summary.counts.get(x.id, 0) for x in chs)
            ok, error = None, None
            if with_status:
                ok, error = self._status(summary, topic)
            out.append(TopicInfo(topic, count, schema.name if schema else None, schema.encoding if schema else "", chs[0].message_encoding, len(chs), ok, error))
        return out

    def _status(self, summary: c.Summary, topic: str) -> tuple[bool, str | None]:
        try:
            self._decoder(summary, topic)
        except LogError as e:
            return False, str(e)
        return True, None

    def _decoder(self, summary: c.Summary, topic: str) -> tuple[c.Channel, c.Schema, TopicDecoder]:
        channel = summary.channel_of(topic)
        schema = summary.schema_of(channel)
        return channel, schema, self.registry.find(schema.encoding, channel.message_encoding).topic(schema.name, schema.data)

    def message_count(self, path: str, topic: str) -> int:
        return c.read_summary(c.open_file(path)).message_count(topic)

    def topic_fields(self, path: str, topic: str) -> tuple[Field, ...]:
        return self.prepare(path, topic).fields

    def topic_schema(self, path: str, topic: str) -> tuple[TopicInfo, tuple[Field, ...]]:
        info = next((t for t in self.topics(path) if t.topic == topic), None)
        fields = self.topic_fields(path, topic)
        return info, fields

    # --- scans ---
    def prepare(self, path: str, topic: str) -> PreparedTopic:
        f = c.open_file(path)
        summary = c.read_summary(f)
        return PreparedTopic(path, topic, *self._decoder(summary, topic), summary, f, self.parallel)

    def each_message(self, path: str, topic: str, callback: Callable[[int, int, dict], None], options: ReadOptions = ReadOptions()) -> None:
        for row in self.prepare(path, topic).rows(options):
            _call(callback, *row)

    def each_batch(self, path: str, topic: str, callback: Callable[[pa.RecordBatch], None], options: ReadOptions = ReadOptions(), meta: Metadata = Metadata(), size: int = BATCH) -> None:
        for b in self.prepare(path, topic).batches(options, meta, size):
            _call(callback, b)

    def raw_messages(self, path: str, topic: str) -> Iterator[tuple[int, int, bytes]]:
        """Every message of the topic, in chunks or not, indexed or not; needs neither schema nor decoder."""
        f = c.open_file(path)
        channel = c.read_summary(f).channel_of(topic)
        for _, _, log, pub, data in c.all_messages(f, channel.id):
            yield log, pub, bytes(data)


def _call(callback: Callable, *args: object) -> None:
    try:
        callback(*args)
    except CallbackError:
        raise
    except Exception as e:
        raise CallbackError(e) from e
