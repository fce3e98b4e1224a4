"""Decoders: from a channel's schema to a function from payload bytes to values, and their registry."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import pyarrow as pa

from logloom.errors import DecoderError, MessageDecode, NoDecoder, SchemaDerivation, SchemaParse
from logloom.ir import Field


class TopicDecoder(ABC):
    """Decodes the messages of one topic; made once per topic and task."""

    fields: tuple[Field, ...]

    @abstractmethod
    def decode(self, data: bytes | memoryview) -> dict:
        """Value of one message: dicts for structs, lists, lists of pairs for maps, None for null."""

    def columns(self, payloads: list[bytes | memoryview], fields: tuple[Field, ...]) -> list[pa.Array] | None:
        """The messages as one array per field, where that is quicker than one by one; None where it is not possible."""
        return None


class MessageDecoder(ABC):
    """Knows one pair of encodings.  Instances travel to the workers, so they must pickle."""

    key: tuple[str, str]

    @abstractmethod
    def topic(self, schema_name: str, schema: bytes) -> TopicDecoder: ...


class _Ros2(MessageDecoder):
    grammar = ""

    def topic(self, schema_name: str, schema: bytes) -> TopicDecoder:
        from logloom.decode.cdr import CdrDecoder
        from logloom.schema import ros2idl, ros2msg
        from logloom.schema.names import SchemaText

        try:
            text = schema.decode()
        except UnicodeDecodeError as e:
            raise SchemaParse(e) from e
        try:
            fields = {"ros2msg": ros2msg, "ros2idl": ros2idl}[self.grammar].fields(schema_name, text)
        except SchemaText as e:
            raise SchemaDerivation(e) from e
        return CdrDecoder(fields, schema_name)


class Ros2MsgDecoder(_Ros2):
    key, grammar = ("ros2msg", "cdr"), "ros2msg"


class Ros2IdlDecoder(_Ros2):
    key, grammar = ("ros2idl", "cdr"), "ros2idl"


@dataclass
class ProtobufDecoder(MessageDecoder):
    """``nulls``: an unset field that tracks its presence is null; otherwise it has its default value."""

    nulls: bool = True
    key = ("protobuf", "protobuf")

    def topic(self, schema_name: str, schema: bytes) -> TopicDecoder:
        from logloom.decode.protobuf import ProtobufTopic

        return ProtobufTopic(schema_name, schema, self.nulls)


@dataclass
class JsonDecoder(MessageDecoder):
    """JSON objects of a declared shape; a plug-in, as no shape can be derived from most JSON schemas."""

    fields: tuple[Field, ...]
    schema_encoding: str = "jsonschema"

    @property
    def key(self) -> tuple[str, str]:
        return self.schema_encoding, "json"

    def topic(self, schema_name: str, schema: bytes) -> TopicDecoder:
        return _JsonTopic(self.fields)


class _JsonTopic(TopicDecoder):
    def __init__(self, fields: tuple[Field, ...]) -> None:
        self.fields = fields

    def decode(self, data: bytes | memoryview) -> dict:
        import json

        try:
            got = json.loads(bytes(data))
        except ValueError as e:
            raise MessageDecode(e) from e
        if not isinstance(got, dict):
            raise MessageDecode("not an object")
        return {f.name: got.get(f.name) for f in self.fields}


@dataclass
class Registry:
    """Decoders by pair of encodings; a later one for the same pair replaces an earlier."""

    decoders: dict[tuple[str, str], MessageDecoder] = field(default_factory=dict)

    @staticmethod
    def default() -> Registry:
        return Registry().register(ProtobufDecoder()).register(Ros2MsgDecoder()).register(Ros2IdlDecoder())

    def register(self, decoder: MessageDecoder) -> Registry:
        self.decoders[decoder.key] = decoder
        return self

    def find(self, schema_encoding: str, message_encoding: str) -> MessageDecoder:
        try:
            return self.decoders[schema_encoding, message_encoding]
        except KeyError:
            raise NoDecoder(schema_encoding, message_encoding) from None


__all__ = ["DecoderError", "JsonDecoder", "MessageDecoder", "ProtobufDecoder", "Registry", "Ros2IdlDecoder", "Ros2MsgDecoder", "TopicDecoder"]
