"""Protobuf payloads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from google.protobuf.message import DecodeError

from logloom import ir
from logloom.decode.base import TopicDecoder
from logloom.errors import MessageDecode
from logloom.ir import Field, Type
from logloom.schema import protobuf as pb


class ProtobufTopic(TopicDecoder):
    """Descriptors do not pickle; the serialized set does, and is parsed again where needed."""

    def __init__(self, name: str, fds: bytes, nulls: bool = True) -> None:
        self.name, self.fds, self.nulls = name, fds, nulls
        self.fields = pb.fields(pb.descriptor(name, fds), nulls)
        self._class = self._read = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_class": None, "_read": None}

    def _prepare(self) -> None:
        self._class = pb.message_class(pb.descriptor(self.name, self.fds))
        self._read = self._struct(self._class.DESCRIPTOR)

    def decode(self, data: bytes | memoryview) -> dict:
        if self._class is None:
            self._prepare()
        msg = self._class()
        try:
            msg.ParseFromString(bytes(data))
        except DecodeError as e:
            raise MessageDecode(e) from e
        return self._read(msg)

    def columns(self, payloads: list[bytes | memoryview], fields: tuple[Field, ...]) -> list[pa.Array]:
        """Field by field over all messages, so that no message becomes a dictionary."""
        if self._class is None:
            self._prepare()
        messages = []
        for p in payloads:
            m = self._class()
            try:
                m.ParseFromString(bytes(p))
            except DecodeError as e:
                raise MessageDecode(e) from e
            messages.append(m)
        by = self._class.DESCRIPTOR.fields_by_name
        return [self._column(by[f.name], f.element.type, messages) for f in fields]

    def _column(self, f: FieldDescriptor, t: Type, messages: list) -> pa.Array:
        name, kind = f.name, ir.arrow_type(t)
        got = [getattr(m, name) for m in messages]
        if pb.is_repeated(f):
            offsets = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
            if pb.is_map(f):
                key, value = (f.message_type.fields_by_name[k] for k in ("key", "value"))
                values = self._values(value, t.item.type, [m[k] for m in got for k in m])
                return pa.MapArray.from_arrays(offsets, self._values(key, t.key.type, [k for m in got for k in m]), values).cast(kind)
            return pa.ListArray.from_arrays(offsets, self._values(f, t.item.type, [v for m in got for v in m]), type=kind)
        if self.nulls and f.has_presence:
            there = [m.HasField(name) for m in messages]
            if not all(there):
                values = self._values(f, t, [v for v, here in zip(got, there, strict=True) if here])
                at = np.cumsum(there) - 1
                return values.take(pa.array(at, mask=~np.array(there)))
        return self._values(f, t, got)

    def _values(self, f: FieldDescriptor, t: Type, got: list) -> pa.Array:
        """Single values of the field's type, none of them null."""
        kind = ir.arrow_type(t)
        if f.type == FieldDescriptor.TYPE_ENUM:
            names = {n: v.name for n, v in f.enum_type.values_by_number.items()}
            return pa.array([names.get(v) or str(v) for v in got], kind)
        if f.message_type is not None:
            by = f.message_type.fields_by_name
            parts = [self._column(by[x.name], x.element.type, got) for x in t.fields]
            return pa.StructArray.from_arrays(parts, fields=list(kind)) if parts else pa.array([{}] * len(got), kind)
        return pa.array(got, kind)

    def _one(self, f: FieldDescriptor) -> Callable | None:
        """Reader of a single value of the field; None where the value is taken as it is."""
        if f.type == FieldDescriptor.TYPE_ENUM:
            names = {n: v.name for n, v in f.enum_type.values_by_number.items()}
            return lambda v: names.get(v) or str(v)
        return self._struct(f.message_type) if f.message_type is not None else None

    def _struct(self, d: Descriptor) -> Callable:
        """Reader of a message, made once: what is asked of descriptors costs more than the reading."""
        parts = []
        for f in d.fields:
            if pb.is_map(f):
                parts.append((f.name, "map", self._one(f.message_type.fields_by_name["value"])))
            elif pb.is_repeated(f):
                parts.append((f.name, "list", self._one(f)))
            else:
                parts.append((f.name, "maybe" if self.nulls and f.has_presence else "one", self._one(f)))

        def read(msg: object) -> dict:
            out: dict = {}
            for name, how, one in parts:
                if how == "maybe" and not msg.HasField(name):
                    out[name] = None
                    continue
                v = getattr(msg, name)
                if how == "map":
                    out[name] = [(k, v[k] if one is None else one(v[k])) for k in v]
                elif how == "list":
                    out[name] = list(v) if one is None else [one(x) for x in v]
                else:
                    out[name] = v if one is None else one(v)
            return out

        return read


def decode_value(name: str, fds: bytes, data: bytes, nulls: bool = True) -> dict:
    return ProtobufTopic(name, fds, nulls).decode(data)
