"""Protobuf schemas: a serialized ``FileDescriptorSet`` and a message name."""

from __future__ import annotations

from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from google.protobuf.message import DecodeError

from logloom.errors import SchemaDerivation, SchemaParse
from logloom.ir import Element, Field, Type

#: Kinds of the wire types.
KINDS = {
    FieldDescriptor.TYPE_DOUBLE: "F64", FieldDescriptor.TYPE_FLOAT: "F32", FieldDescriptor.TYPE_INT32: "I32", FieldDescriptor.TYPE_SINT32: "I32",
    FieldDescriptor.TYPE_SFIXED32: "I32", FieldDescriptor.TYPE_INT64: "I64", FieldDescriptor.TYPE_SINT64: "I64", FieldDescriptor.TYPE_SFIXED64: "I64",
    FieldDescriptor.TYPE_UINT32: "U32", FieldDescriptor.TYPE_FIXED32: "U32", FieldDescriptor.TYPE_UINT64: "U64", FieldDescriptor.TYPE_FIXED64: "U64",
    FieldDescriptor.TYPE_BOOL: "Bool", FieldDescriptor.TYPE_STRING: "String", FieldDescriptor.TYPE_BYTES: "Bytes",
}


def descriptor(name: str, fds: bytes) -> Descriptor:
    files = descriptor_pb2.FileDescriptorSet()
    try:
        files.ParseFromString(fds)
    except DecodeError as e:
        raise SchemaParse(e) from e
    pool = descriptor_pool.DescriptorPool()
    waiting = {f.name: f for f in files.file}
    done: set[str] = set()

    def add(f: descriptor_pb2.FileDescriptorProto) -> None:
        if f.name in done:
            return
        done.add(f.name)
        for dep in f.dependency:
            if dep in waiting:
                add(waiting[dep])
        pool.Add(f) if hasattr(pool, "Add") else pool.AddSerializedFile(f.SerializeToString())

    try:
        for f in files.file:
            add(f)
    except TypeError as e:
        raise SchemaParse(e) from e
    try:
        return pool.FindMessageTypeByName(name)
    except KeyError:
        raise SchemaDerivation("message descriptor not found") from None


def is_map(f: FieldDescriptor) -> bool:
    return f.message_type is not None and f.message_type.GetOptions().map_entry


def is_repeated(f: FieldDescriptor) -> bool:
    return f.is_repeated if hasattr(f, "is_repeated") else f.label == FieldDescriptor.LABEL_REPEATED


def fields(d: Descriptor, nulls: bool = True, above: tuple[str, ...] = ()) -> tuple[Field, ...]:
    """Fields in order of declaration; with ``nulls`` a field that tracks its presence is nullable."""
    if d.full_name in above:
        raise SchemaDerivation(f"type '{d.full_name}' contains itself")
    above = (*above, d.full_name)

    def single(f: FieldDescriptor) -> Type:
        if f.type == FieldDescriptor.TYPE_ENUM:
            return Type("Enum", variants=tuple((v.name, v.number) for v in f.enum_type.values))
        if f.message_type is not None:
            return Type("Struct", fields=fields(f.message_type, nulls, above))
        return Type(KINDS[f.type])

    def whole(f: FieldDescriptor) -> Element:
        if is_map(f):
            key, value = f.message_type.fields_by_name["key"], f.message_type.fields_by_name["value"]
            return Element(Type("Map", Element(single(value)), Element(single(key))))
        if is_repeated(f):
            return Element(Type("List", Element(single(f))))
        return Element(single(f), nulls and f.has_presence)

    return tuple(Field(f.name, whole(f)) for f in d.fields)


def message_class(d: Descriptor):
    return message_factory.GetMessageClass(d)
