"""Deterministic payload models and file shapes, and encoders for CDR and protobuf."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

from logloom import ir
from logloom.ir import Element, Field, Type
from logloom.testkit.mcap_writer import McapWriter

_CODE = {"Bool": "?", "I8": "b", "U8": "B", "I16": "h", "U16": "H", "I32": "i", "U32": "I", "I64": "q", "U64": "Q", "F32": "f", "F64": "d"}


def cdr(fields: tuple[Field, ...], value: dict) -> bytes:
    """Little-endian CDR with its header."""
    out = bytearray()

    def put(code: str, v: object) -> None:
        n = struct.calcsize("<" + code)
        out.extend(b"\0" * (-len(out) % n) + struct.pack("<" + code, v))

    def one(t: Type, v: object) -> None:
        if t.kind in _CODE:
            put(_CODE[t.kind], v)
        elif t.kind in ("String", "BoundedString"):
            b = v.encode() + b"\0"
            put("I", len(b))
            out.extend(b)
        elif t.kind in ("Bytes", "BoundedBytes"):
            put("I", len(v))
            out.extend(v)
        elif t.kind == "Enum":
            put("I", dict(t.variants)[v] & 0xFFFFFFFF)
        elif t.kind == "Struct":
            if not t.fields:
                out.append(0)
            for f in t.fields:
                one(f.element.type, v[f.name])
        else:
            if t.kind != "Array":
                put("I", len(v))
            for x in v:
                one(t.item.type, x)

    one(Type("Struct", fields=fields), value)
    return b"\0\1\0\0" + bytes(out)


_WORDS = {"Bool": "bool", "I8": "int8", "U8": "uint8", "I16": "int16", "U16": "uint16", "I32": "int32", "U32": "uint32", "I64": "int64", "U64": "uint64", "F32": "float32", "F64": "float64", "String": "string"}
_IDL = _WORDS | {"F32": "float", "F64": "double", "Bool": "boolean"}


def msg_text(fields: tuple[Field, ...], package: str) -> str:
    """A ``.msg`` bundle of the fields; structs become sections named after their field."""
    rest: list[str] = []
    names: dict[Type, str] = {}

    def word(f: Field, t: Type) -> str:
        if t.kind in ("List", "BoundedList"):
            return word(f, t.item.type) + (f"[<={t.size}]" if t.size else "[]")
        if t.kind == "Array":
            return word(f, t.item.type) + f"[{t.size}]"
        if t.kind in ("Bytes", "BoundedBytes"):
            return "uint8" + (f"[<={t.size}]" if t.size else "[]")
        if t.kind == "BoundedString":
            return f"string<={t.size}"
        if t.kind == "Struct":
            if t not in names:
                names[t] = f"{f.name.title().replace('_', '')}T{len(names)}"
                rest.append(f"===\nMSG: {package}/{names[t]}\n" + body(t.fields))
            return names[t]
        return _WORDS[t.kind]

    def body(fs: tuple[Field, ...]) -> str:
        return "".join(f"{word(f, f.element.type)} {f.name}\n" for f in fs)

    top = body(fields)
    return top + "".join(rest)


def idl_text(fields: tuple[Field, ...], package: str, name: str) -> str:
    structs: list[str] = []
    names: dict[Type, str] = {}

    def word(f: Field, t: Type) -> str:
        if t.kind in ("List", "BoundedList"):
            return f"sequence<{word(f, t.item.type)}{f', {t.size}' if t.size else ''}>"
        if t.kind in ("Bytes", "BoundedBytes"):
            return f"sequence<uint8{f', {t.size}' if t.size else ''}>"
        if t.kind == "BoundedString":
            return f"string<{t.size}>"
        if t.kind == "Enum" and t not in names:
            names[t] = f"{f.name.title().replace('_', '')}T{len(names)}"
            structs.append(f"enum {names[t]} {{ " + ", ".join(f"@value({v}) {n}" for n, v in t.variants) + " };")
        if t.kind == "Struct":
            if t not in names:
                names[t] = f"{f.name.title().replace('_', '')}T{len(names)}"
                structs.append(declare(names[t], t.fields))
            return names[t]
        return names.get(t) or _IDL[t.kind]

    def declare(n: str, fs: tuple[Field, ...]) -> str:
        lines = []
        for f in fs:
            t = f.element.type
            lines.append(f"{word(f, t.item.type)} {f.name}[{t.size}];" if t.kind == "Array" else f"{word(f, t)} {f.name};")
        return f"struct {n} {{ {' '.join(lines)} }};"

    main = declare(name, fields)
    return f"===\nIDL: {package}/msg/{name}\nmodule {package} {{ module msg {{\n" + "\n".join([*structs, main]) + "\n}; };\n"


_PROTO = {"Bool": 8, "I32": 5, "I64": 3, "U32": 13, "U64": 4, "F32": 2, "F64": 1, "String": 9, "BoundedString": 9, "Bytes": 12}


def proto_file(fields: tuple[Field, ...], package: str, name: str) -> descriptor_pb2.FileDescriptorSet:
    """proto3 file of the fields; nullable ones are ``optional``."""
    f = descriptor_pb2.FileDescriptorProto(name=f"{package}.proto", package=package, syntax="proto3")

    def fill(m: descriptor_pb2.DescriptorProto, path: str, fs: tuple[Field, ...]) -> None:
        for k, x in enumerate(fs, 1):
            t, label = x.element.type, 1
            inner = x.name.title().replace("_", "") + "T"
            if t.kind == "List":
                t, label = t.item.type, 3
            elif t.kind == "Map":
                # As the compiler does: a list of entries of a nested type.
                inner = x.name.title().replace("_", "") + "Entry"
                m.field.add(name=x.name, number=k, label=3, type=11, type_name=f"{path}.{inner}")
                entry = m.nested_type.add(name=inner)
                entry.options.map_entry = True
                fill(entry, f"{path}.{inner}", (Field("key", t.key), Field("value", t.item)))
                continue
            d = m.field.add(name=x.name, number=k, label=label)
            if t.kind == "Enum":
                e = m.enum_type.add(name=inner)
                for n, v in t.variants:
                    e.value.add(name=n, number=v)
                d.type, d.type_name = 14, f"{path}.{inner}"
            elif t.kind == "Struct":
                fill(m.nested_type.add(name=inner), f"{path}.{inner}", t.fields)
                d.type, d.type_name = 11, f"{path}.{inner}"
            else:
                d.type = _PROTO[t.kind]
                if x.element.nullable and label == 1:
                    d.proto3_optional, d.oneof_index = True, len(m.oneof_decl)
                    m.oneof_decl.add(name=f"_{x.name}")

    fill(f.message_type.add(name=name), f".{package}.{name}", fields)
    return descriptor_pb2.FileDescriptorSet(file=[f])


def proto_class(fds: descriptor_pb2.FileDescriptorSet, full_name: str):
    pool = descriptor_pool.DescriptorPool()
    for f in fds.file:
        pool.AddSerializedFile(f.SerializeToString())
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(full_name))


# --- the benchmark's models -------------------------------------------------------


def numbers(seed: int = 7) -> Iterator[int]:
    """Linear congruential numbers of 32 bits (multiplier and increment are fixed values)."""
    s = seed
    while True:
        s = (s * 6364136223846793005 + 1) % 2**64
        yield s >> 32


def _level(k: int) -> Type:
    if k > 3:
        return Type("U64")
    return ir.struct(Field("a", Element(_level(k + 1))), Field("b", Element(_level(k + 1))))


CASES: dict[str, tuple[Field, ...]] = {
    "flat": tuple(ir.field(c, "U64") for c in "abcdefghij"),
    "nested": (Field("a", Element(_level(1))), Field("b", Element(_level(1)))),
    "bytes": (ir.field("data", "Bytes"),),
    "numeric_array": (Field("values", Element(Type("Array", Element(Type("F64")), size=1024))),),
    "strings": tuple(ir.field(c, "String") for c in "abcdefghij"),
}


def sample(fields: tuple[Field, ...], rng: Iterator[int], blob: int = 1 << 20) -> dict:
    def one(t: Type) -> object:
        if t.kind == "Struct":
            return {f.name: one(f.element.type) for f in t.fields}
        if t.kind == "Array":
            return [float(next(rng)) for _ in range(t.size)]
        if t.kind == "Bytes":
            return bytes([next(rng) & 255]) * blob
        if t.kind == "String":
            return f"bench-string-{next(rng)}"
        return next(rng)

    return {f.name: one(f.element.type) for f in fields}


@dataclass(frozen=True)
class FileShape:
    """``select`` percent of the messages are of ``/bench``, the others of ``/other``; interleaved or in one stretch."""

    payload_bytes: int = 24 << 20
    select: int = 100
    compression: str = ""
    chunk_bytes: int = 1 << 20
    clustered: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.select <= 100 or self.chunk_bytes <= 0 or self.compression not in ("", "zstd", "lz4"):
            raise ValueError("select is a percentage, chunk_bytes positive, compression none, zstd or lz4")


def write_bench(path: str, case: str, encoding: str = "ros2idl", shape: FileShape = FileShape()) -> int:
    """Write the file; returns the number of ``/bench`` messages."""
    fields, rng = CASES[case], numbers()
    if encoding == "protobuf":
        if case == "strings":
            raise ValueError("the strings case has no protobuf form")
        if case == "numeric_array":
            fields = (Field("values", Element(Type("List", Element(Type("F64"))))),)
        fds = proto_file(fields, "bench", "Sample")
        cls = proto_class(fds, "bench.Sample")
        name, schema, message = "bench.Sample", fds.SerializeToString(), "protobuf"

        def encode(v: dict) -> bytes:
            def build(m, x: dict) -> None:
                for k, y in x.items():
                    if isinstance(y, dict):
                        build(getattr(m, k), y)
                        getattr(m, k).SetInParent()
                    elif isinstance(y, list):
                        getattr(m, k).extend(y)
                    else:
                        setattr(m, k, y)

            m = cls()
            build(m, v)
            return m.SerializeToString()
    else:
        name, message = "bench/msg/Sample", "cdr"
        schema = (idl_text(fields, "bench", "Sample") if encoding == "ros2idl" else msg_text(fields, "bench")).encode()
        encode = lambda v: cdr(fields, v)
    first = encode(sample(CASES[case] if encoding != "protobuf" else fields if case != "numeric_array" else CASES[case], rng))
    count = max(shape.payload_bytes // max(len(first), 1), 1)
    bench = 0
    with McapWriter(path, shape.compression, shape.chunk_bytes) as w:
        s = w.add_schema(name, encoding, schema)
        a, b = w.add_channel("/bench", message, s), w.add_channel("/other", message, s)
        rng = numbers()
        for i in range(count):
            mine = i < -(-count * shape.select // 100) if shape.clustered else i % 100 < shape.select
            bench += mine
            w.write(a if mine else b, i, encode(sample(CASES[case], rng)), sequence=i)
    return bench
