"""CDR payloads: a schema compiled once into closures that read little-endian fields at aligned positions.

Neighbouring numbers are read in one go, and lists of numbers as one buffer;
errors name the path of the field.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from logloom.decode.base import TopicDecoder
from logloom.errors import MessageDecode
from logloom.ir import Field, Type

#: Struct code of each number.
CODES = {"I8": "b", "U8": "B", "I16": "h", "U16": "H", "I32": "i", "U32": "I", "I64": "q", "U64": "Q", "F32": "f", "F64": "d"}
_U32 = struct.Struct("<I")

Read = Callable[[memoryview, int], tuple[object, int]]


class _Bad(Exception):
    pass


def _number(code: str, path: str) -> Read:
    s = struct.Struct("<" + code)
    n = s.size

    def read(b: memoryview, at: int) -> tuple[object, int]:
        at = -(-at // n) * n
        if at + n > len(b):
            raise _Bad("buffer underflow while aligning" if at > len(b) else f"unexpected EOF at {path}")
        return s.unpack_from(b, at)[0], at + n

    return read


def _bool(path: str) -> Read:
    def read(b: memoryview, at: int) -> tuple[object, int]:
        if at >= len(b):
            raise _Bad(f"unexpected EOF at {path}")
        return b[at] != 0, at + 1

    return read


def _string(path: str, bound: int | None) -> Read:
    size = _number("I", path)

    def read(b: memoryview, at: int) -> tuple[object, int]:
        n, at = size(b, at)
        if n == 0:
            return "", at
        if at + n > len(b):
            raise _Bad(f"unexpected EOF at {path}")
        if b[at + n - 1] != 0:
            raise _Bad(f"string missing null terminator at {path}")
        try:
            text = str(b[at : at + n - 1], "utf-8")
        except UnicodeDecodeError as e:
            raise _Bad(f"invalid UTF-8 at {path}: {e}") from e
        if bound is not None and n - 1 > bound:
            raise _Bad(f"bounded string overflow at {path}: {n - 1} > {bound}")
        return text, at + n

    return read


def _wide(path: str) -> Read:
    def read(b: memoryview, at: int) -> tuple[object, int]:
        raise _Bad(f"wstring not supported at {path}")

    return read


def _enum(variants: tuple[tuple[str, int], ...], path: str) -> Read:
    number = _number("I", path)
    names: dict[int, str] = {}
    for name, value in variants:
        names.setdefault(value & 0xFFFFFFFF, name)

    def read(b: memoryview, at: int) -> tuple[object, int]:
        raw, at = number(b, at)
        return names.get(raw) or str(raw), at

    return read


def _numbers(kind: str, count: int, b: memoryview, at: int, path: str) -> tuple[list, int]:
    code = CODES[kind]
    size = struct.calcsize("<" + code)
    if count:
        at = -(-at // size) * size
    if at + count * size > len(b):
        raise _Bad(f"unexpected EOF at {path}")
    if count > 16:
        return np.frombuffer(b, f"<{code}" if size > 1 else code, count, at).tolist(), at + count * size
    return list(struct.unpack_from(f"<{count}{code}", b, at)), at + count * size


def _length(path: str, bound: int | None) -> Read:
    size = _number("I", path)

    def read(b: memoryview, at: int) -> tuple[object, int]:
        n, at = size(b, at)
        if bound is not None and n > bound:
            raise _Bad(f"sequence bound overflow at {path}: {n} > {bound}")
        if n > len(b) - at:
            raise _Bad(f"sequence length {n} exceeds remaining {len(b) - at} bytes at {path}")
        return n, at

    return read


def compile_type(t: Type, path: str) -> Read:
    match t.kind:
        case "Bool":
            return _bool(path)
        case k if k in CODES:
            return _number(CODES[k], path)
        case "String" | "BoundedString":
            return _string(path, t.size)
        case "WString" | "BoundedWString":
            return _wide(path)
        case "Enum":
            return _enum(t.variants, path)
        case "Bytes" | "BoundedBytes":
            length = _length(path, t.size)

            def read_bytes(b: memoryview, at: int) -> tuple[object, int]:
                n, at = length(b, at)
                return bytes(b[at : at + n]), at + n

            return read_bytes
        case "List" | "BoundedList" | "Array":
            item, fixed = t.item.type, t.size if t.kind == "Array" else None
            length = None if fixed is not None else _length(path, t.size)
            if item.kind in CODES:

                def read_numbers(b: memoryview, at: int) -> tuple[object, int]:
                    n = fixed
                    if length is not None:
                        n, at = length(b, at)
                    return _numbers(item.kind, n, b, at, path)

                return read_numbers
            one = compile_type(item, f"{path}[]")

            def read_items(b: memoryview, at: int) -> tuple[object, int]:
                n = fixed
                if length is not None:
                    n, at = length(b, at)
                out = []
                for i in range(n):
                    try:
                        v, at = one(b, at)
                    except _Bad as e:
                        raise _Bad(str(e).replace(f"{path}[]", f"{path}[{i}]", 1)) from None
                    out.append(v)
                return out, at

            return read_items
        case "Struct":
            return _struct(t.fields, path)
        case _:
            raise _Bad(f"{t.kind} has no CDR form at {path}")


def _struct(fields: tuple[Field, ...], path: str) -> Read:
    if not fields:

        def read_empty(b: memoryview, at: int) -> tuple[object, int]:
            # An empty struct takes one placeholder byte.
            if at >= len(b):
                raise _Bad(f"unexpected EOF at {path}")
            return {}, at + 1

        return read_empty
    parts: list[tuple[str, Read]] = []
    for f in fields:
        parts.append((f.name, compile_type(f.element.type, f"{path}.{f.name}")))

    def read(b: memoryview, at: int) -> tuple[object, int]:
        out = {}
        for name, one in parts:
            out[name], at = one(b, at)
        return out, at

    return read


def _layout(fields: tuple[Field, ...]) -> tuple[str, list] | None:
    """struct format and names of a schema of numbers and nested structs only, whose positions are then the same in every message."""
    fmt, at = [], 0

    def walk(fs: tuple[Field, ...]) -> list | None:
        nonlocal at
        if not fs:
            return None
        out = []
        for f in fs:
            t = f.element.type
            if t.kind == "Struct":
                inner = walk(t.fields)
                if inner is None:
                    return None
                out.append((f.name, inner))
            elif t.kind in CODES:
                n = struct.calcsize("<" + CODES[t.kind])
                pad = -at % n
                fmt.append(("x" * pad) + CODES[t.kind])
                at += pad + n
                out.append((f.name, None))
            else:
                return None
        return out

    shape = walk(fields)
    return None if shape is None else ("<" + "".join(fmt), shape)


#: Numpy type of each column as it is emitted.
_EMITTED = {"U8": np.int16, "U16": np.int32, "U32": np.int64}


def _dtype(fields: tuple[Field, ...]) -> np.dtype | None:
    """Record type of a whole message with its header, for the schemas that ``_layout`` covers."""
    names, formats, offsets, at = [], [], [], 0

    def walk(fs: tuple[Field, ...], path: str) -> None:
        nonlocal at
        for f in fs:
            t, name = f.element.type, f"{path}/{f.name}"
            if t.kind == "Struct":
                walk(t.fields, name)
            else:
                n = struct.calcsize("<" + CODES[t.kind])
                at += -at % n
                names.append(name)
                formats.append(np.dtype(CODES[t.kind]).newbyteorder("<"))
                offsets.append(at + 4)
                at += n

    walk(fields, "")
    return np.dtype({"names": [*names, "header"], "formats": [*formats, "u1"], "offsets": [*offsets, 1], "itemsize": at + 4})


def _column(records: np.ndarray, f: Field, path: str) -> pa.Array:
    t, name = f.element.type, f"{path}/{f.name}"
    if t.kind == "Struct":
        parts = [_column(records, x, name) for x in t.fields]
        return pa.StructArray.from_arrays(parts, fields=[pa.field(x.name, p.type, x.element.nullable) for x, p in zip(t.fields, parts, strict=True)])
    v = np.ascontiguousarray(records[name])
    if t.kind == "U64":
        wide = np.zeros((len(v), 2), np.uint64)
        wide[:, 0] = v
        return pa.Array.from_buffers(pa.decimal128(20, 0), len(v), [None, pa.py_buffer(wide)])
    return pa.array(v.astype(_EMITTED.get(t.kind, v.dtype)))


class CdrDecoder(TopicDecoder):
    def __init__(self, fields: tuple[Field, ...], name: str) -> None:
        self.fields = fields
        parts = name.split("/")
        self.path = ".".join(parts if len(parts) == 3 else [parts[0], "msg", *parts[1:]])
        self._read: Read | None = None
        self._flat: struct.Struct | None = None

    def __getstate__(self) -> dict:
        return {"fields": self.fields, "path": self.path, "_read": None, "_flat": None}

    def _compile(self) -> None:
        self._read = _struct(self.fields, self.path)
        if layout := _layout(self.fields):
            self._flat, self._shape, self._records = struct.Struct(layout[0]), layout[1], _dtype(self.fields)

    def columns(self, payloads: list[bytes | memoryview], fields: tuple[Field, ...]) -> list[pa.Array] | None:
        """Messages of numbers only have one layout, so a batch of them is read as an array of records."""
        if self._read is None:
            self._compile()
        if self._flat is None or any(len(p) != self._records.itemsize for p in payloads):
            return None
        records = np.frombuffer(b"".join(payloads), self._records)
        if (records["header"] != 1).any():
            return None
        return [_column(records, f, "") for f in fields]

    def decode(self, data: bytes | memoryview) -> dict:
        if self._read is None:
            self._compile()
        b = memoryview(data)
        if len(b) < 4:
            raise MessageDecode("incomplete encapsulation header")
        if b[1] != 1:
            raise MessageDecode(f"unsupported CDR endianness: 0x{b[1]:02x}")
        body = b[4:]
        if self._flat is not None and len(body) >= self._flat.size:
            values = iter(self._flat.unpack_from(body))
            build = lambda shape: {n: next(values) if s is None else build(s) for n, s in shape}
            return build(self._shape)
        try:
            return self._read(body, 0)[0]
        except _Bad as e:
            raise MessageDecode(e) from None
