"""Schemas as they are derived from a topic: types independent of Spark, with bounds, lengths and variants.

``Type.kind`` is one of ``KINDS``.  ``to_spark`` gives the columns a scan emits;
what Spark's types cannot say (fixed lengths, bounds, variants) goes into field
metadata, so it survives selection and a Parquet round trip.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

#: Names of the types, and bits of the integers.
INTS = {"I8": 8, "I16": 16, "I32": 32, "I64": 64, "U8": 8, "U16": 16, "U32": 32, "U64": 64}
KINDS = {"Null", "Bool", *INTS, "F32", "F64", "String", "WString", "BoundedString", "BoundedWString", "Bytes", "BoundedBytes", "Enum", "Struct", "List", "BoundedList", "Array", "Map"}
#: Metadata keys.
FIXED_LEN, BOUND, VARIANTS, KIND, ITEM_KIND = "fixed_len", "bound", "variants", "kind", "item_kind"
_WIDENED = ("U8", "U16", "U32", "U64", "WString", "BoundedWString")


@dataclass(frozen=True)
class Type:
    kind: str
    item: Element | None = None  # lists, arrays, map values
    key: Element | None = None
    size: int | None = None  # bound or length
    fields: tuple[Field, ...] = ()
    variants: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown type {self.kind}")

    def __str__(self) -> str:
        return type_text(self)


@dataclass(frozen=True)
class Element:
    type: Type
    nullable: bool = False

    def __str__(self) -> str:
        return ("optional " if self.nullable else "") + type_text(self.type)


@dataclass(frozen=True)
class Field:
    name: str
    element: Element


def field(name: str, kind: str | Type, nullable: bool = False, **more) -> Field:
    return Field(name, Element(kind if isinstance(kind, Type) else Type(kind, **more), nullable))


def struct(*fields: Field) -> Type:
    return Type("Struct", fields=tuple(fields))


# --- text -----------------------------------------------------------------------


def type_text(t: Type) -> str:
    inner = lambda e: type_text(e.type) + ("?" if e.nullable else "")
    match t.kind:
        case "List":
            return f"{inner(t.item)}[]"
        case "BoundedList":
            return f"{inner(t.item)}[<={t.size}]"
        case "Array":
            return f"{inner(t.item)}[{t.size}]"
        case "Map":
            return f"map<{inner(t.key)}, {inner(t.item)}>"
        case "BoundedString" | "BoundedWString" | "BoundedBytes":
            return f"{t.kind[7:].lower()}[<={t.size}]"
        case _:
            return t.kind.lower()


def _below(t: Type) -> list[tuple[str, Element] | str]:
    """What stands under a field of the type: fields, labels of an enum, or the parts of a map."""
    while t.item is not None and not (t.kind == "Map" and _has_tree(t.key.type)):
        t = t.item.type
    if t.kind == "Map":
        return [(f"@{part}", e) for part, e in (("key", t.key), ("value", t.item)) if _has_tree(e.type)]
    return [f"{n} = {v}" for n, v in t.variants] if t.kind == "Enum" else [(f.name, f.element) for f in t.fields]


def _has_tree(t: Type) -> bool:
    held = [t]
    for x in held:
        held += [e.type for e in (x.key, x.item) if e is not None]
    return any(x.kind in ("Struct", "Enum") for x in held)


def schema_text(fields: tuple[Field, ...] | list[Field]) -> str:
    """Fields as an indented tree, each with its whole type."""
    lines: list[str] = []
    todo: list[tuple[int, tuple[str, Element] | str]] = [(0, (f.name, f.element)) for f in reversed(fields)]
    while todo:
        depth, entry = todo.pop()
        text, under = (entry, []) if isinstance(entry, str) else (f"{entry[0]}: {entry[1]}", _below(entry[1].type))
        lines.append("    " * depth + text + "\n")
        todo += [(depth + 1, x) for x in reversed(under)]
    return "".join(lines)


# --- Spark and Arrow ------------------------------------------------------------

_SPARK = {
    "Null": T.NullType(), "Bool": T.BooleanType(), "I8": T.ByteType(), "I16": T.ShortType(), "I32": T.IntegerType(), "I64": T.LongType(),
    "U8": T.ShortType(), "U16": T.IntegerType(), "U32": T.LongType(), "U64": T.DecimalType(20, 0), "F32": T.FloatType(), "F64": T.DoubleType(),
    "String": T.StringType(), "WString": T.StringType(), "BoundedString": T.StringType(), "BoundedWString": T.StringType(), "Enum": T.StringType(),
    "Bytes": T.BinaryType(), "BoundedBytes": T.BinaryType(),
}
_ARROW = {
    "Null": pa.null(), "Bool": pa.bool_(), "I8": pa.int8(), "I16": pa.int16(), "I32": pa.int32(), "I64": pa.int64(),
    "U8": pa.int16(), "U16": pa.int32(), "U32": pa.int64(), "U64": pa.decimal128(20, 0), "F32": pa.float32(), "F64": pa.float64(),
    "String": pa.string(), "WString": pa.string(), "BoundedString": pa.string(), "BoundedWString": pa.string(), "Enum": pa.string(),
    "Bytes": pa.binary(), "BoundedBytes": pa.binary(),
}


def spark_type(t: Type) -> T.DataType:
    if t.kind == "Struct":
        return T.StructType([spark_field(f) for f in t.fields])
    if t.kind in ("List", "BoundedList", "Array"):
        return T.ArrayType(spark_type(t.item.type), t.item.nullable)
    if t.kind == "Map":
        return T.MapType(spark_type(t.key.type), spark_type(t.item.type), t.item.nullable)
    return _SPARK[t.kind]


def field_metadata(t: Type) -> dict:
    """What of a type Spark would lose."""
    out: dict = {}
    if t.kind == "Array":
        out[FIXED_LEN] = t.size
    elif t.size is not None:
        out[BOUND] = t.size
    if t.kind == "Enum":
        out[VARIANTS] = json.dumps(dict(t.variants))
    if t.kind in _WIDENED:
        out[KIND] = t.kind
    inner = t
    while inner.item is not None:
        inner = inner.item.type
    if inner is not t and inner.kind in _WIDENED:
        out[ITEM_KIND] = inner.kind
    return out


def spark_field(f: Field) -> T.StructField:
    return T.StructField(f.name, spark_type(f.element.type), f.element.nullable, field_metadata(f.element.type))


def spark_schema(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([spark_field(f) for f in fields])


def arrow_type(t: Type) -> pa.DataType:
    if t.kind == "Struct":
        return pa.struct([pa.field(f.name, arrow_type(f.element.type), f.element.nullable) for f in t.fields])
    if t.kind in ("List", "BoundedList", "Array"):
        return pa.list_(pa.field("element", arrow_type(t.item.type), t.item.nullable))
    if t.kind == "Map":
        return pa.map_(arrow_type(t.key.type), pa.field("value", arrow_type(t.item.type), t.item.nullable))
    return _ARROW[t.kind]


def from_json(defs: list) -> tuple[Field, ...]:
    """Fields of the JSON form: a list of ``{name, element}``, an element being an object or a bare type name."""

    def element(e: object) -> Element:
        if isinstance(e, str):
            return Element(Type(e))
        size = e.get("max", e.get("len"))
        return Element(
            Type(
                e["data_type"],
                element(e["item"]) if "item" in e else None,
                element(e["key"]) if "key" in e else None,
                size,
                from_json(e.get("fields") or []),
                tuple((v["name"], v["value"]) for v in e.get("variants") or []),
            ),
            bool(e.get("nullable", False)),
        )

    return tuple(Field(f["name"], element(f["element"])) for f in defs)


def to_json(fields: tuple[Field, ...]) -> list:
    def element(e: Element) -> object:
        t = e.type
        out: dict = {"data_type": t.kind, "nullable": e.nullable}
        if t.fields or t.kind == "Struct":
            out["fields"] = to_json(t.fields)
        if t.item is not None:
            out["item"] = element(t.item)
        if t.key is not None:
            out["key"] = element(t.key)
        if t.size is not None:
            out["len" if t.kind == "Array" else "max"] = t.size
        if t.variants:
            out["variants"] = [{"name": n, "value": v} for n, v in t.variants]
        return out

    return [{"name": f.name, "element": element(f.element)} for f in fields]


# --- values ---------------------------------------------------------------------


def checked(value: object, e: Element, path: str = "") -> object:
    """``value`` if it fits ``e``; no coercion is done."""
    t = e.type
    if value is None:
        return None
    actual = type(value).__name__
    match t.kind:
        case "Null":
            ok = False
        case "Bool":
            ok = isinstance(value, bool)
        case k if k in INTS:
            ok = isinstance(value, int) and not isinstance(value, bool)
            if ok:
                lo, hi = (0, 2 ** INTS[k]) if k[0] == "U" else (-(2 ** (INTS[k] - 1)), 2 ** (INTS[k] - 1))
                ok = lo <= value < hi
        case "F32" | "F64":
            ok = isinstance(value, float)
        case "Bytes" | "BoundedBytes":
            ok = isinstance(value, (bytes, bytearray, memoryview))
        case "Struct":
            ok = isinstance(value, dict)
            if ok:
                for f in t.fields:
                    checked(value.get(f.name), f.element)
        case "List" | "BoundedList" | "Array":
            ok = isinstance(value, (list, tuple))
            if ok and t.kind == "Array" and len(value) != t.size:
                from logloom.errors import ValueTypeError

                raise ValueTypeError(f"FixedSizeList(length={t.size})", f"Array(length={len(value)})")
            if ok:
                for v in value:
                    checked(v, t.item)
        case "Map":
            ok = isinstance(value, (list, dict))
        case _:
            ok = isinstance(value, str)
    if not ok:
        from logloom.errors import ValueTypeError

        raise ValueTypeError(t.kind, actual)
    return value
