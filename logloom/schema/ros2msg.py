"""ROS 2 ``.msg`` texts: one field or constant per line, sections headed ``MSG: pkg/Type``."""

from __future__ import annotations

import re

from logloom.ir import Field
from logloom.schema.names import Definitions, Expr, Member, Name, Resolver, SchemaText, main_section, normalized, qualified, sections

#: Built-in types.
PRIMITIVES = {
    "bool": "Bool", "byte": "U8", "char": "U8", "int8": "I8", "uint8": "U8", "int16": "I16", "uint16": "U16", "int32": "I32", "uint32": "U32",
    "int64": "I64", "uint64": "U64", "float32": "F32", "float64": "F64", "string": "String", "wstring": "WString",
}

_LINE = re.compile(r"(?P<base>[A-Za-z][\w/]*)(?:<=(?P<str>\d+))?(?P<arr>(?:\[(?:<=)?\d*\])*)\s+(?P<name>[A-Za-z]\w*)\s*(?P<rest>.*)")
_ARRAY = re.compile(r"\[(<=)?(\d*)\]")


def _uncommented(line: str) -> str:
    """``line`` up to a ``#`` that is not inside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i]
    return line


def _base(word: str, bound: str | None) -> Expr:
    if word in PRIMITIVES:
        kind = PRIMITIVES[word]
        if bound is not None:
            if kind not in ("String", "WString"):
                raise SchemaText(f"only strings take a bound: {word}<={bound}")
            return Expr(f"Bounded{kind}", int(bound))
        return Expr(kind)
    parts = word.split("/")
    if bound is not None or not all(parts) or len(parts) > 3:
        raise SchemaText(f"invalid type '{word}'")
    if len(parts) == 1:
        return Expr("ref", ref=(word,))
    return Expr("ref", ref=(parts[0], "msg", parts[-1]))


def parse(name: str, text: str) -> tuple[Name, list[Member], list[tuple[str, str]]]:
    """Full name, members and constants of one message text."""
    members: list[Member] = []
    consts: list[tuple[str, str]] = []
    for raw in text.splitlines():
        line = _uncommented(raw).strip()
        if not line:
            continue
        m = _LINE.fullmatch(line)
        if not m:
            raise SchemaText(f"failed to parse msg schema '{name}': {raw.strip()}")
        expr, arrays = _base(m["base"], m["str"]), _ARRAY.findall(m["arr"])
        if m["rest"].startswith("=") and m["str"] is None:
            if arrays:
                raise SchemaText("constants cannot be arrays")
            if expr.ref:
                raise SchemaText("constants must be primitive types")
            # Text after a string constant's sign belongs to it, comment marks included.
            value = raw.split("=", 1)[1].strip() if expr.kind in ("String", "WString") else m["rest"][1:].strip()
            consts.append((m["name"], value))
            continue
        length = None
        for bounded, n in arrays:
            if length is not None:
                raise SchemaText("nested fixed arrays are not supported in ROS2")
            if n and not bounded:
                length = int(n)
            elif bounded and not n:
                raise SchemaText(f"failed to parse msg schema '{name}': {raw.strip()}")
            else:
                expr = Expr("List", int(n) if n else None, expr)
        members.append(Member(m["name"], expr, length))
    return qualified(name), members, consts


def bundle(schema_name: str, text: str) -> list[tuple[str, str]]:
    """(path, body) of each section; the first may lack its ``MSG:`` line and is then the schema itself."""
    out: list[tuple[str, str]] = []
    for k, lines in enumerate(sections(text)):
        first = next(i for i, x in enumerate(lines) if x.strip())
        head = lines[first].strip()
        if head.startswith("MSG:"):
            out.append((normalized(head[4:].strip()), "\n".join(lines[first + 1 :])))
        elif k == 0:
            out.append((normalized(schema_name), "\n".join(lines)))
        else:
            raise SchemaText(f"missing `MSG:` header: {head}")
    if not out:
        out.append((normalized(schema_name), ""))
    return out


def fields(schema_name: str, text: str) -> tuple[Field, ...]:
    parts = bundle(schema_name, text)
    defs = Definitions()
    for path, body in parts:
        name, members, consts = parse(path, body)
        defs.structs[name], defs.consts[name] = members, consts
    root = main_section([p for p, _ in parts], normalized(schema_name))
    return Resolver(defs).fields(qualified(root))
