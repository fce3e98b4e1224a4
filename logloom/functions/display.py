"""Texts for people: times, message details, hex dumps and schemas of collected rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from logloom.ir import Field, schema_text

#: Items of a list and bytes of a value that a detail view shows.
SHOWN = 32


def time_text(ns: int) -> str:
    """UTC to the millisecond; what no signed 64-bit time can be is shown as the number."""
    if ns > 2**63 - 1:
        return str(ns)
    s, rest = divmod(ns, 10**9)
    return datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + f".{rest // 10**6:03d}"


def value_text(v: object) -> str:
    if isinstance(v, (bytes, bytearray, memoryview)):
        b = bytes(v)
        return f"hex[{b[:SHOWN].hex(' ')}{' ...' if len(b) > SHOWN else ''}]"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return f'"{v}"' if isinstance(v, str) else str(v)


def detail_rows(name: str, v: object, depth: int = 0) -> Iterator[str]:
    """An indented tree of a value: dicts (or rows) as structs, lists of pairs as maps."""
    pad = "  " * depth
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        yield f"{pad}{name}:"
        for k, x in v.items():
            yield from detail_rows(str(k), x, depth + 1)
    elif isinstance(v, (list, tuple)):
        yield f"{pad}{name}: [{len(v)}]"
        for i, x in enumerate(v[:SHOWN]):
            yield from detail_rows(f"[{i}]", x, depth + 1)
        if len(v) > SHOWN:
            yield f"{pad}  ... {len(v) - SHOWN} more"
    else:
        yield f"{pad}{name}: {value_text(v)}"


def hex_rows(data: bytes, width: int = 16) -> Iterator[str]:
    """Offset, hexadecimal bytes and printable text of each ``width`` bytes."""
    for at in range(0, len(data), width):
        part = data[at : at + width]
        text = "".join(chr(x) if 32 <= x < 127 else "." for x in part)
        yield f"{at:08x}  {part.hex(' '):<{3 * width - 1}}  {text}"


def schema_view(fields: tuple[Field, ...]) -> str:
    return schema_text(fields)


def raw_schema_view(name: str, encoding: str, data: bytes) -> str:
    """A schema that could not be derived: its text, or its bytes where it is none."""
    try:
        body = data.decode()
    except UnicodeDecodeError:
        body = "\n".join(hex_rows(data))
    return f"{name} ({encoding or 'no encoding'})\n{body}"
