"""Schema bundles and the resolution of type names, shared by both ROS 2 grammars."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from logloom.errors import SchemaDerivation
from logloom.ir import Element, Field, Type

Name = tuple[str, ...]


class SchemaText(Exception):
    """A text that is no valid schema."""


@dataclass(frozen=True)
class Expr:
    """A type as written: a primitive or bounded string ``kind``, a sequence of ``item``, or a ``ref`` to a name."""

    kind: str
    size: int | None = None
    item: Expr | None = None
    ref: Name = ()


@dataclass(frozen=True)
class Member:
    name: str
    expr: Expr
    length: int | None = None  # of a fixed array


@dataclass
class Definitions:
    structs: dict[Name, list[Member]] = field(default_factory=dict)
    enums: dict[Name, list[tuple[str, int]]] = field(default_factory=dict)
    consts: dict[Name, list[tuple[str, str]]] = field(default_factory=dict)  # (name, value as written)

    def merge(self, other: Definitions) -> None:
        for mine, theirs in ((self.structs, other.structs), (self.enums, other.enums), (self.consts, other.consts)):
            mine.update(theirs)


def normalized(name: str) -> str:
    """``pkg/Type`` and ``pkg/kind/Type`` as ``pkg/kind/Type``; anything else is no schema name."""
    parts = name.split("/")
    if all(parts) and len(parts) == 2:
        return f"{parts[0]}/msg/{parts[1]}"
    if all(parts) and len(parts) == 3:
        return name
    raise SchemaText(f"invalid schema name format: {name}")


def qualified(name: str) -> Name:
    return tuple(normalized(name).split("/"))


def sections(text: str) -> list[list[str]]:
    """Lines of each non-blank section; a line of three or more ``=`` separates."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if re.fullmatch(r"\s*={3,}\s*", line):
            out.append([])
        else:
            out[-1].append(line)
    return [s for s in out if any(x.strip() for x in s)]


def main_section(paths: list[str], wanted: str) -> str:
    return wanted if wanted in paths else paths[0]


_STAMP = [Member("sec", Expr("I32")), Member("nanosec", Expr("U32"))]


class Resolver:
    """Turns definitions into the fields of a root type."""

    def __init__(self, defs: Definitions) -> None:
        self.defs = defs
        for t in ("Time", "Duration"):
            defs.structs.setdefault(("builtin_interfaces", "msg", t), list(_STAMP))

    def _unique_ending(self, names: object, wanted: Name) -> Name | None:
        found = [n for n in names if n[-len(wanted) :] == wanted]
        return found[0] if len(found) == 1 else None

    def lookup(self, ref: Name, inside: Name) -> Name:
        """Exact struct, exact enum, unique struct ending, unique enum ending; a bare name is taken in its own module first."""
        wanted = (*inside[:-1], *ref) if len(ref) == 1 else ref
        for names in (self.defs.structs, self.defs.enums):
            if wanted in names:
                return wanted
        for names in (self.defs.structs, self.defs.enums):
            if got := self._unique_ending(names, wanted):
                return got
        raise SchemaText(f"unresolved type '{'::'.join(ref)}' in '{'::'.join(inside)}'")

    def check(self) -> None:
        """Every member of every struct must resolve, reachable or not."""
        for name, members in self.defs.structs.items():
            for m in members:
                e = m.expr
                while e.item is not None:
                    e = e.item
                if e.ref:
                    self.lookup(e.ref, name)

    def fields(self, root: Name) -> tuple[Field, ...]:
        self.check()
        if root not in self.defs.structs:
            raise SchemaText(f"root type '{'::'.join(root)}' not found in parsed structs")
        return self._struct(root, ()).fields

    def _struct(self, name: Name, above: tuple[Name, ...]) -> Type:
        if name in above:
            raise SchemaDerivation(f"type '{'::'.join(name)}' contains itself")
        return Type("Struct", fields=tuple(Field(m.name, Element(self._member(m, name, (*above, name)))) for m in self.defs.structs[name]))

    def _member(self, m: Member, name: Name, above: tuple[Name, ...]) -> Type:
        t = self._type(m.expr, name, above)
        return Type("Array", Element(t), size=m.length) if m.length is not None else t

    def _type(self, e: Expr, name: Name, above: tuple[Name, ...]) -> Type:
        if e.ref:
            got = self.lookup(e.ref, name)
            return self._struct(got, above) if got in self.defs.structs else Type("Enum", variants=tuple(self.defs.enums[got]))
        if e.item is not None:
            if e.item.kind == "U8" and not e.item.ref:
                return Type("Bytes") if e.size is None else Type("BoundedBytes", size=e.size)
            return Type("List" if e.size is None else "BoundedList", Element(self._type(e.item, name, above)), size=e.size)
        return Type(e.kind, size=e.size)
