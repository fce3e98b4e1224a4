"""Flattening nested columns into flat ones, by a policy per kind of nesting.

All of it is one ``select`` built from the schema, so Catalyst prunes and pushes
down as with hand-written columns.  The policy holds at every depth.  Arrays of fixed length (field metadata
``fixed_len``) follow the array policy, all others the list policy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.errors import FlattenError
from logloom.ir import FIXED_LEN

LIST_POLICIES, ARRAY_POLICIES, MAP_POLICIES, STRUCT_POLICIES = ("drop", "keep", "flatten-fixed"), ("drop", "keep", "flatten"), ("drop", "keep"), ("keep", "flatten")


def policy(text: str, allowed: tuple[str, ...]) -> str:
    """A policy name in any case; ``flattenfixed`` also stands for ``flatten-fixed``."""
    name = text.strip().lower()
    name = "flatten-fixed" if name == "flattenfixed" else name
    if name not in allowed:
        raise FlattenError(f"invalid policy '{text}': expected one of {', '.join(allowed)}")
    return name


@dataclass(frozen=True)
class FlattenPolicy:
    """``list_size``: columns that ``flatten-fixed`` makes of a list; shorter lists are padded with nulls, longer ones cut."""

    lists: str = "keep"
    arrays: str = "keep"
    maps: str = "keep"
    structs: str = "flatten"
    list_size: int = 1

    def __post_init__(self) -> None:
        for name, allowed in (("lists", LIST_POLICIES), ("arrays", ARRAY_POLICIES), ("maps", MAP_POLICIES), ("structs", STRUCT_POLICIES)):
            object.__setattr__(self, name, policy(getattr(self, name), allowed))


def _columns(c: Column, name: str, dt: T.DataType, metadata: dict, sep: str, p: FlattenPolicy, dropped: set[str]) -> Iterator[tuple[str, Column]]:
    keep = lambda: (name, c.alias(name, metadata=metadata) if metadata else c.alias(name))
    if isinstance(dt, T.StructType):
        if p.structs == "keep":
            yield keep()
            return
        for f in dt.fields:
            yield from _columns(c.getField(f.name), f"{name}{sep}{f.name}", f.dataType, f.metadata, sep, p, dropped)
    elif isinstance(dt, T.MapType):
        if p.maps == "keep":
            yield keep()
        else:
            dropped.add(name)
    elif isinstance(dt, T.ArrayType):
        fixed = metadata.get(FIXED_LEN)
        how = p.lists if fixed is None else p.arrays
        if how == "keep":
            yield keep()
        elif how == "drop":
            dropped.add(name)
        else:
            for i in range(p.list_size if fixed is None else fixed):
                yield from _columns(F.get(c, F.lit(i)), f"{name}{sep}{i}", dt.elementType, {}, sep, p, dropped)
    else:
        yield keep()


def flatten(df: DataFrame, p: FlattenPolicy = FlattenPolicy(), sep: str = ".") -> tuple[DataFrame, list[str]]:
    """The flat frame, and the paths that the policy dropped, sorted."""
    dropped: set[str] = set()
    out: list[Column] = []
    names: set[str] = set()
    for f in df.schema.fields:
        for name, c in _columns(F.col(f"`{f.name}`"), f.name, f.dataType, f.metadata, sep, p, dropped):
            if name in names:
                raise FlattenError(f"flattening column name collision: '{name}'")
            names.add(name)
            out.append(c)
    return df.select(*out), sorted(dropped)
