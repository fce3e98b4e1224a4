"""Nested projection: keep the named fields at any depth, in the order of the schema.

``a.b`` keeps field ``b`` of struct ``a``, or of every element where ``a`` is a list
of structs; a path that names a whole field takes precedence over paths inside
it.  Lists of other things are kept whole, scalars and maps have no sub-fields.
Null structs and list lengths stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.errors import ProjectionError

#: Selection below a field: None keeps it whole.
Tree = dict[str, "Tree | None"]


def selection(paths: list[str]) -> Tree:
    root: Tree = {}
    for path in paths:
        at, parts = root, path.split(".")
        for i, p in enumerate(parts):
            if p in at and at[p] is None:
                break
            if i == len(parts) - 1:
                at[p] = None
            else:
                at = at.setdefault(p, {})
    return root


def _check(fields: list[T.StructField], tree: Tree) -> None:
    names = {f.name for f in fields}
    for n in tree:
        if n not in names:
            raise ProjectionError(f"field '{n}' not found in schema")


def _kept(f: T.StructField, tree: Tree | None) -> bool:
    return tree is None or isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)


def _struct(c: Column, dt: T.StructType, tree: Tree) -> Column:
    _check(dt.fields, tree)
    return F.struct(*[_field(c.getField(f.name), f, tree[f.name]) for f in dt.fields if f.name in tree])


def _field(c: Column, f: T.StructField, tree: Tree | None) -> Column:
    named = lambda x: x.alias(f.name, metadata=f.metadata) if f.metadata else x.alias(f.name)
    if _kept(f, tree):
        return named(c)
    dt = f.dataType
    if isinstance(dt, T.StructType):
        return named(F.when(c.isNotNull(), _struct(c, dt, tree)))
    if isinstance(dt, T.ArrayType):
        return named(F.transform(c, lambda e: F.when(e.isNotNull(), _struct(e, dt.elementType, tree))))
    raise ProjectionError(f"field '{f.name}' is not nested and cannot select sub-field '{next(iter(tree))}'")


def project(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df`` with only the fields of ``paths``; without paths as it is."""
    if not paths:
        return df
    tree = selection(paths)
    _check(df.schema.fields, tree)
    return df.select(*[_field(F.col(f"`{f.name}`"), f, tree[f.name]) for f in df.schema.fields if f.name in tree])
