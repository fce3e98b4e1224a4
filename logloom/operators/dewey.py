"""Nested records into related flat tables, by Dewey labels.

Every element of every array or map below a column gets a Dewey label: the
ordinals met on the way down, alternating (ordinal of the field in its struct,
position in the array).  The parent's label is the label without its last two
ordinals, so parent links need no join and no generated ids, and labels are the
same on every run.  Elements of one schema path form one table.

Defined cases, for all functions of this module:

* a null or empty array, or a null struct on the way, yields no rows below it;
* a null element yields no row but keeps its position, so labels of its
  neighbours do not move;
* repeated records (same key and same structure) count once in ``labels`` and,
  with ``distinct=True``, in ``shred``;
* a null key is a value like any other: its rows come out with a null key;
* an empty input gives empty tables of the full schema;
* other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import tasks


@dataclass(frozen=True)
class SchemaPath:
    """One repeated level: ``steps`` are the struct fields down to each array or map on the way."""

    names: tuple[str, ...]
    ordinals: tuple[int, ...]
    element: T.DataType
    is_map: bool

    @property
    def dotted(self) -> str:
        return ".".join(map(_shown, self.names))


#: Between the names of structs on the way to a level (names may hold dots), and the name of a list or map that is itself an element.
_STEP, _SELF = "\x1f", "[]"


def _shown(name: str) -> str:
    return name.replace(_STEP, ".")


def schema_paths(dtype: T.DataType) -> list[SchemaPath]:
    """Repeated levels below ``dtype``, parents before children, in schema order.

    A level inside plain structs is named by the fields joined with dots
    (``pose.covariance``), and its ordinal counts the repeated levels of its parent.  A list or map that is an element
    of another is a level of its own, named ``[]``.
    """
    out: list[SchemaPath] = []

    def below(dt: T.DataType, names: tuple[str, ...], ordinals: tuple[int, ...]) -> None:
        n = 0

        def walk(st: T.DataType, prefix: str) -> None:
            nonlocal n
            if not isinstance(st, T.StructType):
                return
            for f in st.fields:
                name = f"{prefix}{f.name}"
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, f"{name}{_STEP}")
                elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                    is_map = isinstance(f.dataType, T.MapType)
                    el = f.dataType.valueType if is_map else f.dataType.elementType
                    here = (*names, name), (*ordinals, n)
                    n += 1
                    out.append(SchemaPath(*here, el, is_map))
                    below(el, *here)

        if isinstance(dt, (T.ArrayType, T.MapType)):
            is_map = isinstance(dt, T.MapType)
            el = dt.valueType if is_map else dt.elementType
            out.append(SchemaPath((*names, _SELF), (*ordinals, 0), el, is_map))
            below(el, (*names, _SELF), (*ordinals, 0))
        walk(dt, "")

    below(dtype, (), ())
    return out


def _get(c: Column, path: str) -> Column:
    for name in path.split(_STEP) if path != _SELF else ():
        c = c.getField(name)
    return c


def _level(c: Column, name: str, is_map: bool) -> Column:
    x = _get(c, name)
    return F.map_values(x) if is_map else x


def _labels_of(c: Column, p: SchemaPath, maps: dict[tuple[str, ...], bool]) -> Column:
    """array<array<int>>: the labels of all non-null elements of ``p`` below ``c``."""

    def down(x: Column, depth: int, label: list[Column]) -> Column:
        arr = _level(x, p.names[depth], maps[p.names[: depth + 1]])
        ordinal = F.lit(p.ordinals[depth])
        last = depth == len(p.names) - 1

        def each(e: Column, i: Column) -> Column:
            here = [*label, ordinal, i]
            if last:
                return F.when(e.isNotNull(), F.array(*here))
            return down(e, depth + 1, here)

        got = F.coalesce(F.transform(arr, each), F.array())
        if last:
            return F.filter(got, lambda v: v.isNotNull())
        return F.flatten(F.filter(got, lambda v: v.isNotNull()))

    return down(c, 0, [])


def _tagged(k: int):
    return lambda d: F.struct(F.lit(k).alias("p"), d.alias("dewey"))


def _render(p: SchemaPath, dewey: Column, depth: int) -> Column:
    parts: list[Column] = []
    for k in range(depth):
        name = "" if p.names[k] == _SELF else ("." if k else "") + _shown(p.names[k])
        parts += [F.lit(name + "["), F.get(dewey, F.lit(2 * k + 1)).cast("string"), F.lit("]")]
    return F.concat(*parts) if parts else F.lit("")


def labels(df: DataFrame, key: str, value: str, structs_only: bool = False) -> DataFrame:
    """Label every element below ``value`` in one pass over the input.

    Returns ``(rec_id, schema_path, dewey, parent_dewey, node, parent)``.  The
    labels of a record are computed as one compact array of ordinals, repeated
    records are dropped on that array, and only then are rows and names made.
    ``structs_only`` keeps the levels whose elements are structs.
    """
    dtype = df.schema[value].dataType
    every = schema_paths(dtype)
    maps = {p.names: p.is_map for p in every}
    paths = [p for p in every if not structs_only or (isinstance(p.element, T.StructType) and not p.is_map)]
    col = F.col(f"`{value}`")
    if not paths:
        arrays = F.array().cast("array<struct<p:int,dewey:array<int>>>")
    else:
        arrays = F.concat(*[F.transform(_labels_of(col, p, maps), _tagged(k)) for k, p in enumerate(paths)])
    flat = df.select(F.col(f"`{key}`").alias("rec_id"), arrays.alias("labels")).where(F.size("labels") > 0).distinct()
    rows = flat.select("rec_id", F.explode("labels").alias("x")).select("rec_id", F.col("x.p").alias("p"), F.col("x.dewey").alias("dewey"))

    def by_path(f) -> Column:
        if not paths:
            return F.lit(None).cast("string")
        out = None
        for k, p in enumerate(paths):
            out = F.when(F.col("p") == k, f(p)) if out is None else out.when(F.col("p") == k, f(p))
        return out

    return rows.select(
        "rec_id",
        by_path(lambda p: F.lit(p.dotted)).alias("schema_path"),
        "dewey",
        F.slice("dewey", 1, F.size("dewey") - 2).alias("parent_dewey"),
        by_path(lambda p: _render(p, F.col("dewey"), len(p.names))).alias("node"),
        by_path(lambda p: _render(p, F.col("dewey"), len(p.names) - 1)).alias("parent"),
    )


def _scalars(c: Column, dt: T.DataType, prefix: str = "") -> list[Column]:
    """Leaves of ``dt`` that are not repeated, as flat columns named with ``__`` between levels."""
    if not isinstance(dt, T.StructType):
        return [] if isinstance(dt, (T.ArrayType, T.MapType)) else [c.alias(prefix or "item")]
    out: list[Column] = []
    for f in dt.fields:
        name = f"{prefix}__{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += _scalars(c.getField(f.name), f.dataType, name)
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(c.getField(f.name).alias(name))
    return out


def shred(df: DataFrame, key: str, value: str, distinct: bool = True) -> dict[str, DataFrame]:
    """One flat table per schema path, ``""`` being the record itself.

    Each table has ``_key, _node, _parent, _pos`` (``_entry_key`` for maps) and
    the scalar leaves of its level.  ``_parent`` is ``_node`` truncated and
    equals ``_node`` in the parent's table, so levels join on ``(_key, _parent)``.
    A table reads only its own top-level branch of ``value``: Catalyst prunes the others at the scan.
    """
    dtype = df.schema[value].dataType
    root = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{value}`").alias("_v"))
    every = schema_paths(dtype)
    out = {"": root.where(F.col("_v").isNotNull()).select("_key", F.array().cast("array<int>").alias("_node"), *_scalars(F.col("_v"), dtype))}
    for p in every:
        cur = root.select("_key", F.array().cast("array<int>").alias("_node"), F.col("_v").alias("_e"))
        for k, name in enumerate(p.names):
            level = next(q for q in every if q.names == p.names[: k + 1])
            if level.is_map:
                cur = cur.select("_key", "_node", F.posexplode(_get(F.col("_e"), name)).alias("_pos", "_entry_key", "_e"))
            else:
                cur = cur.select("_key", "_node", F.posexplode(_get(F.col("_e"), name)).alias("_pos", "_e"))
            if not (level.is_map and k == len(p.names) - 1):
                cur = cur.where(F.col("_e").isNotNull())
            extra = ["_entry_key"] if level.is_map and k == len(p.names) - 1 else []
            cur = cur.select("_key", F.concat("_node", F.array(F.lit(p.ordinals[k]), "_pos")).alias("_node"), "_pos", "_e", *extra)
        extra = ["_entry_key"] if p.is_map else []
        out[p.dotted] = cur.select("_key", "_node", F.slice("_node", 1, F.size("_node") - 2).alias("_parent"), "_pos", *extra, *_scalars(F.col("_e"), p.element))
    return {k: v.distinct() for k, v in out.items()} if distinct else out


# --- recursive field definitions -------------------------------------------------


def type_signature(element: object) -> str:
    """The type of an element with bounds, lengths, variants, key and item, but not a struct's own fields."""
    if isinstance(element, str):
        return element
    if not isinstance(element, dict):
        return "?"
    kind = str(element.get("data_type"))
    inner: list[str] = []
    if "variants" in element:
        inner.append("|".join(sorted(f"{v.get('name')}={v.get('value')}" if isinstance(v, dict) else str(v) for v in element["variants"] or [])))
    if "key" in element:
        inner.append(type_signature(element["key"]))
    if "item" in element:
        inner.append(type_signature(element["item"]))
    inner += [f"{k}={int(element[k])}" for k in ("max", "len") if element.get(k) is not None]
    return f"{kind}<{','.join(inner)}>" if inner else kind


def field_nodes(defs: object) -> Iterator[tuple[list[int], str, str, str, int, str, list[str], bool]]:
    """(dewey, node, parent, name, position, type, ancestors, nullable) of each field definition, parents first."""
    stack: list[tuple[object, list[int], str, list[str]]] = [(defs, [], "", [])]
    while stack:
        fields, label, prefix, above = stack.pop()
        for pos, f in enumerate(fields if isinstance(fields, list) else []):
            if not isinstance(f, dict) or f.get("name") is None:
                continue
            name, el = str(f["name"]), f.get("element")
            node = f"{prefix}.{name}" if prefix else name
            here = [*label, pos]
            nullable = isinstance(el, dict) and bool(el.get("nullable", False))
            yield here, node, (above[-1] if above else ""), name, pos, type_signature(el), above, nullable
            inside = node
            while isinstance(el, dict) and "item" in el:
                inside += "{}" if el.get("data_type") == "Map" else "[]"
                el = el["item"]
            if isinstance(el, dict) and el.get("fields"):
                stack.append((el["fields"], here, inside, [*above, node]))


NODES = T.StructType(
    [
        T.StructField("dewey", T.ArrayType(T.IntegerType())),
        T.StructField("node", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("above", T.ArrayType(T.StringType())),
        T.StructField("nullable", T.BooleanType()),
    ]
)
_NODES_ARROW = pa.list_(pa.struct([("dewey", pa.list_(pa.int32())), ("node", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("above", pa.list_(pa.string())), ("nullable", pa.bool_())]))


def parse_fields(text: str | None) -> list[dict] | None:
    """The nodes of a text of field definitions, as ``NODES``; None where it is null, empty or malformed."""
    try:
        defs = json.loads(text) if text else None
    except ValueError:
        return None
    if defs is None:
        return None
    return [dict(zip(NODES.names, row, strict=True)) for row in field_nodes(defs)]


def explode_fields(df: DataFrame, defs: str, keep: list[str], more: Column | None = None) -> DataFrame:
    """One row per field definition of the JSON in column ``defs``: ``keep`` columns plus those of ``NODES``.

    ``more``, an array of such nodes made from ``keep`` columns, is taken along with the definitions.  Equal texts are parsed once per batch.  Null, empty and malformed texts give
    no rows.  The JSON is a recursive union of strings and objects, which no
    Spark schema can express, hence Arrow batches in Python.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    src = df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{defs}`").alias("_defs"))
    out = T.StructType([*fields, T.StructField("_nodes", T.ArrayType(NODES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).dictionary_encode()
            parsed = [parse_fields(t) for t in texts.dictionary.to_pylist()]
            nodes = pa.array([None if i is None else parsed[i] for i in texts.indices.to_pylist()], _NODES_ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], nodes], [*[f.name for f in fields], "_nodes"])

    nodes = F.col("_nodes")
    if more is not None:
        nodes = F.concat(F.coalesce(nodes, F.array().cast(T.ArrayType(NODES))), more.cast(T.ArrayType(NODES)))
    return src.repartition(tasks(df.sparkSession)).mapInArrow(run, out).select(*[F.col(f"`{f.name}`") for f in fields], F.inline(nodes))
