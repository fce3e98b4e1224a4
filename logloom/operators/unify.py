"""One consistent table from messages whose schema drifts: aliases and casts from the catalogue of changes.

``aliases`` follows renames forward, so every field of every file has the name it
bears last; ``casts`` gives each such column the narrowest type that holds all its
types; ``unified`` brings JSON messages of all files into one table of typed columns.

Defined cases: a field that was removed and came back is the same column; a
renamed struct carries its fields along, whether they are renamed before or after it; types of different families meet in
``String``; values that do not fit their cast, and fields a message lacks, are null;
messages of files without a schema or version, and those whose value is null or no
JSON object, have null in every column; repeated rows come out repeated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import ir
from logloom.operators import lifespan
from logloom.session import checkpointed

_INTEGERS = ("I8", "U8", "I16", "U16", "I32", "U32", "I64", "U64")


def common_type(types: list[str]) -> str:
    """Narrowest type that holds values of all the types; ``String`` where there is none."""
    names = {t.split("<", 1)[0] for t in types}
    whole = set(types)
    if len(whole) == 1:
        return types[0]
    if names <= {*_INTEGERS}:
        signed = any(n[0] == "I" for n in names)
        need = max(int(n[1:]) + (1 if signed and n[0] == "U" else 0) for n in names)
        for n in _INTEGERS:
            if int(n[1:]) >= need and (n[0] == "I") == signed:
                return n
        return "F64"
    if names <= {*_INTEGERS, "F32", "F64"}:
        return "F32" if names <= {"F32", "I8", "U8", "I16", "U16"} else "F64"
    return "String"


def _chains(events: pd.DataFrame) -> pd.DataFrame:
    """Alias rows of one producer and topic from its additions and renames, latest first."""
    out: list[tuple] = []
    last: dict[str, list[tuple[int, int, str]]] = {}  # path -> (from, to, final name), later ones first
    ev = events.sort_values("seq")
    came = list(zip(ev["field_path"], ev["seq"], strict=True))
    for old, new, seq in ev.loc[ev["change"] == "renamed", ["old_path", "field_path", "seq"]].iloc[::-1].itertuples(index=False):
        final = next((f for a, b, f in last.get(new, []) if a <= seq <= b), new)
        since = max([s for p, s in came if p == old and s < seq], default=1)
        last.setdefault(old, []).append((since, seq - 1, final))
        out.append((old, since, seq - 1, final))
    first = ev.iloc[0]
    return pd.DataFrame([(first["producer"], first["topic"], *r) for r in out], columns=["producer", "topic", "path", "since", "until", "canonical"])


def aliases(changes: DataFrame) -> DataFrame:
    """``(producer, topic, path, since, until, canonical)``: from version ``since`` to ``until`` ``path`` is what is last called ``canonical``.

    A group holds a producer's additions and renames of one topic, not its files or messages.
    """
    events = changes.where(F.col("change").isin("added", "renamed")).select("producer", "topic", "seq", "change", "field_path", "old_path")
    return events.groupBy("producer", "topic").applyInPandas(_chains, "producer string, topic string, path string, since bigint, until bigint, canonical string")


def _within(path: str, old: str) -> bool:
    return path.startswith(old) and path[len(old) : len(old) + 1] in ("", ".", "[", "{")


def _names(nodes: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """Spans of versions in which a path is last called otherwise.

    Renames are replayed version by version along the whole path: each replaces the path or the part of it that leads
    through the renamed struct, unless the field or a struct around it came anew since.
    """
    out: list[tuple] = []
    ev = events.sort_values("seq")
    came = [(int(q), p) for q, p in zip(ev["seq"], ev["field_path"], strict=True)]
    renames: dict[int, list[tuple[str, str, int]]] = {}
    for q, old, new in ev.loc[ev["change"] == "renamed", ["seq", "old_path", "field_path"]].itertuples(index=False):
        since = max([s for s, p in came if s < q and _within(old, p)], default=1)
        renames.setdefault(int(q), []).append((old, new, since))
    starts = sorted({1, *(q for q, _ in came)})
    last = max(renames, default=0)
    for node in nodes["node"]:
        spans: list[list] = []
        for v, after in zip(starts, [*starts[1:], last], strict=True):
            if v >= last:
                break
            path, at = node, v
            for q in (q for q in renames if q > v):
                hit = max(((old, new) for old, new, since in renames[q] if since <= at and _within(path, old)), key=lambda r: len(r[0]), default=None)
                if hit:
                    path, at = hit[1] + path[len(hit[0]) :], q
            if path != node:
                if spans and spans[-1][1] == v - 1 and spans[-1][2] == path:
                    spans[-1][1] = after - 1
                else:
                    spans.append([v, after - 1, path])
        out += [(nodes["producer"].iloc[0], nodes["topic"].iloc[0], node, *x) for x in spans]
    return pd.DataFrame(out, columns=["producer", "topic", "node", "since", "until", "canonical"])


def columns(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(producer, topic, file_id, path, canonical, type, cast)``: each field of each file with its column and common type."""
    # One compact row per schema, used for its fields and for the changes.
    vers = checkpointed(lifespan.versions(files, schemas))
    defs = lifespan.definitions(schemas)
    fields = vers.join(defs.select("digest", "nodes"), "digest").select(*[F.col(c).alias(c) for c in ("producer", "topic", "seq", "file_id")], F.inline("nodes")).where(~F.col("type").rlike(r"^Struct\b"))
    on = ["producer", "topic"]
    events = lifespan.changes_of(vers, defs).where(F.col("change").isin("added", "renamed")).select(*on, "seq", "change", "field_path", "old_path")
    nodes = fields.select(*on, "node").distinct()
    names = nodes.groupBy(*on).cogroup(events.groupBy(*on)).applyInPandas(_names, "producer string, topic string, node string, since bigint, until bigint, canonical string")
    span = [F.col(f"f.{c}") == F.col(f"n.{c}") for c in (*on, "node")] + [F.col("f.seq").between(F.col("n.since"), F.col("n.until"))]
    named = fields.alias("f").join(names.alias("n"), span, "left").select("f.producer", "f.topic", "f.file_id", "f.node", "f.type", F.coalesce("n.canonical", "f.node").alias("canonical")).distinct()

    @F.pandas_udf("string")
    def common(types: pd.Series) -> pd.Series:
        return types.map(lambda t: common_type(sorted(t)))

    kinds = named.groupBy("topic", "canonical").agg(F.collect_set("type").alias("types")).select("topic", "canonical", common("types").alias("cast"))
    return named.join(kinds, ["topic", "canonical"]).select("producer", "topic", "file_id", F.col("node").alias("path"), "canonical", "type", "cast")


def spark_type_of(cast: str) -> T.DataType:
    """Type of a column cast to a schema type; lists, maps and whatever has no plain type stay JSON text."""
    return ir.spark_type(ir.Type(cast)) if cast in (*_INTEGERS, "F32", "F64", "Bool") else T.StringType()


def _tree(paths: list[str]) -> dict:
    """Names below names; a path that is a field in one file and a struct in another is a leaf with what follows read from its text."""
    out: dict = {}
    for p in sorted(paths):
        at = out
        for name in p.split("."):
            at = at.setdefault(name, {})
    return out


def _shape(tree: dict, leaves: set[str], path: str = "") -> tuple[T.StructType, T.StructType]:
    """(as read from JSON, under unique names), since names may differ by case only."""
    read, named = [], []
    for k, (name, below) in enumerate(tree.items()):
        here = f"{path}.{name}" if path else name
        a = b = T.StringType()
        if below and here not in leaves:
            a, b = _shape(below, leaves, here)
        read.append(T.StructField(name, a))
        named.append(T.StructField(f"c{k}", b))
    return T.StructType(read), T.StructType(named)


def _leaf(record: Column, tree: dict, leaves: set[str], path: str) -> Column:
    names, here = path.split("."), ""
    for k, name in enumerate(names):
        here = f"{here}.{name}" if here else name
        record = record.getField(f"c{list(tree).index(name)}")
        if here in leaves and k + 1 < len(names):
            return F.get_json_object(record, "$" + "".join(f"['{n}']" for n in names[k + 1 :]))
        tree = tree[name]
    return record


def unified(messages: DataFrame, cols: DataFrame, value: str = "value") -> DataFrame:
    """``(msg_id, file_id, topic, log_time, ...)``: one typed column per field of any file, under its last name.

    The JSON is read once with every path that any file has; a column takes the path that the message's file uses for it,
    cast to the common type.  Fields inside lists and maps stay in the JSON text of theirs.  What comes to the driver are the
    distinct fields of all schemas, not files or messages.  Of names that differ by case only, later ones get a ``~`` and a number.
    """
    # The columns of the messages' topics, once: they name the result's columns and say which path a file uses.
    top = checkpointed(cols.where(~F.col("path").rlike(r"\[\]|\{\}")).join(messages.select("topic").distinct(), "topic", "left_semi"))
    pairs = sorted((r.canonical, r.path, r.cast) for r in top.select("canonical", "path", "cast").distinct().collect())
    by: dict[str, dict[str, int]] = {}
    casts: dict[str, set[str]] = {}
    for canonical, path, cast in pairs:
        paths = by.setdefault(canonical, {})
        paths.setdefault(path, 0)
        casts.setdefault(canonical, set()).add(cast)
    number = {(c, p): k for k, (c, p) in enumerate((c, p) for c in by for p in by[c])}
    base = messages.select("msg_id", "file_id", "topic", "log_time", F.col(f"`{value}`").alias("_value"))
    if not number:
        return base.drop("_value")
    table = F.create_map(*[x for (c, p), k in number.items() for x in (F.lit(f"{c}\n{p}"), F.lit(k))])
    plan = top.groupBy("file_id", "topic").agg(F.collect_set(table[F.concat_ws("\n", "canonical", "path")]).alias("_on"))
    leaves = {p for _, p in number}
    tree = _tree(sorted(leaves))
    read, named = _shape(tree, leaves)
    src = base.join(plan, ["file_id", "topic"], "left").withColumn("_record", F.from_json("_value", read).cast(named))
    out, seen = [], {"msg_id", "file_id", "topic", "log_time"}
    for canonical in by:
        kind = spark_type_of(common_type(sorted(casts[canonical])))
        got = [F.when(F.array_contains("_on", number[canonical, p]), _leaf(F.col("_record"), tree, leaves, p)) for p in by[canonical]]
        name, k = canonical, 1
        while name.lower() in seen:
            k += 1
            name = f"{canonical}~{k}"
        seen.add(name.lower())
        text = F.coalesce(*got)
        out.append((text if isinstance(kind, T.StringType) else text.try_cast(kind)).alias(name))
    return src.select("msg_id", "file_id", "topic", "log_time", *out)
