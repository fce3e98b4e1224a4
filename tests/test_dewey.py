import json

from pyspark.sql import functions as F

from conftest import rows
from logloom.operators import dewey

SCHEMA = "id bigint, x string, v struct<a: array<struct<n: int, b: array<struct<m: int>>>>, c: struct<tags: array<string>>, p: map<string, int>>"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_labels_keep_positions_and_skip_nulls(spark):
    df = frame(spark, [(1, "z", ([(1, [(5,), None, (6,)]), None, (2, None)], (["q", None],), {"k": 1}))])
    got = rows(dewey.labels(df, "id", "v", structs_only=True).select("schema_path", "node", "parent", "dewey", "parent_dewey"))
    assert got == [
        ("a", "a[0]", "", [0, 0], []),
        ("a", "a[2]", "", [0, 2], []),
        ("a.b", "a[0].b[0]", "a[0]", [0, 0, 0, 0], [0, 0]),
        ("a.b", "a[0].b[2]", "a[0]", [0, 0, 0, 2], [0, 0]),
    ]
    every = {r[0] for r in rows(dewey.labels(df, "id", "v").select("node"))}
    assert every == {"a[0]", "a[2]", "a[0].b[0]", "a[0].b[2]", "c.tags[0]", "p[0]"}


def test_labels_null_values_repeats_and_empty(spark):
    v = ([(1, [])], None, None)
    df = frame(spark, [(1, "a", v), (1, "b", v), (None, "c", v), (2, "d", None), (3, "e", ([], None, {}))])
    assert rows(dewey.labels(df, "id", "v").select("rec_id", "node")) == [(1, "a[0]"), (None, "a[0]")]
    assert dewey.labels(frame(spark, []), "id", "v").collect() == []


def test_shredded_tables_join_by_truncated_labels(spark):
    df = frame(spark, [(7, "z", ([(1, [(5,), (6,)]), (2, [(7,)])], (["q"],), {"k": 9}))])
    t = dewey.shred(df, "id", "v")
    assert set(t) == {"", "a", "a.b", "c.tags", "p"}
    joined = t["a.b"].alias("x").join(t["a"].alias("y"), (F.col("x._key") == F.col("y._key")) & (F.col("x._parent") == F.col("y._node")))
    assert rows(joined.select("y.n", "x.m")) == [(1, 5), (1, 6), (2, 7)]
    assert rows(t["p"].select("_entry_key", "item")) == [("k", 9)]


def test_field_nodes_of_recursive_definitions(spark):
    defs = [
        {"name": "objects", "element": {"data_type": "List", "item": {"data_type": "Struct", "fields": [{"name": "pose", "element": {"data_type": "Struct", "nullable": True, "fields": [{"name": "x", "element": "F64"}]}}]}}},
        {"name": "m", "element": {"data_type": "Map", "key": "String", "item": {"data_type": "Array", "len": 3, "item": {"data_type": "Struct", "fields": [{"name": "y", "element": "I32"}]}}}},
    ]
    df = spark.createDataFrame([(1, json.dumps(defs)), (2, None), (3, ""), (4, "{bad")], "schema_id bigint, field_defs string")
    got = rows(dewey.explode_fields(df, "field_defs", ["schema_id"]).select("schema_id", "node", "parent", "type", "pos", "nullable"))
    assert got == [
        (1, "m", "", "Map<String,Array<Struct,len=3>>", 1, False),
        (1, "m{}[].y", "m", "I32", 0, False),
        (1, "objects", "", "List<Struct>", 0, False),
        (1, "objects[].pose", "objects", "Struct", 0, True),
        (1, "objects[].pose.x", "objects[].pose", "F64", 0, False),
    ]


def test_type_signature_ignores_own_fields_and_nullable():
    a = {"data_type": "Struct", "nullable": True, "fields": [{"name": "x", "element": "I8"}]}
    assert dewey.type_signature(a) == dewey.type_signature("Struct")
    assert dewey.type_signature({"data_type": "BoundedString", "max": 5}) != dewey.type_signature({"data_type": "BoundedString", "max": 6})
    e = {"data_type": "Enum", "variants": [{"name": "A", "value": 1}, {"value": 2, "name": "B"}]}
    assert dewey.type_signature(e) == dewey.type_signature({"data_type": "Enum", "variants": list(reversed(e["variants"]))})


def test_lists_of_lists_and_names_with_dots(spark):
    """Structs inside lists of lists and maps of lists are reached; a dot in a name is no step."""
    kind = "id bigint, v struct<grid: array<array<struct<x: int>>>, by: map<string, array<struct<y: int>>>, `a.b`: array<struct<`c.d`: int>>, s: struct<l: array<int>>>"
    v = {"grid": [[{"x": 1}, None, {"x": 3}], None, [], [{"x": 4}]], "by": {"k": [{"y": 7}]}, "a.b": [{"c.d": 5}], "s": {"l": [8]}}
    df = spark.createDataFrame([(1, v), (2, None)], kind)
    got = {(r.schema_path, r.node, r.parent) for r in dewey.labels(df, "id", "v").collect()}
    assert got == {
        ("grid", "grid[0]", ""), ("grid", "grid[2]", ""), ("grid", "grid[3]", ""), ("grid.[]", "grid[0][0]", "grid[0]"), ("grid.[]", "grid[0][2]", "grid[0]"), ("grid.[]", "grid[3][0]", "grid[3]"),
        ("by", "by[0]", ""), ("by.[]", "by[0][0]", "by[0]"), ("a.b", "a.b[0]", ""), ("s.l", "s.l[0]", ""),
    }
    t = dewey.shred(df, "id", "v")
    assert rows(t["grid.[]"].select("_parent", "_pos", "x")) == [([0, 0], 0, 1), ([0, 0], 2, 3), ([0, 3], 0, 4)]
    assert rows(t["by.[]"].select("y")) == [(7,)] and rows(t["a.b"].select("`c.d`")) == [(5,)] and rows(t["s.l"].select("item")) == [(8,)]
    assert rows(t["by"].select("_entry_key", "_pos")) == [("k", 0)]
