import datetime as dt
import json

import pytest

from logloom.operators import lifespan, unify

T0 = dt.datetime(2024, 1, 1)


def s(*fields):
    return json.dumps([{"name": n, "element": e} for n, e in fields])


def struct(*fields):
    return {"data_type": "Struct", "fields": [{"name": n, "element": e} for n, e in fields]}


@pytest.mark.parametrize("types,want", [(["I8"], "I8"), (["I8", "I32"], "I32"), (["U8", "I8"], "I16"), (["U32", "I8"], "I64"), (["U64", "I8"], "F64"), (["F32", "I16"], "F32"), (["F32", "I32"], "F64"), (["F64", "String"], "String"), (["List<I8>", "List<I16>"], "String"), (["BoundedString<max=3>", "String"], "String")])
def test_common_type(types, want):
    assert unify.common_type(types) == want


def tables(spark, versions):
    files = spark.createDataFrame([(i, "v", T0 + dt.timedelta(days=i)) for i in range(len(versions))], "file_id bigint, vehicle string, started_at timestamp")
    schemas = spark.createDataFrame([(i, i, "/t", "n", "e", v) for i, v in enumerate(versions)], "schema_id bigint, file_id bigint, topic string, schema_name string, schema_encoding string, field_defs string")
    return files, schemas


def test_aliases_follow_chains_and_structs(spark):
    files, schemas = tables(spark, [s(("a", "I8"), ("p", struct(("x", "F32")))), s(("b", "I8"), ("q", struct(("x", "F32")))), s(("c", "I8"), ("q", struct(("x", "F64")))), s(("c", "I16"), ("q", struct(("x", "F64"))), ("a", "Bool"))])
    got = {(r.path, r.since, r.until, r.canonical) for r in unify.aliases(lifespan.changes(files, schemas)).collect()}
    assert got == {("a", 1, 1, "c"), ("b", 2, 2, "c"), ("p", 1, 1, "q")}
    cols = {(r.file_id, r.path): (r.canonical, r.cast) for r in unify.columns(files, schemas).collect()}
    assert cols[0, "a"] == cols[1, "b"] == cols[3, "c"] == ("c", "I16")
    assert cols[0, "p.x"] == cols[2, "q.x"] == ("q.x", "F64") and cols[3, "a"] == ("a", "Bool")


def test_unified_messages(spark):
    files, schemas = tables(spark, [s(("a", "I8"), ("p", struct(("x", "F32"))), ("l", {"data_type": "List", "item": "I8"})), s(("b", "F64"), ("q", struct(("x", "F32"))), ("l", {"data_type": "List", "item": "I8"}))])
    schemas = schemas.union(spark.createDataFrame([(9, 99, "/t", "n", "e", s(("a", "I8")))], schemas.schema))
    msgs = spark.createDataFrame([(1, 0, "/t", 5, '{"a": "7", "p": {"x": 1.5}, "l": [1, 2]}'), (2, 1, "/t", 6, '{"b": 2.5, "q": null}'), (3, 1, "/t", 7, "{bad"), (4, 1, "/t", 8, None), (5, 42, "/t", 9, '{"a": 1}')], "msg_id bigint, file_id bigint, topic string, log_time bigint, value string")
    df = unify.unified(msgs, unify.columns(files, schemas))
    assert dict(df.dtypes) == {"msg_id": "bigint", "file_id": "bigint", "topic": "string", "log_time": "bigint", "a": "tinyint", "b": "double", "l": "string", "q.x": "float"}
    got = {r.msg_id: (r["a"], r["b"], r["q.x"], r["l"]) for r in df.collect()}
    none = (None,) * 4
    assert got == {1: (7, None, 1.5, "[1,2]"), 2: (None, 2.5, None, None), 3: none, 4: none, 5: none}
    assert unify.unified(msgs.limit(0), unify.columns(files, schemas)).collect() == []
    assert unify.unified(msgs, unify.columns(files, schemas.limit(0))).columns == ["msg_id", "file_id", "topic", "log_time"]


def test_names_that_differ_by_case_and_leaves_that_become_structs(spark):
    files, schemas = tables(spark, [s(("a", "I8"), ("A", "String"), ("p", "F64")), s(("a", "I8"), ("A", "String"), ("p", struct(("x", "I32"))))])
    msgs = spark.createDataFrame([(1, 0, "/t", 5, '{"a": 1, "A": "z", "p": 2.5}'), (2, 1, "/t", 6, '{"a": 300, "A": "y", "p": {"x": 8}}'), (3, 1, "/t", 6, '{"a": "no", "p": {"x": 1.5}}')], "msg_id bigint, file_id bigint, topic string, log_time bigint, value string")
    got = {r.msg_id: tuple(r[4:]) for r in unify.unified(msgs, unify.columns(files, schemas)).select("msg_id", "file_id", "topic", "log_time", "`A`", "`a~2`", "p", "`p.x`").collect()}
    assert got == {1: ("z", 1, 2.5, None), 2: ("y", None, None, 8), 3: (None, None, None, None)}


@pytest.mark.parametrize("between", [("device", "y"), ("raw", "x")])
def test_renames_of_a_field_and_of_the_struct_around_it(spark, between):
    one = lambda top, leaf, kind: s((top, struct((leaf, kind), ("z", "Bool"))), ("k", "I8"))
    files, schemas = tables(spark, [one("device", "x", "F32"), one(*between, "F32"), one("raw", "y", "F32"), one("raw", "y", "F64")])
    got = {(r.canonical, r.cast) for r in unify.columns(files, schemas).collect()}
    assert got == {("raw.y", "F64"), ("raw.z", "Bool"), ("k", "I8")}
