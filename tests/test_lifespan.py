import datetime as dt
import json

import pytest

from conftest import rows
from logloom.operators import lifespan

T0 = dt.datetime(2024, 1, 1)


def s(*fields):
    return json.dumps([{"name": n, "element": e} for n, e in fields])


def struct(*fields):
    return {"data_type": "Struct", "fields": [{"name": n, "element": e} for n, e in fields]}


def run(spark, versions, name=None, encoding=None):
    files = spark.createDataFrame([(i, "v", T0 + dt.timedelta(days=40 * i)) for i in range(len(versions))] + [(99, "v", None), (0, "v", T0)], "file_id bigint, vehicle string, started_at timestamp")
    schemas = spark.createDataFrame([(i, i, "/t", (name or ["n"] * 99)[i], (encoding or ["e"] * 99)[i], v) for i, v in enumerate(versions)] * 2 + [(99, 99, "/t", "q", "e", versions[0])], "schema_id bigint, file_id bigint, topic string, schema_name string, schema_encoding string, field_defs string")
    return rows(lifespan.changes(files, schemas).select("file_id", "field_path", "change"))


def test_added_removed_renamed_retyped(spark):
    got = run(spark, [s(("a", "I8"), ("b", "F32")), s(("a", "I16"), ("c", "F32")), s(("a", "I16"), ("c", "F32"), ("d", "Bool")), s(("c", "F32"), ("a", "I16"))])
    assert got == [(1, "a", "retyped"), (1, "c", "renamed"), (2, "d", "added"), (3, "d", "removed")]


def test_nothing_below_a_reported_field(spark):
    got = run(spark, [s(("p", struct(("x", "F64"), ("y", "F64")))), s(("q", struct(("x", "F64"), ("z", "I8"))))])
    assert got == [(1, "q", "renamed")]
    got = run(spark, [s(("p", struct(("x", "F64")))), s(("p", {"data_type": "List", "item": struct(("x", "F64"))}))])
    assert got == [(1, "p", "retyped")]
    got = run(spark, [s(("p", struct(("x", "F64")))), s(("p", struct(("x", "F64"), ("y", "F64"))))])
    assert got == [(1, "p.y", "added")]


def test_nullable_and_order_alone_are_no_change(spark):
    assert run(spark, [s(("a", "I8"), ("b", "F32")), s(("b", {"data_type": "F32", "nullable": True}), ("a", "I8"))]) == []


def test_name_and_encoding_with_nulls(spark):
    got = run(spark, [s(("a", "I8"))] * 3, ["n", None, None], ["e", "e", "f"])
    assert got == [(1, "", "schema_name"), (2, "", "schema_encoding")]


def test_a_field_may_come_back(spark):
    got = run(spark, [s(("a", "I8"), ("b", "I8")), s(("a", "I8")), s(("a", "I8"), ("b", "I8"))])
    assert got == [(1, "b", "removed"), (2, "b", "added")]


def test_blocks_do_not_matter(spark, monkeypatch):
    versions = [s(("a", "I8" if i % 3 else "I16"), (f"f{i // 4}", "F32")) for i in range(20)]
    whole = run(spark, versions)
    monkeypatch.setattr(lifespan, "BLOCK", 3)
    assert run(spark, versions) == whole and len(whole) > 10


def test_malformed_and_empty(spark):
    assert run(spark, [s(("a", "I8")), "{bad"]) == [(1, "a", "removed")]
    files = spark.createDataFrame([], "file_id bigint, vehicle string, started_at timestamp")
    schemas = spark.createDataFrame([], "schema_id bigint, file_id bigint, topic string, schema_name string, schema_encoding string, field_defs string")
    assert lifespan.changes(files, schemas).collect() == []


@pytest.mark.parametrize("left,right", [("I8", "I16"), ({"data_type": "BoundedString", "max": 3}, {"data_type": "BoundedString", "max": 4})])
def test_bounds_belong_to_the_type(spark, left, right):
    assert run(spark, [s(("a", left)), s(("a", right))]) == [(1, "a", "retyped")]


def brute(files, schemas):
    """Compare each file with the one before, walking both definitions together."""
    out = set()
    as_dict = lambda e: e if isinstance(e, dict) else {"data_type": e}

    def kind(e):
        e = as_dict(e)
        return e["data_type"], e.get("max"), e.get("len"), str(sorted(map(str, e.get("variants") or []))), kind(e["item"]) if "item" in e else None, kind(e["key"]) if "key" in e else None

    def inside(e):
        e, marks = as_dict(e), ""
        while "item" in e:
            marks += "{}" if e["data_type"] == "Map" else "[]"
            e = as_dict(e["item"])
        return marks, e.get("fields") or []

    def compare(a, b, path, key):
        old = {f["name"]: (i, f["element"]) for i, f in enumerate(a)}
        new = {f["name"]: (i, f["element"]) for i, f in enumerate(b)}
        full = lambda n: f"{path}.{n}" if path else n
        went = {n for n in old if n not in new}
        for n in new:
            if n in old:
                if kind(old[n][1]) != kind(new[n][1]):
                    out.add((*key, full(n), "retyped"))
                else:
                    compare(inside(old[n][1])[1], inside(new[n][1])[1], full(n) + inside(new[n][1])[0], key)
                continue
            same = [w for w in went if old[w][0] == new[n][0] and kind(old[w][1]) == kind(new[n][1])]
            out.add((*key, full(n), "renamed" if same else "added"))
            went -= set(same[:1])
        out.update((*key, full(w), "removed") for w in went)

    by = {}
    for r in {tuple(r) for r in schemas}:
        if r[1] in files:
            by.setdefault((files[r[1]][0], r[2]), []).append((files[r[1]][1], r))
    for versions in by.values():
        versions.sort()
        for (_, a), (_, b) in zip(versions, versions[1:]):
            key = (b[1], b[2])
            compare(json.loads(a[5]), json.loads(b[5]), "", key)
            out.update((*key, "", n) for k, n in ((3, "schema_name"), (4, "schema_encoding")) if a[k] != b[k])
    return out


def test_whole_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    files, schemas = spark.read.parquet(f"{sf}/mcap_files.parquet"), spark.read.parquet(f"{sf}/topic_schemas.parquet")
    names = ["schema_id", "file_id", "topic", "schema_name", "schema_encoding", "field_defs"]
    want = brute({r.file_id: (r.vehicle, r.started_at) for r in files.collect()}, schemas.select(*names).collect())
    got = {tuple(r) for r in lifespan.changes(files, schemas).select("file_id", "topic", "field_path", "change").collect()}
    assert got == want and len(got) > 20
