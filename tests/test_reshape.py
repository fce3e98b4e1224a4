import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from logloom import ir
from logloom.errors import FlattenError, ProjectionError, SinkError
from logloom.functions import columns as fn
from logloom.functions import display
from logloom.operators.flatten import FlattenPolicy, flatten, policy
from logloom.operators.project import project
from logloom.sinks.convert import POLICIES, ConvertOptions, convert, schema_of
from logloom.sinks.jsonl import JsonOptions, json_lines, with_rfc3339
from logloom.sources import container as c
from logloom.testkit import models
from logloom.testkit.mcap_writer import McapWriter

NESTED = "id int, o struct<i: struct<v: double, l: string>, n: int>, pts array<struct<x: double, y: double>>, vals array<double>, m map<string, int>, name string"


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, ((1.5, "a"), 2), [(1.0, 2.0), None], [1.0], {"k": 1}, "p"), (2, None, None, None, None, None), (3, (None, 4), [], [], {}, "q")], NESTED)


def names(df):
    return df.schema.simpleString()


def test_projection_rules(df):
    assert project(df, []) is df
    assert names(project(df, ["name", "id"])) == "struct<id:int,name:string>"  # schema order
    assert names(project(df, ["o.i.v"])) == names(project(df, ["o.i.v", "o.i.v"])) == "struct<o:struct<i:struct<v:double>>>"
    assert names(project(df, ["o.i.v", "o"])) == names(project(df, ["o", "o.i.v"])) == "struct<o:struct<i:struct<v:double,l:string>,n:int>>"
    assert names(project(df, ["vals.x"])) == "struct<vals:array<double>>"
    got = rows(project(df, ["pts.y", "id"]))
    assert got == [(1, [(2.0,), None]), (2, None), (3, [])]
    assert rows(project(df, ["o.i.l", "id"])) == [(1, (("a",),)), (2, None), (3, (None,))]


@pytest.mark.parametrize("path,text", [("zz", "field 'zz' not found in schema"), ("o.zz", "field 'zz' not found"), ("o.i.zz", "field 'zz' not found"), ("name.x", "not nested and cannot select sub-field"), ("m.k", "not nested")])
def test_projection_errors(df, path, text):
    with pytest.raises(ProjectionError, match=text):
        project(df, [path])


def test_projection_keeps_fixed_length(spark):
    d = spark.createDataFrame([([(1, 2)],)], "p array<struct<x: int, y: int>>").select(F.col("p").alias("p", metadata={"fixed_len": 1}))
    got = project(d, ["p.x"])
    assert got.schema["p"].metadata == {"fixed_len": 1}
    assert flatten(got, FlattenPolicy(arrays="flatten"))[0].columns == ["p.0.x"]


def test_flatten_policies(df):
    flat, dropped = flatten(df, FlattenPolicy("drop", "drop", "drop"))
    assert flat.columns == ["id", "o.i.v", "o.i.l", "o.n", "name"] and dropped == ["m", "pts", "vals"]
    flat, dropped = flatten(df, FlattenPolicy("flatten-fixed", list_size=2), "_")
    assert flat.columns == ["id", "o_i_v", "o_i_l", "o_n", "pts_0_x", "pts_0_y", "pts_1_x", "pts_1_y", "vals_0", "vals_1", "m", "name"] and dropped == []
    assert rows(flat.select("id", "o_i_v", "pts_0_y", "pts_1_x", "vals_1")) == [(1, 1.5, 2.0, None, None), (2, None, None, None, None), (3, None, None, None, None)]
    flat, dropped = flatten(df, FlattenPolicy("flatten-fixed", list_size=0))
    assert "vals" not in flat.columns and dropped == []
    assert flatten(df, FlattenPolicy(structs="keep", lists="drop"))[0].columns == ["id", "o", "m", "name"]


def test_flatten_collisions_and_policy_names(spark):
    d = spark.createDataFrame([(1, (2,))], "`s.a` int, s struct<a: int>")
    with pytest.raises(FlattenError, match="flattening column name collision: 's.a'"):
        flatten(d)
    assert policy("FlattenFixed", ("drop", "flatten-fixed")) == "flatten-fixed" and policy("DROP", ("drop",)) == "drop"
    with pytest.raises(FlattenError):
        FlattenPolicy(maps="flatten")


def test_fixed_arrays_inside_structs(spark):
    schema = T.StructType([T.StructField("s", T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()), True, {"fixed_len": 2}), T.StructField("l", T.ArrayType(T.IntegerType()))]))])
    d = spark.createDataFrame([(([1, 2], [3]),), (None,)], schema)
    flat, dropped = flatten(d, FlattenPolicy("drop", "flatten", "drop"))
    assert flat.columns == ["s.a.0", "s.a.1"] and dropped == ["s.l"] and rows(flat) == [(1, 2), (None, None)]


# --- JSON Lines -----------------------------------------------------------------------------


def lines(df, **o):
    return [r.value for r in json_lines(df, JsonOptions(**o)).collect()]


def test_json_non_finite_and_bytes(spark):
    d = spark.createDataFrame([(123, 0.1, math.inf, math.nan, bytearray(b"\0\1\xff"))], "log_time bigint, reading float, r double, n double, b binary")
    assert lines(d) == ['{"log_time":123,"reading":0.1,"r":null,"n":null,"b":"0001ff"}']
    assert lines(d, non_finite="string") == ['{"log_time":123,"reading":0.1,"r":"Infinity","n":"NaN","b":"0001ff"}']
    assert '"-Infinity"' in lines(spark.createDataFrame([(-math.inf,)], "x double"), non_finite="string")[0]


def test_json_nulls(spark):
    d = spark.createDataFrame([((42, None), {"a": None, "b": 1}, [None, 2])], "s struct<present: int, missing: int>, m map<string, int>, l array<int>")
    assert lines(d) == ['{"s":{"present":42},"m":{"b":1},"l":[null,2]}']
    (got,) = lines(d, explicit_nulls=True)
    assert json.loads(got) == {"s": {"present": 42, "missing": None}, "m": {"a": None, "b": 1}, "l": [None, 2]}


def test_json_wide_integers(spark):
    from decimal import Decimal

    schema = ir.spark_schema((ir.field("lo", "I64"), ir.field("hi", "U64"), ir.field("u", "U32"), ir.field("s", ir.struct(ir.field("x", "I64"))), ir.field("l", "List", item=ir.Element(ir.Type("U32")))))
    d = spark.createDataFrame([(-(2**63), Decimal(2**64 - 1), 7, (-42,), [1])], schema)
    assert lines(d) == ['{"lo":-9223372036854775808,"hi":18446744073709551615,"u":7,"s":{"x":-42},"l":[1]}']
    assert lines(d, integer64="string") == ['{"lo":"-9223372036854775808","hi":"18446744073709551615","u":7,"s":{"x":"-42"},"l":[1]}']


def test_json_map_keys_and_text(spark):
    d = spark.createDataFrame([({True: 1}, {5: "é\n"}, {2**40: 1})], "a map<boolean, int>, b map<int, string>, c map<bigint, int>")
    assert lines(d) == ['{"a":{"true":1},"b":{"5":"é\\n"},"c":{"1099511627776":1}}']
    with pytest.raises(SinkError):
        JsonOptions(non_finite="odd")


def test_times(spark):
    d = spark.createDataFrame([(1716025282050000123,), (-1,), (None,)], "t bigint")
    assert [r.t for r in with_rfc3339(d, ["t"]).collect()] == ["2024-05-18T09:41:22.050000123Z", "1969-12-31T23:59:59.999999999Z", None]
    assert [r[0] for r in d.select(fn.format_timestamp(F.col("t"))).collect()] == ["2024-05-18 09:41:22.050", "1969-12-31 23:59:59.999", None]
    assert display.time_text(1716025282050000123) == "2024-05-18 09:41:22.050" and display.time_text(2**63) == str(2**63)


def test_display():
    tree = list(display.detail_rows("m", {"stamp": 1, "n": {"items": list(range(40)), "b": b"\1\2", "s": "x", "z": None}}))
    assert tree[0] == "m:" and "  stamp: 1" in tree and "    items: [40]" in tree and any("8 more" in x for x in tree) and '    s: "x"' in tree and "    b: hex[01 02]" in tree
    assert list(display.hex_rows(b"AB\0" * 6))[1].startswith("00000010  42 00")
    assert display.raw_schema_view("n", "", b"text") == "n (no encoding)\ntext"


# --- converter ----------------------------------------------------------------------------------


@pytest.fixture
def log(tmp_path):
    fields = (ir.field("pos", ir.struct(ir.field("x", "F64"), ir.field("y", "F64"))), ir.field("tags", "List", item=ir.Element(ir.Type("String"))), ir.field("cov", "Array", item=ir.Element(ir.Type("F32")), size=2))
    p = str(tmp_path / "v.mcap")
    with McapWriter(p, "zstd", 200) as w:
        s = w.add_schema("d/msg/V", "ros2msg", models.msg_text(fields, "d").encode())
        ch, empty = w.add_channel("/v", "cdr", s), w.add_channel("/empty", "cdr", s)
        for i in range(6):
            w.write(ch, 1716025282050000000 + i, models.cdr(fields, {"pos": {"x": float(i), "y": math.nan}, "tags": ["t"] * i, "cov": [1.0, 2.0]}))
        assert ch != empty
    return p


def test_convert_jsonl(spark, log, tmp_path):
    out = str(tmp_path / "o.jsonl")
    convert(spark, log, "/v", out)
    got = [json.loads(x) for x in open(out)]
    assert len(got) == 6 and got[2] == {"@log_time": "2024-05-18T09:41:22.050000002Z", "@publish_time": "2024-05-18T09:41:22.050000002Z", "pos": {"x": 2.0, "y": None}, "tags": ["t", "t"], "cov": [1.0, 2.0]}
    convert(spark, log, "/v", out, ConvertOptions("jsonl-ext", ("pos.y", "@log_time"), time_ns=True, metadata_prefix="@"))
    assert open(out).readline() == '{"@log_time":1716025282050000000,"pos":{"y":"NaN"}}\n'
    convert(spark, log, "/empty", out)
    assert open(out).read() == ""


def test_convert_csv_and_parquet(spark, log, tmp_path):
    out = str(tmp_path / "o.csv")
    with pytest.warns(UserWarning, match="dropped columns: cov, tags"):
        convert(spark, log, "/v", out, ConvertOptions("csv", time_ns=True))
    assert open(out).read().splitlines()[:2] == ["@log_time,@publish_time,pos.x,pos.y", "1716025282050000000,1716025282050000000,0.0,NaN"]
    convert(spark, log, "/v", out, ConvertOptions("csv", ("tags",), lists="flatten-fixed", list_size=2))
    assert open(out).read().splitlines()[:3] == ["tags.0,tags.1", '"",""', 't,""'] or open(out).read().splitlines()[0] == "tags.0,tags.1"
    convert(spark, log, "/empty", out, ConvertOptions("csv", ("pos.x",)))
    assert open(out).read() == ""
    out = str(tmp_path / "o.parquet")
    convert(spark, log, "/v", out, ConvertOptions("parquet", arrays="flatten"))
    assert spark.read.parquet(out).columns == ["@log_time", "@publish_time", "pos.x", "pos.y", "tags", "cov.0", "cov.1"]
    with pytest.raises(SinkError, match="No messages found for the selected topic"):
        convert(spark, log, "/empty", out, ConvertOptions("parquet"))
    with pytest.raises(SinkError, match="requires -o"):
        convert(spark, log, "/v", None, ConvertOptions("parquet"))


def test_convert_options():
    with pytest.raises(SinkError, match="only used by the list policy flatten-fixed"):
        ConvertOptions("csv", list_size=3)
    with pytest.raises(SinkError, match="only be written as jsonl"):
        ConvertOptions("csv", explicit_nulls=True)
    with pytest.raises(SinkError, match="must not contain '.'"):
        ConvertOptions(metadata_prefix="a.")
    assert ConvertOptions("csv").policy() == POLICIES["csv"]


def test_schema_text_and_cli(log, tmp_path, capsys):
    from logloom.cli import main

    want = "pos: struct\n    x: f64\n    y: f64\ntags: string[]\ncov: f32[2]\n"
    assert schema_of(log, "/v") == want
    assert main(["schema", log, "-t", "/v", "-o", str(tmp_path / "s.txt")]) == 0 and open(tmp_path / "s.txt").read() == want + "\n"
    assert main(["topics", log]) == 0 and capsys.readouterr().out.startswith("/empty\t0\td/msg/V\tros2msg\tcdr\t1\tTrue")
    assert main(["schema", log, "-t", "/none"]) == 1
    assert c.read_summary(c.open_file(log)).message_count("/v") == 6


def test_decode_payload_column(spark):
    from logloom.decode.cdr import CdrDecoder

    fields = (ir.field("a", "U64"), ir.field("s", ir.struct(ir.field("t", "String"))), ir.field("v", "List", item=ir.Element(ir.Type("I16"))))
    d = spark.createDataFrame([(bytearray(models.cdr(fields, {"a": 2**64 - 1, "s": {"t": "x"}, "v": [1, -2]})),), (None,)], "b binary")
    got = d.select(fn.decode_payload(F.col("b"), CdrDecoder(fields, "p/M")).alias("m")).select("m.*").collect()
    assert int(got[0].a) == 2**64 - 1 and got[0].s.t == "x" and got[0].v == [1, -2] and got[1].a is None


def test_decode_columns_by_schema(spark):
    d = spark.createDataFrame([(bytearray(models.cdr((ir.field("x", "I32"), ir.field("s", "String")), {"x": 5, "s": "é"})),)], "b binary")
    assert rows(d.select(fn.decode_cdr(F.col("b"), "p/M", "int32 x\nstring s").alias("m")).select("m.*")) == [(5, "é")]
    fields = (ir.field("n", "I64", True), ir.field("l", "List", item=ir.Element(ir.Type("String"))))
    fds = models.proto_file(fields, "p", "M")
    cls = models.proto_class(fds, "p.M")
    d = spark.createDataFrame([(bytearray(cls(l=["a", "b"]).SerializeToString()),)], "b binary")
    assert rows(d.select(fn.decode_protobuf(F.col("b"), "p.M", fds.SerializeToString()).alias("m")).select("m.*")) == [(None, ["a", "b"])]
