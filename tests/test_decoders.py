import pickle
import struct as st

import pytest
from google.protobuf import descriptor_pb2
from hypothesis import given, settings
from hypothesis import strategies as hs

from logloom.decode.base import JsonDecoder, ProtobufDecoder, Registry, Ros2IdlDecoder, Ros2MsgDecoder
from logloom import ir
from logloom.decode.batches import Metadata, batched, payload_batches, record_batch, to_array
from logloom.decode.cdr import CdrDecoder
from logloom.decode.protobuf import decode_value
from logloom.errors import ConvertError, EmptyRows, MessageDecode, MetadataColumnCollision, NoDecoder, SchemaDerivation, SchemaParse, ValueTypeError
from logloom.ir import Element, Type, field, struct
from logloom.schema import protobuf as pb
from logloom.testkit import models

HEAD = b"\0\1\0\0"


def dec(*fields):
    return CdrDecoder(tuple(fields), "pkg/msg/T")


def fails(d, data, message):
    with pytest.raises(MessageDecode) as e:
        d.decode(data)
    assert message in str(e.value)


def test_alignment_and_trailing_bytes():
    d = dec(field("a", "U8"), field("b", "U32"), field("c", "U8"), field("d", "F64"), field("s", "String"))
    body = b"\x01\0\0\0" + st.pack("<I", 7) + b"\x02" + b"\0" * 7 + st.pack("<d", 1.5) + st.pack("<I", 3) + b"hi\0" + b"junk"
    assert d.decode(HEAD + body) == {"a": 1, "b": 7, "c": 2, "d": 1.5, "s": "hi"}


def test_header_errors():
    d = dec(field("a", "U8"))
    fails(d, b"\0\1", "incomplete encapsulation header")
    fails(d, b"\0\0\0\0\1", "unsupported CDR endianness: 0x00")
    assert d.decode(b"\xff\1\xff\xff\5") == {"a": 5}


def test_strings():
    d, b = dec(field("s", "String")), dec(field("s", "BoundedString", size=2))
    assert d.decode(HEAD + st.pack("<I", 0)) == {"s": ""}
    fails(d, HEAD + st.pack("<I", 2) + b"ab", "string missing null terminator at pkg.msg.T.s")
    fails(d, HEAD + st.pack("<I", 2) + b"\xff\0", "invalid UTF-8 at pkg.msg.T.s")
    fails(d, HEAD + st.pack("<I", 9) + b"ab\0", "unexpected EOF at pkg.msg.T.s")
    fails(b, HEAD + st.pack("<I", 4) + b"abc\0", "bounded string overflow at pkg.msg.T.s: 3 > 2")
    fails(dec(field("w", "WString")), HEAD + b"\0" * 8, "wstring not supported at pkg.msg.T.w")


def test_sequences_arrays_and_enums():
    seq = dec(field("v", "BoundedList", item=Element(Type("U8")), size=2), field("b", "Bytes"))
    fails(seq, HEAD + st.pack("<I", 3) + b"abc", "sequence bound overflow at pkg.msg.T.v: 3 > 2")
    fails(dec(field("v", "List", item=Element(Type("F64")))), HEAD + st.pack("<I", 10**9), "exceeds remaining")
    arr = dec(field("a", "Array", item=Element(Type("U8")), size=3), field("e", "Enum", variants=(("NEG", -1), ("ONE", 1))))
    assert arr.decode(HEAD + b"\1\2\3\0" + b"\xff" * 4) == {"a": [1, 2, 3], "e": "NEG"}
    assert arr.decode(HEAD + b"\1\2\3\0" + st.pack("<I", 9))["e"] == "9"
    fails(dec(field("a", "Array", item=Element(struct(field("s", "String"))), size=2)), HEAD + st.pack("<I", 2) + b"a\0\0\0", "pkg.msg.T.a[1].s")


def test_empty_struct_takes_one_byte():
    d = dec(field("e", struct()), field("x", "U8"))
    assert d.decode(HEAD + b"\0\7") == {"e": {}, "x": 7}
    assert dec(field("b", "Bool")).decode(HEAD + b"\5") == {"b": True}


VALUES = {"I8": hs.integers(-128, 127), "U16": hs.integers(0, 65535), "I64": hs.integers(-(2**63), 2**63 - 1), "U64": hs.integers(0, 2**64 - 1), "F64": hs.floats(allow_nan=False), "String": hs.text(hs.characters(codec="utf-8", exclude_characters="\0")), "Bool": hs.booleans(), "Bytes": hs.binary()}


@hs.composite
def typed(draw, depth=0):
    kind = draw(hs.sampled_from([*VALUES, *(["List", "Array", "Struct"] if depth < 3 else [])]))
    if kind in VALUES:
        return Type(kind), draw(VALUES[kind])
    if kind == "Struct":
        parts = [draw(typed(depth + 1)) for _ in range(draw(hs.integers(0, 3)))]
        return struct(*[field(f"f{i}", t) for i, (t, _) in enumerate(parts)]), {f"f{i}": v for i, (_, v) in enumerate(parts)}
    t, v = draw(typed(depth + 1))
    n = draw(hs.integers(1 if kind == "Array" else 0, 20))  # no grammar allows arrays of length 0
    return Type(kind, Element(t), size=n if kind == "Array" else None), [v] * n


@settings(max_examples=200, deadline=None, derandomize=True)
@given(hs.lists(typed(), min_size=1, max_size=4))
def test_cdr_round_trip(parts):
    fields = tuple(field(f"x{i}", t) for i, (t, _) in enumerate(parts))
    value = {f"x{i}": v for i, (_, v) in enumerate(parts)}
    d = pickle.loads(pickle.dumps(CdrDecoder(fields, "p/M")))
    assert d.decode(models.cdr(fields, value)) == value


@pytest.mark.parametrize("case", ["flat", "nested", "strings", "numeric_array"])
def test_grammars_agree_with_the_model(case):
    fields = models.CASES[case]
    assert Ros2MsgDecoder().topic("bench/Sample", models.msg_text(fields, "bench").encode()).fields == fields
    assert Ros2IdlDecoder().topic("bench/msg/Sample", models.idl_text(fields, "bench", "Sample").encode()).fields == fields


# --- protobuf ---------------------------------------------------------------------------


def test_protobuf_columns_equal_the_messages_one_by_one():
    """Unset, repeated, map, enum, nested and empty fields, by both ways."""
    f = descriptor_pb2.FileDescriptorProto(name="x.proto", package="x", syntax="proto3")
    e = f.enum_type.add(name="E")
    for n, v in (("ZERO", 0), ("ONE", 1)):
        e.value.add(name=n, number=v)
    inner = f.message_type.add(name="In")
    inner.field.add(name="u", number=1, label=1, type=4)
    inner.field.add(name="names", number=2, label=3, type=9)
    f.message_type.add(name="Empty")
    m = f.message_type.add(name="M")
    m.field.add(name="one", number=1, label=1, type=11, type_name=".x.In")
    m.field.add(name="many", number=2, label=3, type=11, type_name=".x.In")
    m.field.add(name="kind", number=3, label=1, type=14, type_name=".x.E")
    m.field.add(name="kinds", number=4, label=3, type=14, type_name=".x.E")
    m.field.add(name="blob", number=5, label=1, type=12)
    m.field.add(name="none", number=6, label=1, type=11, type_name=".x.Empty")
    entry = m.nested_type.add(name="ByEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, label=1, type=9)
    entry.field.add(name="value", number=2, label=1, type=11, type_name=".x.In")
    m.field.add(name="by", number=7, label=3, type=11, type_name=".x.M.ByEntry")
    fds = descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString()
    topic = pickle.loads(pickle.dumps(ProtobufDecoder().topic("x.M", fds)))
    cls = pb.message_class(pb.descriptor("x.M", fds))
    a, b, c = cls(), cls(kind=5, blob=b"z"), cls(kinds=[1, 9, 0])
    a.one.u = 2**64 - 1
    a.one.names.extend(["p", ""])
    a.none.SetInParent()
    for k in range(3):
        c.many.add(u=k, names=["n"] * k)
        c.by[f"k{k}"].u = k
    payloads = [x.SerializeToString() for x in (a, b, c)]
    want = [to_array([topic.decode(p)[x.name] for p in payloads], x, ir.arrow_type(x.element.type)) for x in topic.fields]
    got = topic.columns(payloads, topic.fields)
    norm = lambda x: sorted(x) if isinstance(x, list) and x and isinstance(x[0], tuple) else x
    for x, w, g in zip(topic.fields, want, got, strict=True):
        assert [norm(v) for v in g.to_pylist()] == [norm(v) for v in w.to_pylist()], x.name
    assert [len(x) for x in topic.columns([], topic.fields)] == [0] * 7
    with pytest.raises(MessageDecode):
        topic.columns([b"\xff"], topic.fields)


def color_file():
    f = descriptor_pb2.FileDescriptorProto(name="c.proto", package="c", syntax="proto3")
    e = f.enum_type.add(name="Color")
    for n, v in (("RED", 0), ("GREEN", 7)):
        e.value.add(name=n, number=v)
    m = f.message_type.add(name="M")
    m.field.add(name="color", number=1, label=1, type=14, type_name=".c.Color")
    m.field.add(name="maybe", number=2, label=1, type=5, proto3_optional=True, oneof_index=0)
    m.oneof_decl.add(name="_maybe")
    entry = m.nested_type.add(name="CountsEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, label=1, type=9)
    entry.field.add(name="value", number=2, label=1, type=5)
    m.field.add(name="counts", number=3, label=3, type=11, type_name=".c.M.CountsEntry")
    m.field.add(name="inner", number=4, label=1, type=11, type_name=".c.N")
    m.field.add(name="many", number=5, label=3, type=4)
    f.message_type.add(name="N").field.add(name="x", number=1, label=1, type=1)
    return descriptor_pb2.FileDescriptorSet(file=[f])


def test_protobuf_presence_enums_maps():
    fds = color_file()
    cls = models.proto_class(fds, "c.M")
    raw = fds.SerializeToString()
    assert decode_value("c.M", raw, b"") == {"color": "RED", "maybe": None, "counts": [], "inner": None, "many": []}
    assert decode_value("c.M", raw, b"", nulls=False) == {"color": "RED", "maybe": 0, "counts": [], "inner": {"x": 0.0}, "many": []}
    m = cls(color=9, maybe=0, counts={"a": 1}, many=[2**64 - 1])
    m.inner.x = 2.5
    assert decode_value("c.M", raw, m.SerializeToString()) == {"color": "9", "maybe": 0, "counts": [("a", 1)], "inner": {"x": 2.5}, "many": [2**64 - 1]}
    t = ProtobufDecoder().topic("c.M", raw)
    assert [(f.name, f.element.nullable) for f in t.fields] == [("color", False), ("maybe", True), ("counts", False), ("inner", True), ("many", False)]
    assert [f.element.nullable for f in ProtobufDecoder(nulls=False).topic("c.M", raw).fields] == [False] * 5
    assert pickle.loads(pickle.dumps(t)).decode(b"")["color"] == "RED"


def test_protobuf_errors():
    raw = color_file().SerializeToString()
    with pytest.raises(SchemaParse):
        ProtobufDecoder().topic("c.M", b"\xff\xff\xff")
    with pytest.raises(SchemaDerivation, match="message descriptor not found"):
        ProtobufDecoder().topic("c.Absent", raw)
    with pytest.raises(MessageDecode):
        decode_value("c.M", raw, b"\xff\xff")
    f = descriptor_pb2.FileDescriptorProto(name="r.proto", package="r", syntax="proto3")
    f.message_type.add(name="R").field.add(name="next", number=1, label=1, type=11, type_name=".r.R")
    with pytest.raises(SchemaDerivation, match="contains itself"):
        ProtobufDecoder().topic("r.R", descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString())


# --- registry and batches -------------------------------------------------------------------


def test_registry_replaces_and_misses():
    r = Registry.default()
    assert set(r.decoders) == {("protobuf", "protobuf"), ("ros2msg", "cdr"), ("ros2idl", "cdr")}
    mine = JsonDecoder((field("x", "I64"),))
    assert r.register(JsonDecoder(())).register(mine).find("jsonschema", "json") is mine
    with pytest.raises(NoDecoder, match="no decoder registered for schema_encoding='jsonschema', message_encoding='cbor'"):
        r.find("jsonschema", "cbor")


def test_batches():
    fields = (field("x", "I64", True), field("a", "Array", True, item=Element(Type("F32")), size=3))
    rows = [(i, i, {"x": i, "a": [1.0, 2.0, 3.0]}) for i in range(5)]
    assert [b.num_rows for b in batched(rows, fields, Metadata(), 2)] == [2, 2, 1]
    assert [b.num_rows for b in batched(rows, fields, Metadata(), 0)] == [1] * 5
    assert list(batched([], fields, Metadata())) == []
    assert record_batch([(1, 2, None)], fields, Metadata("@")).to_pylist() == [{"@log_time": 1, "@publish_time": 2, "x": None, "a": None}]
    with pytest.raises(EmptyRows):
        record_batch([], fields, Metadata())
    with pytest.raises(ValueTypeError, match=r"expected FixedSizeList\(length=3\), got Array\(length=2\)"):
        record_batch([(1, 1, {"x": 1, "a": [1.0, 2.0]})], fields, Metadata())
    with pytest.raises(ValueTypeError):
        record_batch([(1, 1, {"x": "one", "a": None})], fields, Metadata())
    with pytest.raises(ConvertError):
        record_batch([(2**63, 1, None)], fields, Metadata())
    with pytest.raises(MetadataColumnCollision, match=r"\[log_time, publish_time\] collide"):
        Metadata().spark((field("publish_time", "I8"), field("log_time", "I8")))


FIXED = hs.recursive(
    hs.sampled_from(["I8", "U8", "I16", "U16", "I32", "U32", "I64", "U64", "F32", "F64"]).map(Type),
    lambda inner: hs.lists(inner, min_size=1, max_size=4).map(lambda ts: struct(*[field(f"f{i}", t) for i, t in enumerate(ts)])),
    max_leaves=8,
)


@settings(max_examples=100, deadline=None)
@given(hs.lists(FIXED, min_size=1, max_size=4), hs.integers(0, 2**31))
def test_column_wise_equals_one_by_one(types, seed):
    import random

    rng = random.Random(seed)
    fields = tuple(field(f"x{i}", t) for i, t in enumerate(types))

    def value(t):
        if t.kind == "Struct":
            return {f.name: value(f.element.type) for f in t.fields}
        if t.kind[0] == "F":
            return float(rng.randrange(1000))
        bits = int(t.kind[1:])
        return rng.randrange(2**bits) if t.kind[0] == "U" else rng.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1))

    data = [(i, i, models.cdr(fields, {f.name: value(f.element.type) for f in fields})) for i in range(5)]
    d = CdrDecoder(fields, "p/M")
    assert d.columns([p for _, _, p in data], fields) is not None
    (got,) = payload_batches(data, d, fields, Metadata())
    assert got.equals(record_batch([(a, b, d.decode(p)) for a, b, p in data], fields, Metadata()))
    assert d.columns([data[0][2], data[0][2] + b"x"], fields) is None
