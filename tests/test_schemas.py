import pytest

from logloom import ir
from logloom.errors import SchemaDerivation, SchemaParse
from logloom.decode.base import Ros2IdlDecoder, Ros2MsgDecoder
from logloom.ir import Element, Type, field, struct
from logloom.schema import names, ros2idl, ros2msg
from logloom.schema.names import SchemaText


# --- text form ---------------------------------------------------------------


def test_schema_text_of_nested_types():
    fields = (
        field("root", Type("Struct", fields=(field("a", "F64", True), field("l", "List", True, item=Element(struct(field("x", "I32", True)), True)))), True),
        field("samples", "Array", item=Element(Type("F64")), size=9),
        field("few", "BoundedList", item=Element(Type("I16")), size=4),
        field("labels", "Map", key=Element(Type("String")), item=Element(Type("I32"), True)),
        field("color", "Enum", variants=(("UNKNOWN", 0), ("BLUE", 7))),
        field("index", "Map", key=Element(struct(field("id", "U32"))), item=Element(struct(field("on", "Bool")))),
        field("s", "BoundedString", size=8), field("b", "BoundedBytes", True, size=3),
    )
    assert ir.schema_text(fields) == (
        "root: optional struct\n    a: optional f64\n    l: optional struct?[]\n        x: optional i32\n"
        "samples: f64[9]\nfew: i16[<=4]\nlabels: map<string, i32?>\ncolor: enum\n    UNKNOWN = 0\n    BLUE = 7\n"
        "index: map<struct, struct>\n    @key: struct\n        id: u32\n    @value: struct\n        on: bool\n"
        "s: string[<=8]\nb: optional bytes[<=3]\n"
    )


def test_json_form_round_trip():
    fields = (field("a", "List", True, item=Element(struct(field("e", "Enum", variants=(("X", 1),)), field("m", "Map", key=Element(Type("String")), item=Element(Type("U64"), True))))), field("r", "Array", item=Element(Type("U8")), size=2))
    assert ir.from_json(ir.to_json(fields)) == fields
    assert ir.from_json([{"name": "a", "element": "F64"}]) == (field("a", "F64"),)


def test_spark_types_widen_unsigned_and_keep_lengths():
    got = ir.spark_schema((field("a", "U8"), field("b", "U16"), field("c", "U32"), field("d", "U64"), field("e", "Array", item=Element(Type("U32")), size=3), field("f", "Enum", variants=(("A", 1),)), field("g", "BoundedString", True, size=4)))
    assert got.simpleString() == "struct<a:smallint,b:int,c:bigint,d:decimal(20,0),e:array<bigint>,f:string,g:string>"
    assert got["e"].metadata == {"fixed_len": 3, "item_kind": "U32"} and got["g"].metadata == {"bound": 4} and got["g"].nullable and not got["a"].nullable


# --- names and bundles ----------------------------------------------------------


@pytest.mark.parametrize("name,want", [("a/B", "a/msg/B"), ("a/srv/B", "a/srv/B")])
def test_normalized(name, want):
    assert names.normalized(name) == want


@pytest.mark.parametrize("name", ["B", "a/", "/B", "a//B", "a/b/c/d", ""])
def test_names_rejected(name):
    with pytest.raises(SchemaText, match="invalid schema name format"):
        names.normalized(name)


def test_sections():
    assert names.sections("a\n===\n\n  ====  \nb\n==\nc") == [["a"], ["b", "==", "c"]]


# --- msg ----------------------------------------------------------------------------


def test_msg_bundle_with_relative_and_absolute_types():
    got = ros2msg.fields("geometry_msgs/msg/PoseStamped", "std_msgs/Header header\nPose pose\n===\nMSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n===\nMSG: geometry_msgs/Pose\nPoint position\n===\nMSG: geometry_msgs/Point\nfloat64 x 1.0\nfloat64 y\n")
    assert ir.schema_text(got) == "header: struct\n    stamp: struct\n        sec: i32\n        nanosec: u32\n    frame_id: string\npose: struct\n    position: struct\n        x: f64\n        y: f64\n"


def test_msg_arrays_bounds_constants_comments():
    text = "# head\nint32[3] a\nfloat32[] b\nint8[<=4] c\nstring<=5 d\nstring<=5[] e\nbyte f\nchar g\nuint8[] h\nuint8[2] i\nint32 K=5\nstring S=a#b\nwstring w # tail\nstring t \"x # y\"\n"
    got = ir.schema_text(ros2msg.fields("p/M", text))
    assert got == "a: i32[3]\nb: f32[]\nc: i8[<=4]\nd: string[<=5]\ne: string[<=5][]\nf: u8\ng: u8\nh: bytes\ni: u8[2]\nw: wstring\nt: string\n"
    assert ros2msg.parse("p/M", text)[2] == [("K", "5"), ("S", "a#b")]


@pytest.mark.parametrize("text,message", [("int32[2][3] a", "nested fixed arrays"), ("Other K=3", "constants must be primitive"), ("int32[2] K=3", "constants cannot be arrays"), ("Unknown x", "unresolved type"), ("int32", "failed to parse"), ("int32 a\n===\nint32 b", "missing `MSG:` header")])
def test_msg_rejected(text, message):
    with pytest.raises(SchemaText, match=message):
        ros2msg.fields("p/M", text)


def test_schema_bytes_must_be_text():
    with pytest.raises(SchemaParse):
        Ros2MsgDecoder().topic("p/M", b"\xff\xfe")
    with pytest.raises(SchemaDerivation, match="unresolved"):
        Ros2MsgDecoder().topic("p/M", b"X y")


def test_recursive_types_are_refused():
    with pytest.raises(SchemaDerivation, match="contains itself"):
        ros2msg.fields("p/M", "M[] children")


# --- idl ------------------------------------------------------------------------------


def idl(body, name="ex/msg/M"):
    return f"===\nIDL: {name}\nmodule ex {{ module msg {{\n{body}\n}}; }};\n"


def text(body):
    return ir.schema_text(ros2idl.fields("ex/msg/M", idl(body)))


def test_idl_types():
    got = text("""struct M { short a; unsigned short b; long c; unsigned long d; long long e; unsigned long long f; float g; double h; boolean i; octet j;
      string k; string<4> l; wstring<3> m; sequence<long> n; sequence<sequence<long, 2>> o; sequence<uint8> p; octet q[2]; sequence<long, N> r; string<N> s; int8 t[0x10]; };""")
    assert got == "a: i16\nb: u16\nc: i32\nd: u32\ne: i64\nf: u64\ng: f32\nh: f64\ni: bool\nj: u8\nk: string\nl: string[<=4]\nm: wstring[<=3]\nn: i32[]\no: i32[<=2][]\np: bytes\nq: u8[2]\nr: i32[]\ns: string\nt: i8[16]\n"


def test_idl_enums_constants_annotations():
    got = text("#include <a/b.idl>\n#include \"c.idl\"\nenum C { @value(7) RED, @default_literal GREEN, @value(value=0x20) BLUE, @value(-1) NONE };\n/* two\nlines */ const long A = (1 + 2) << 3;\n@verbatim(text=\"a(b\") struct M { const short K = 8 >> 1; @key C c; // x\n };")
    assert got == "c: enum\n    RED = 7\n    GREEN = 8\n    BLUE = 32\n    NONE = -1\n"


def test_idl_scopes_and_injected_time():
    body = "module inner { struct P { double x; }; }; struct Q { inner::P p; }; struct M { ::ex::msg::Q q; inner::P p; builtin_interfaces::msg::Duration d; };"
    assert text(body) == "q: struct\n    p: struct\n        x: f64\np: struct\n    x: f64\nd: struct\n    sec: i32\n    nanosec: u32\n"


def test_idl_main_section_falls_back_to_the_first():
    two = idl("struct A { long a; };", "ex/msg/A") + idl("struct B { long b; };", "ex/msg/B")
    assert [f.name for f in ros2idl.fields("ex/msg/B", two)] == ["b"]
    assert [f.name for f in ros2idl.fields("ex/msg/Other", two)] == ["a"]


@pytest.mark.parametrize(
    "body,message",
    [
        ("union U { long a; };", "unsupported IDL declaration"), ("typedef long T;", "unsupported IDL declaration"), ("struct M;", "forward declaration"),
        ("struct M { long a, b; };", "multiple field declarators"), ("struct M { long a[2][3]; };", "multi-dimensional"),
        ("struct M { long a[0]; };", "positive integer"), ("struct M { long double a; };", "unsupported IDL type `long double`"), ("struct M { unsigned a; };", "starting with `unsigned`"),
        ("struct M { char a; };", "unresolved type"), ("struct M { long a };", "must end with `;`"), ("enum E { };", "must contain an enumerator"), ("enum E { A, };", "trailing `,`"),
        ("enum E { A B };", "unexpected trailing characters"), ("enum E { A = 1 };", "unexpected trailing characters"), ("enum E { @value(4294967296) A };", "32-bit"),
        ("enum E { @value(4294967295) A, B };", "32-bit"), ("struct M { long é; };", "non-ASCII"), ("/* open", "unclosed block comment"), ("#include <a", "unclosed #include path"),
        ("const long A = (1;", "unclosed"), ("long x;", "unexpected top-level"),
    ],
)
def test_idl_rejected(body, message):
    with pytest.raises(SchemaText, match=message.replace("(", r"\(")):
        ros2idl.fields("ex/msg/M", idl(body))


def test_idl_headers_and_lines():
    with pytest.raises(SchemaText, match="missing `IDL:` header"):
        ros2idl.fields("ex/msg/M", "struct M { long a; };")
    with pytest.raises(SchemaText, match="line 3"):
        ros2idl.Parser("struct M {\n  long a;\n  long b\n};").parse()
    with pytest.raises(SchemaText, match="unclosed struct declaration at line 1"):
        ros2idl.Parser("struct M { long a;").parse()
    with pytest.raises(SchemaDerivation, match="root type"):
        Ros2IdlDecoder().topic("ex/msg/M", idl("struct Z { long a; };").encode())
