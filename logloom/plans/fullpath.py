"""Queries over the whole path: tables written to container files in each encoding, scanned back through the source.

The files are written once per folder and table by one Spark task per slice of the table, into
the session's checkpoint folder (or a folder of this machine where none is set).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import ir
from logloom.ir import Field, field, struct
from logloom.operators.flatten import FlattenPolicy, flatten
from logloom.operators.project import project
from logloom.session import scratch, shared_folder
from logloom.sinks.convert import ConvertOptions, shaped, write
from logloom.sources import mcap
from logloom.sources.scan import scan_topic

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM = (
    field("keys", struct(field("order", "I64"), field("part", "I64"), field("line", "I32"))),
    field("amounts", struct(field("quantity", "F64"), field("price", "F64"), field("discount", "F64"))),
    field("flag", "String"), field("status", "BoundedString", size=1),
)
EVENTS = (field("event_id", "U64"), field("user_id", "U32"), field("event_type", "String"), field("value", "F64", True), field("props", "Bytes"))
CUSTOMER = (field("custkey", "I64"), field("name", "String"), field("nation", "I32"), field("balance", "F64"), field("history", "List", item=ir.Element(ir.Type("F64"))))


def _events(r: dict) -> tuple[int, dict]:
    ns = int(r["ts"].timestamp() * 10**6) * 1000 if r["ts"] else 0
    return ns, {"event_id": r["event_id"], "user_id": r["user_id"], "event_type": r["event_type"], "value": r["value"], "props": r["props"].encode()}


def _lineitem(r: dict) -> tuple[int, dict]:
    amounts = {"quantity": r["l_quantity"], "price": r["l_extendedprice"], "discount": r["l_discount"]}
    return r["l_orderkey"] * 10 + r["l_linenumber"], {"keys": {"order": r["l_orderkey"], "part": r["l_partkey"], "line": r["l_linenumber"]}, "amounts": amounts, "flag": r["l_returnflag"], "status": r["l_linestatus"]}


def _customer(r: dict) -> tuple[int, dict]:
    return r["c_custkey"], {"custkey": r["c_custkey"], "name": r["c_name"], "nation": r["c_nationkey"], "balance": r["c_acctbal"], "history": [r["c_acctbal"] * k for k in range(r["c_custkey"] % 4)]}


_KIND = tuple((n, v) for v, n in enumerate(("SMALL", "MIDDLE", "LARGE")))
_MAKER = struct(field("brand", "String", True), field("price", "F64", True))
#: Protobuf's repeated, map, enum and unset fields; and CDR's enums, fixed arrays, bounded lists, lists of structs and empty structs.
PART = (
    field("partkey", "I64"), field("kind", "Enum", variants=_KIND), field("sizes", "List", item=ir.Element(ir.Type("I32"))), field("codes", "Map", key=ir.Element(ir.Type("String")), item=ir.Element(ir.Type("I64"))),
    field("maker", _MAKER, True), field("note", "String", True), field("steps", "List", item=ir.Element(struct(field("no", "I32"), field("name", "String")))),
)
PART_CDR = (
    field("flag", "Bool"), field("kind", "Enum", variants=_KIND), field("corner", "Array", item=ir.Element(ir.Type("F64")), size=3), field("nothing", struct()), field("partkey", "I64"),
    field("few", "BoundedList", item=ir.Element(ir.Type("I16")), size=5), field("steps", "List", item=ir.Element(struct(field("no", "I32"), field("name", "String")))), field("raw", "Bytes"),
)


def _part(r: dict) -> tuple[int, dict]:
    k = r["p_partkey"]
    n = k % 4
    out = {"partkey": k, "kind": _KIND[k % 3][0], "sizes": [r["p_size"] + i for i in range(n)], "codes": {f"c{i}": k * i for i in range(k % 3)}, "steps": [{"no": i, "name": r["p_brand"]} for i in range(k % 3)]}
    if k % 5:
        out["maker"] = {"brand": r["p_brand"]} if k % 2 else {"brand": r["p_brand"], "price": r["p_retailprice"]}
    if n == 1:
        out["note"] = r["p_name"]
    return k, out | {"flag": k % 2 == 1, "corner": [float(k), r["p_retailprice"], 0.5], "nothing": {}, "few": [i - 1 for i in range(n)], "raw": r["p_name"].encode()}


TABLES = {"events": (EVENTS, _events), "lineitem": (LINEITEM, _lineitem), "customer": (CUSTOMER, _customer), "part": (PART, _part)}
#: Fields of a table where an encoding has others.
OTHER = {("part", "ros2idl"): PART_CDR}


def _content(path: str) -> tuple[list, int]:
    """Files of a table with their sizes and times, and bytes in all."""
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names)
    seen = [(f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in files]
    return seen, sum(n for _, n, _ in seen)


def _folder(spark: SparkSession, sf: str, name: str, encoding: str) -> str:
    shared = (shared_folder(spark) or os.path.join(tempfile.gettempdir(), "logloom-files")).removeprefix("file://")
    if "://" in shared:
        raise ValueError(f"container files need a folder that all machines mount, not {shared}")
    what = f"{os.path.realpath(sf)}/{name}/{encoding}/{TABLES[name][0]}/{_content(os.path.realpath(f'{sf}/{name}.parquet'))[0]}"
    stamp = hashlib.sha1(what.encode()).hexdigest()[:12]
    return os.path.join(shared, "containers", f"{name}-{encoding}-{stamp}")


def written(spark: SparkSession, sf: str, name: str, encoding: str, compression: str = "zstd", topic_by: str | None = None, order: str | None = None) -> str:
    """Folder of container files of the table; written unless a finished one is there.

    ``topic_by`` gives each value of a column a topic of its own in every file; ``order`` writes one file in that order.
    """
    folder = _folder(spark, sf, name, encoding) + (f"-by-{topic_by}" if topic_by else "") + (f"-order-{order}" if order else "")
    if os.path.exists(f"{folder}/_SUCCESS"):
        return folder
    os.makedirs(folder, exist_ok=True)
    fields, convert = TABLES[name]
    fields = OTHER.get((name, encoding), fields)
    kept = {f.name for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from logloom.testkit import models
        from logloom.testkit.mcap_writer import McapWriter

        part = TaskContext.get().partitionId()
        path, rows = f"{folder}/part-{part:05d}.mcap", 0
        temp = f"{path}.{TaskContext.get().taskAttemptId()}"
        if encoding == "protobuf":
            fds = models.proto_file(fields, "tables", "Row")
            cls = models.proto_class(fds, "tables.Row")
            schema, full, message = fds.SerializeToString(), "tables.Row", "protobuf"

            def encode(v: dict) -> bytes:
                return _message(cls, v).SerializeToString()
        else:
            schema = (models.idl_text(fields, "tables", "Row") if encoding == "ros2idl" else models.msg_text(fields, "tables")).encode()
            full, message = "tables/msg/Row", "cdr"

            def encode(v: dict) -> bytes:
                return models.cdr(fields, v)

        with McapWriter(temp, compression, 256 << 10) as w:
            s = w.add_schema(full, encoding, schema)
            channels: dict[str, int] = {}
            for b in batches:
                for r in b.to_pylist():
                    at, v = convert(r)
                    v = {k: x for k, x in v.items() if k in kept}
                    topic = f"/{name}/{r[topic_by]}" if topic_by else f"/{name}"
                    if topic not in channels:
                        channels[topic] = w.add_channel(topic, message, s)
                    w.write(channels[topic], at, encode(v), sequence=rows)
                    rows += 1
        os.replace(temp, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows])], ["path", "rows"])

    df = spark.read.parquet(f"{sf}/{name}.parquet")
    df = df.orderBy(order).coalesce(1) if order else df.repartition(max(4, _content(os.path.realpath(f"{sf}/{name}.parquet"))[1] >> 26))
    df.mapInArrow(run, "path string, rows bigint").collect()
    open(f"{folder}/_SUCCESS", "w").close()
    return folder


def _message(cls, v: dict):
    m = cls()
    for k, x in v.items():
        d = cls.DESCRIPTOR.fields_by_name[k]
        if isinstance(x, dict) and d.message_type.GetOptions().map_entry:
            getattr(m, k).update(x)
        elif d.enum_type is not None:
            setattr(m, k, d.enum_type.values_by_name[x].number)
        elif isinstance(x, list) and d.message_type is not None:
            for e in x:
                getattr(m, k).add().CopyFrom(_message(d.message_type._concrete_class, e))
        elif isinstance(x, dict):
            getattr(m, k).CopyFrom(_message(type(getattr(m, k)), x))
        elif isinstance(x, list):
            getattr(m, k).extend(x)
        elif x is not None:
            setattr(m, k, x)
    return m


def _read(spark: SparkSession, sf: str, name: str, encoding: str, topic: str | None = None, topic_by: str | None = None, order: str | None = None, **options: object) -> DataFrame:
    mcap.register(spark)
    r = spark.read.format("mcap").option("topic", topic or f"/{name}")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(written(spark, sf, name, encoding, topic_by=topic_by, order=order))


def _flat_events(df: DataFrame) -> DataFrame:
    return df.select("log_time", F.col("event_id").cast("bigint").alias("event_id"), "user_id", "event_type", "value", F.decode("props", "UTF-8").alias("props"))


def scan_ros2msg(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_events(_read(spark, sf, "events", "ros2msg"))


def scan_ros2idl(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_events(_read(spark, sf, "events", "ros2idl"))


def scan_protobuf(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_events(_read(spark, sf, "events", "protobuf"))


def scan_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds on log time reach the chunk index."""
    df = _read(spark, sf, "lineitem", "ros2idl")
    flat, _ = flatten(df.where((F.col("log_time") >= 5000) & (F.col("log_time") < 90000)), FlattenPolicy(), "_")
    return flat.select("log_time", "keys_order", "keys_part", "keys_line", "amounts_quantity", "amounts_price", "amounts_discount", "flag", "status")


def scan_project_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Only one payload field is built, then projected and flattened."""
    df = _read(spark, sf, "lineitem", "ros2msg", fields="keys,amounts")
    return flatten(project(df, ["keys.order", "keys.line", "amounts.price"]), FlattenPolicy())[0]


def scan_many_files(spark: SparkSession, sf: str) -> DataFrame:
    """Planning and decoding as Spark jobs over a table of files."""
    folder = written(spark, sf, "customer", "ros2idl")
    files = spark.createDataFrame([(f"{folder}/{n}",) for n in sorted(os.listdir(folder)) if n.endswith(".mcap")], "path string")
    df = scan_topic(files, "/customer", CUSTOMER, unreadable="fail")
    return df.select("custkey", "name", "nation", "balance", F.size("history").alias("n_history"), F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("total"))


def scan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Message counts from statistics records alone."""
    mcap.register(spark)
    t = spark.read.format("mcap").option("mode", "topics").load(written(spark, sf, "lineitem", "protobuf"))
    return t.groupBy("topic", "schema_name", "message_encoding", "decodable").agg(F.sum("message_count").alias("message_count"))


def scan_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Payload bytes without a decoder: their length, and the fields that can be read at their positions."""
    df = _read(spark, sf, "customer", "ros2msg", mode="raw")
    number = lambda at, n: F.conv(F.regexp_replace(F.reverse(F.hex(F.substring("data", at, n))), "(.)(.)", "$2$1"), 16, 10).cast("bigint")
    named = df.withColumn("n", number(F.lit(13), F.lit(4)).cast("int"))
    return named.select(
        "log_time", "publish_time", F.octet_length("data").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("data", 1, 4))).alias("head"), number(F.lit(5), F.lit(8)).alias("custkey"),
        F.decode(F.substring(F.col("data"), F.lit(17), F.col("n") - 1), "UTF-8").alias("name"), number(F.expr("5 + (12 + n + 3) div 4 * 4"), F.lit(4)).alias("nation"),
    )


def scan_one_of_topics(spark: SparkSession, sf: str) -> DataFrame:
    """One topic of files that hold several."""
    return _flat_events(_read(spark, sf, "events", "ros2idl", topic="/events/click", topic_by="event_type"))


def scan_topics_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue of files with several topics."""
    mcap.register(spark)
    t = spark.read.format("mcap").option("mode", "topics").load(written(spark, sf, "events", "ros2idl", topic_by="event_type"))
    return t.groupBy("topic", "schema_name", "schema_encoding", "decodable").agg(F.sum("message_count").alias("message_count"))


def scan_protobuf_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Enums, repeated, map and unset fields of protobuf; of a map what it holds under one key."""
    df = _read(spark, sf, "part", "protobuf")
    return df.select(
        "partkey", "kind", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), F.size("codes").alias("n_codes"), F.try_element_at("codes", F.lit("c1")).alias("c1"),
        F.col("maker").isNull().alias("no_maker"), F.col("maker.brand").alias("brand"), F.col("maker.price").alias("price"), "note", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["no"].cast("string"), s["name"])), ",").alias("steps"),
    )


def scan_idl_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Enums, fixed arrays, bounded lists, lists of structs, empty structs and bytes of CDR."""
    df = _read(spark, sf, "part", "ros2idl")
    return df.select(
        "partkey", "flag", "kind", F.col("corner")[0].alias("corner_0"), F.col("corner")[1].alias("corner_1"), F.size("corner").alias("n_corner"), F.array_join(F.transform("few", lambda x: x.cast("string")), ",").alias("few"),
        F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["no"].cast("string"), s["name"])), ",").alias("steps"), F.decode("raw", "UTF-8").alias("raw"),
    )


def flatten_map(spark: SparkSession, sf: str) -> DataFrame:
    """Maps and lists dropped by policy, structs flattened; what was dropped is reported."""
    df = _read(spark, sf, "part", "protobuf").select("partkey", "maker", "codes", "sizes")
    flat, dropped = flatten(df, FlattenPolicy(lists="drop", maps="drop"))
    return flat.withColumn("dropped", F.lit(",".join(sorted(dropped))))


def scan_offset_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The source's own offset and limit, after its time range."""
    return _flat_events(_read(spark, sf, "events", "ros2msg", order="event_id", offset=37, limit=250, startTime=1704153600000000000))


def write_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A topic's messages flattened, written as CSV and read back."""
    folder = scratch(spark, "csv")
    write(shaped(_read(spark, sf, "lineitem", "ros2msg"), ConvertOptions("csv")), folder, ConvertOptions("csv"))
    return spark.read.option("header", True).schema("log_time bigint, publish_time bigint, `keys.order` bigint, `keys.part` bigint, `keys.line` int, `amounts.quantity` double, `amounts.price` double, `amounts.discount` double, flag string, status string").csv(folder).drop("publish_time")


def write_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """A topic's messages written as Parquet and read back, lists kept."""
    folder = scratch(spark, "parquet")
    write(shaped(_read(spark, sf, "customer", "ros2idl"), ConvertOptions("parquet")), folder, ConvertOptions("parquet"))
    t = spark.read.parquet(folder)
    return t.select("log_time", "custkey", "name", "nation", "balance", F.size("history").alias("n_history"))


def write_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """A topic's messages written as JSON Lines and read back."""
    folder = scratch(spark, "jsonl")
    write(shaped(_read(spark, sf, "events", "protobuf"), ConvertOptions("jsonl")), folder, ConvertOptions("jsonl"))
    t = spark.read.schema("log_time bigint, event_id bigint, user_id bigint, event_type string, value double, props string").json(folder)
    return t.withColumn("props", F.decode(F.unhex("props"), "UTF-8"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (scan_ros2msg, scan_ros2idl, scan_protobuf, scan_time_range, scan_project_flatten, scan_many_files, scan_catalog, scan_raw, scan_one_of_topics, scan_topics_of_files, scan_protobuf_nested, scan_idl_nested, flatten_map, scan_offset_limit, write_csv, write_parquet, write_jsonl)}

_EVENTS_SQL = "SELECT epoch_us(ts) * 1000 AS log_time, event_id, user_id, event_type, value, props FROM events"
SQL: dict[str, str] = {
    "scan_ros2msg": _EVENTS_SQL,
    "scan_ros2idl": _EVENTS_SQL,
    "scan_protobuf": _EVENTS_SQL,
    "scan_time_range": """SELECT l_orderkey * 10 + l_linenumber AS log_time, l_orderkey AS keys_order, l_partkey AS keys_part, l_linenumber AS keys_line, l_quantity AS amounts_quantity,
l_extendedprice AS amounts_price, l_discount AS amounts_discount, l_returnflag AS flag, l_linestatus AS status FROM lineitem WHERE l_orderkey * 10 + l_linenumber >= 5000 AND l_orderkey * 10 + l_linenumber < 90000""",
    "scan_project_flatten": 'SELECT l_orderkey AS "keys.order", l_linenumber AS "keys.line", l_extendedprice AS "amounts.price" FROM lineitem',
    "scan_many_files": "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, (c_custkey % 4)::INTEGER AS n_history, c_acctbal * (CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END) AS total FROM customer",
    "scan_catalog": "SELECT '/lineitem' AS topic, 'tables.Row' AS schema_name, 'protobuf' AS message_encoding, true AS decodable, count(*) AS message_count FROM lineitem",
    # 4 bytes of header; key, length and text of the name with its end, nation, balance, number and values of the history, each aligned to its size.
    "scan_raw": """WITH a AS (SELECT *, strlen(c_name) + 1 AS n, c_custkey % 4 AS k FROM customer), b AS (SELECT *, (12 + n + 3) // 4 * 4 + 4 AS e FROM a)
SELECT c_custkey AS log_time, c_custkey AS publish_time, (4 + (e + 7) // 8 * 8 + 8 + CASE WHEN k = 0 THEN 4 ELSE 8 + 8 * k END)::BIGINT AS n_bytes, '00010000' AS head, c_custkey AS custkey, c_name AS name, c_nationkey::BIGINT AS nation FROM b""",
    "scan_one_of_topics": f"{_EVENTS_SQL} WHERE event_type = 'click'",
    "scan_topics_of_files": "SELECT '/events/' || event_type AS topic, 'tables/msg/Row' AS schema_name, 'ros2idl' AS schema_encoding, true AS decodable, count(*) AS message_count FROM events GROUP BY 1",
    "scan_protobuf_nested": """SELECT p_partkey AS partkey, ['SMALL', 'MIDDLE', 'LARGE'][p_partkey % 3 + 1] AS kind, array_to_string(list_transform(range(p_partkey % 4), lambda i: p_size + i), ',') AS sizes,
(p_partkey % 3)::INTEGER AS n_codes, CASE WHEN p_partkey % 3 = 2 THEN p_partkey END AS c1, p_partkey % 5 = 0 AS no_maker, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand,
CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 4 = 1 THEN p_name END AS note,
array_to_string(list_transform(range(p_partkey % 3), lambda i: i || ':' || p_brand), ',') AS steps FROM part""",
    "scan_idl_nested": """SELECT p_partkey AS partkey, p_partkey % 2 = 1 AS flag, ['SMALL', 'MIDDLE', 'LARGE'][p_partkey % 3 + 1] AS kind, p_partkey::DOUBLE AS corner_0, p_retailprice AS corner_1, 3 AS n_corner,
array_to_string(list_transform(range(p_partkey % 4), lambda i: i - 1), ',') AS few, array_to_string(list_transform(range(p_partkey % 3), lambda i: i || ':' || p_brand), ',') AS steps, p_name AS raw FROM part""",
    "flatten_map": """SELECT p_partkey AS partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS "maker.brand", CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN p_retailprice END AS "maker.price", 'codes,sizes' AS dropped FROM part""",
    "scan_offset_limit": f"{_EVENTS_SQL} WHERE epoch_us(ts) >= 1704153600000000 ORDER BY event_id LIMIT 250 OFFSET 37",
    "write_csv": """SELECT l_orderkey * 10 + l_linenumber AS log_time, l_orderkey AS "keys.order", l_partkey AS "keys.part", l_linenumber AS "keys.line", l_quantity AS "amounts.quantity",
l_extendedprice AS "amounts.price", l_discount AS "amounts.discount", l_returnflag AS flag, l_linestatus AS status FROM lineitem""",
    "write_parquet": "SELECT c_custkey AS log_time, c_custkey AS custkey, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, (c_custkey % 4)::INTEGER AS n_history FROM customer",
    "write_jsonl": _EVENTS_SQL,
}
