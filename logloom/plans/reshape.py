"""Queries of the log operators on the relational test tables: nest, apply the operator, compare with flat SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import ir
from logloom.decode.base import JsonDecoder
from logloom.functions import columns as fn
from logloom.operators.flatten import FlattenPolicy, flatten
from logloom.operators.project import project
from logloom.sinks.convert import POLICIES
from logloom.sinks.jsonl import JsonOptions, json_lines, with_rfc3339

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with nested struct columns, some of them null."""
    place = F.struct(F.col("s_nationkey").alias("nation"), F.struct(F.col("s_acctbal").alias("balance"), F.length("s_name").alias("width")).alias("account"))
    return table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, place).alias("place"), F.col("s_name").alias("name"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their lines as a list of structs in line order."""
    item = F.struct("l_linenumber", F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")).alias("amount"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("embedding", metadata={ir.FIXED_LEN: 64}))


def time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open range of log time."""
    t = table(spark, sf, "raw_messages").select("msg_id", "topic", "log_time")
    return t.where((F.col("log_time") >= 1715000000000000000) & (F.col("log_time") < 1722000000000000000)).distinct()


def offset_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Time filter, then offset, then limit, in a fixed order."""
    t = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    return t.orderBy("event_id").offset(37).limit(250).select("event_id", "user_id", "event_type")


def topic_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Topics over all files: stored messages, channels, files; sorted by topic."""
    t = table(spark, sf, "raw_messages").select("file_id", "topic", "channel_id", "msg_id").distinct()
    per = t.groupBy("topic", "file_id", "channel_id").agg(F.count("msg_id").alias("n"))
    return per.groupBy("topic").agg(F.sum("n").alias("message_count"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("file_id", "channel_id").alias("n_channels"))


def project_nested(spark: SparkSession, sf: str) -> DataFrame:
    p = project(_suppliers(spark, sf), ["place.account.balance", "s_suppkey"])
    return p.select("s_suppkey", F.col("place.account.balance").alias("balance"), F.col("place").isNull().alias("no_place"))


def project_list_of_struct(spark: SparkSession, sf: str) -> DataFrame:
    p = project(_orders(spark, sf), ["o_orderkey", "lines.amount.price", "lines.flag"])
    return p.select("o_orderkey", F.size("lines").alias("n_lines"), F.transform("lines", lambda e: e["amount"]["price"])[0].alias("first_price"), F.array_join(F.transform("lines", lambda e: e["flag"]), "").alias("flags"))


def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(_suppliers(spark, sf), FlattenPolicy())[0]


def flatten_fixed_array(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(_vectors(spark, sf), FlattenPolicy(arrays="flatten"))[0]


def flatten_list_of_struct(spark: SparkSession, sf: str) -> DataFrame:
    """Three columns groups per list, shorter lists padded, longer ones cut."""
    return flatten(_orders(spark, sf).select("o_orderkey", "lines"), FlattenPolicy(lists="flatten-fixed", list_size=3))[0]


def csv_policy(spark: SparkSession, sf: str) -> DataFrame:
    """What the CSV policy leaves: lists dropped, structs flattened."""
    df = _orders(spark, sf).withColumn("order", F.struct("o_orderstatus", F.struct("o_totalprice").alias("price"))).drop("o_orderstatus", "o_totalprice")
    return flatten(df, POLICIES["csv"])[0]


def jsonl_standard(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the standard form: nulls left out, NaN as null."""
    df = table(spark, sf, "signal_limits").select("topic", F.when(F.col("unit") != "V", F.col("unit")).alias("unit"), F.when(F.col("unit") == "V", F.lit(float("nan"))).otherwise(F.col("min_possible")).alias("low"), F.encode("unit", "UTF-8").alias("code"))
    return json_lines(df)


def jsonl_extended(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with explicit nulls, 64-bit integers as text, over nested records."""
    df = table(spark, sf, "scene_messages").select("msg_id", "topic", "value")
    return json_lines(df, JsonOptions("string", "string", True))


def metadata_unix_ns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", fn.unix_ns(F.col("ts")).alias("log_time"))


def format_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lidar_sweeps").select("sweep_id", "log_time").where(F.col("log_time").isNotNull()).distinct()
    return t.select("sweep_id", fn.format_timestamp(F.col("log_time")).alias("shown"))


def rfc3339_times(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "camera_frames").select("frame_id", "log_time").where(F.col("log_time").isNotNull()).distinct()
    return with_rfc3339(t, ["log_time"])


def bytes_hex(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "raw_messages").select("msg_id", fn.hex_bytes(F.col("data")).alias("shown"))
    return t.where(F.col("shown").isNotNull()).distinct()


def decode_json_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Payload bytes through a plug-in decoder, as a column."""
    decoder = JsonDecoder((ir.field("k", "I64", True),)).topic("props", b"")
    t = table(spark, sf, "events").select("event_id", fn.decode_payload(F.encode("props", "UTF-8"), decoder).alias("p"))
    return t.select("event_id", F.col("p.k").alias("k"))


def derived_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Spark type of every catalogued schema, and its number of fields."""
    t = table(spark, sf, "topic_schemas").select("schema_id", "field_defs").distinct()

    @F.pandas_udf(T.StringType())
    def kind(defs):
        import json

        return defs.map(lambda d: ir.spark_schema(ir.from_json(json.loads(d))).simpleString())

    return t.select("schema_id", kind("field_defs").alias("spark_type"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (time_range, offset_limit, topic_catalog, project_nested, project_list_of_struct, flatten_struct, flatten_fixed_array, flatten_list_of_struct, csv_policy, jsonl_standard, jsonl_extended, metadata_unix_ns, format_timestamp, rfc3339_times, bytes_hex, decode_json_payload, derived_schemas)
}

_LINES = """
WITH lines AS (SELECT l_orderkey, list({'n': l_linenumber, 'q': l_quantity, 'p': l_extendedprice, 'f': l_returnflag}
  ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag) AS l FROM lineitem GROUP BY 1)"""

SQL: dict[str, str] = {
    "time_range": "SELECT DISTINCT msg_id, topic, log_time FROM raw_messages WHERE log_time >= 1715000000000000000 AND log_time < 1722000000000000000",
    "offset_limit": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' ORDER BY event_id LIMIT 250 OFFSET 37",
    "topic_catalog": """SELECT topic, count(*) AS message_count, count(DISTINCT file_id) AS n_files, count(DISTINCT (file_id, channel_id)) AS n_channels
FROM (SELECT DISTINCT file_id, topic, channel_id, msg_id FROM raw_messages) GROUP BY topic""",
    "project_nested": "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance, s_acctbal <= 0 AS no_place FROM supplier",
    "project_list_of_struct": f"""{_LINES}
SELECT o_orderkey, len(l) AS n_lines, l[1].p AS first_price, array_to_string(list_transform(l, lambda e: e.f), '') AS flags
FROM orders JOIN lines ON o_orderkey = l_orderkey""",
    "flatten_struct": """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS "place.nation", CASE WHEN s_acctbal > 0 THEN s_acctbal END AS "place.account.balance",
CASE WHEN s_acctbal > 0 THEN length(s_name) END AS "place.account.width", s_name AS name FROM supplier""",
    "flatten_fixed_array": "SELECT vec_id, " + ", ".join(f'embedding[{i + 1}] AS "embedding.{i}"' for i in range(64)) + " FROM embeddings",
    "flatten_list_of_struct": f"{_LINES} SELECT o_orderkey, "
    + ", ".join(f'l[{i + 1}].n AS "lines.{i}.l_linenumber", l[{i + 1}].q AS "lines.{i}.amount.quantity", l[{i + 1}].p AS "lines.{i}.amount.price", l[{i + 1}].f AS "lines.{i}.flag"' for i in range(3))
    + " FROM orders JOIN lines ON o_orderkey = l_orderkey",
    "csv_policy": """SELECT o_orderkey, o_orderstatus AS "order.o_orderstatus", o_totalprice AS "order.price.o_totalprice"
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "jsonl_standard": """SELECT '{"topic":"' || topic || '"' || CASE WHEN unit <> 'V' THEN ',"unit":"' || unit || '"' ELSE '' END
|| ',"low":' || CASE WHEN unit = 'V' THEN 'null' ELSE min_possible::VARCHAR END || ',"code":"' || lower(hex(encode(unit))) || '"}' AS value FROM signal_limits""",
    "metadata_unix_ns": "SELECT event_id, epoch_us(ts) * 1000 AS log_time FROM events",
    "format_timestamp": "SELECT DISTINCT sweep_id, strftime(make_timestamp(log_time // 1000), '%Y-%m-%d %H:%M:%S.%g') AS shown FROM lidar_sweeps WHERE log_time IS NOT NULL",
    "rfc3339_times": "SELECT DISTINCT frame_id, strftime(make_timestamp(log_time // 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((log_time % 1000000000)::VARCHAR, 9, '0') || 'Z' AS log_time FROM camera_frames WHERE log_time IS NOT NULL",
    "bytes_hex": "SELECT DISTINCT msg_id, lower(hex(data)) AS shown FROM raw_messages WHERE data IS NOT NULL",
    "decode_json_payload": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
}
