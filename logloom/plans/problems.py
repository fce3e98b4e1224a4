"""Queries of the general data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import anomalies, dewey, eager, lateness, lifespan, readings, ssa_grid, unify
from logloom.session import scratch
from logloom.streaming import lateness as stream

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    scene = dewey.labels(table(spark, sf, "scene_messages"), "msg_id", "value", structs_only=True)
    defs = table(spark, sf, "topic_schemas").select("schema_id", "field_defs").distinct()
    fields = dewey.explode_fields(defs, "field_defs", ["schema_id"])
    return scene.select(F.lit("scene").alias("src"), "rec_id", "node", "parent").unionByName(fields.select(F.lit("schema").alias("src"), F.col("schema_id").alias("rec_id"), "node", "parent"))


def p1_object_table(spark: SparkSession, sf: str) -> DataFrame:
    t = dewey.shred(table(spark, sf, "scene_messages"), "msg_id", "value")["objects"]
    return t.select(F.col("_key").alias("msg_id"), F.col("_pos").alias("pos"), "id", "label", "score", F.col("pose__position__x").alias("x"), F.col("pose__position__y").alias("y"), F.col("pose__position__z").alias("z"), F.col("pose__yaw").alias("yaw"))


def p1_field_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every field definition as a flat row with its parent, type and position."""
    defs = table(spark, sf, "topic_schemas").select("schema_id", "field_defs").distinct()
    return dewey.explode_fields(defs, "field_defs", ["schema_id"]).select("schema_id", "node", "parent", "name", "pos", "type", "nullable")


def p1_part_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of unhealthy parts with the label of the object they belong to: three levels joined by their links."""
    t = dewey.shred(table(spark, sf, "scene_messages"), "msg_id", "value")
    codes = t["objects.parts.health.codes"].select(F.col("_key").alias("msg_id"), F.col("_parent").alias("part"), F.col("_pos").alias("code_pos"), F.col("item").alias("code"))
    parts = t["objects.parts"].select(F.col("_key").alias("msg_id"), F.col("_node").alias("part"), F.col("_parent").alias("object"), F.col("name").alias("part_name"))
    objects = t["objects"].select(F.col("_key").alias("msg_id"), F.col("_node").alias("object"), "label")
    return codes.join(parts, ["msg_id", "part"]).join(objects, ["msg_id", "object"]).select("msg_id", F.element_at("object", 2).alias("object_pos"), "label", "part_name", "code_pos", "code")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return lifespan.changes(table(spark, sf, "mcap_files"), table(spark, sf, "topic_schemas")).select("file_id", "topic", "field_path", "change")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every change with the names and types before and after."""
    return lifespan.changes(table(spark, sf, "mcap_files"), table(spark, sf, "topic_schemas"))


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All sensor messages of all files in one table: the columns under their last names, cast to common types."""
    cols = unify.columns(table(spark, sf, "mcap_files"), table(spark, sf, "topic_schemas"))
    return unify.unified(table(spark, sf, "decoded_messages"), cols)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return eager.count_audit(table(spark, sf, "topics"), table(spark, sf, "raw_messages")).where("gap <> 0").select("file_id", "topic").distinct()


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The true number of messages per file and topic beside the catalogue's."""
    return eager.count_audit(table(spark, sf, "topics"), table(spark, sf, "raw_messages"))


def p3_topic_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per site and topic: messages and bytes stored, by joining raw messages to their files with both sides pre-aggregated."""
    files = table(spark, sf, "mcap_files").select("file_id", F.coalesce(F.lower(F.trim("site")), F.lit("unknown")).alias("site")).distinct()
    raw = table(spark, sf, "raw_messages").select("file_id", "topic", F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint").alias("size"))
    # The messages are the left side: they group by topic; the file's site rolls up afterwards.
    per_file = eager.state(raw, ["file_id", "topic"], {"n_bytes": F.col("size")}, "n_rows")
    return per_file.join(files, "file_id").groupBy("site", "topic").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


def p3_weighted_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Per topic, over raw messages joined with all messages of the same file's catalogue rows: counts and sums of both sides."""
    raw = table(spark, sf, "raw_messages").select("file_id", "topic", F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint").alias("size"))
    cat = table(spark, sf, "topics").select("file_id", F.coalesce("message_count", F.lit(0)).alias("message_count"))
    return eager.joined_rollup(raw, cat, ["file_id"], ["topic"], {"sum_size": F.col("size")}, {"sum_stated": F.col("message_count")})


def p4_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flagged reading with its reasons."""
    f = anomalies.flag(readings.with_reading(table(spark, sf, "decoded_messages")), table(spark, sf, "signal_limits"))
    return f.where("is_range or is_stuck or is_spike").select("msg_id", "file_id", "topic", "log_time", "reading", "is_range", "is_stuck", "is_spike")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_flags(spark, sf).select("msg_id")


def p4_range(spark: SparkSession, sf: str) -> DataFrame:
    """Readings outside the physical limits of their topic."""
    return p4_flags(spark, sf).where("is_range").select("msg_id", "reading")


def p4_stuck(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of stretches of ten or more equal ones."""
    return p4_flags(spark, sf).where("is_stuck").select("msg_id", "reading")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return lateness.classify(table(spark, sf, "raw_messages"), ["file_id", "topic"])


SOURCE = ["file_id", "topic"]


def _streamed(spark: SparkSession, sf: str) -> str:
    return stream.replayed(table(spark, sf, "raw_messages"), SOURCE, scratch(spark, "lateness"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Messages beyond the cut-off, from the finished table."""
    return _classified(spark, sf).where("status = 'dropped'").select("msg_id")


def p5_stream_found(spark: SparkSession, sf: str) -> DataFrame:
    """The same messages, diverted by the stream's keyed state."""
    return stream.apart(spark, _streamed(spark, sf), SOURCE).where("kind = 'dropped'").select("msg_id")


def p5_stream_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Per topic and minute what the stream's upserts have arrived at, and how many messages were diverted."""
    folder = _streamed(spark, sf)
    key = ["topic", "window_start"]
    kept = stream.current(spark, folder, SOURCE).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n_first", "n_messages", "n_bytes", "n_late")])
    beyond = stream.apart(spark, folder, SOURCE).where("kind = 'dropped'").groupBy(*key).agg(F.count(F.lit(1)).alias("n_beyond"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return kept.join(beyond, key, "full").select(*key, *[zero(c) for c in ("n_first", "n_messages", "n_bytes", "n_late", "n_beyond")])


def p5_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return lateness.windows(_classified(spark, sf), ["topic"])


def p7_grid(spark: SparkSession, sf: str) -> DataFrame:
    return ssa_grid.regular_grid(readings.with_reading(table(spark, sf, "decoded_messages")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_grid(spark, sf).where("filled").select("file_id", "topic", "slot")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_object_table, p1_part_codes, p1_field_table, p2_found, p2_report, p2_unified, p3_found, p3_counts, p3_topic_totals, p3_weighted_bytes, p4_found, p4_flags, p4_range, p4_stuck, p5_found, p5_stream_found, p5_stream_minutes, p5_minutes, p7_found, p7_grid)}

_RAW_FIRST = """
first AS (
  SELECT file_id, topic, msg_id, log_time, publish_time, coalesce(octet_length(data), 0) AS n_bytes
  FROM raw_messages
  QUALIFY row_number() OVER (PARTITION BY file_id, topic, msg_id ORDER BY log_time, publish_time) = 1),
usable AS (SELECT * FROM first WHERE publish_time IS NOT NULL AND publish_time <> 0 AND publish_time <= log_time + 5000000000),
run AS (SELECT *, greatest(coalesce(max(publish_time) OVER (PARTITION BY file_id, topic ORDER BY log_time, msg_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), publish_time) - publish_time, 0) AS behind FROM usable)"""

_READ = r"""
read AS (
  SELECT DISTINCT file_id, topic, msg_id, log_time,
    try_cast(nullif(regexp_extract(value, '"(?:reading|value|measurement|level)"\s*:\s*"?\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*[",}\]\s]', 1), '') AS DOUBLE) AS reading
  FROM decoded_messages),
ok AS (SELECT * FROM read WHERE reading IS NOT NULL)"""

# Every field of every definition, and its type as text: kinds around the item grow on the left, bounds and lengths on the right.
_FIELDS = """
defs AS (SELECT schema_id, any_value(field_defs)::JSON AS d FROM topic_schemas GROUP BY schema_id),
walk AS (
  SELECT schema_id, '' AS prefix, '' AS parent, '' AS path, '' AS name, 0 AS pos, NULL::JSON AS element, d AS fields, NULL::JSON AS el FROM defs
  UNION ALL
  SELECT schema_id,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name')
         ELSE prefix || CASE WHEN json_extract_string(el, '$.data_type') = 'Map' THEN '{}' ELSE '[]' END END
      || CASE WHEN json_exists(CASE WHEN el IS NULL THEN x ELSE el END, CASE WHEN el IS NULL THEN '$.element.fields' ELSE '$.item.fields' END) THEN '.' ELSE '' END,
    CASE WHEN el IS NULL THEN path ELSE parent END,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name') ELSE path END,
    CASE WHEN el IS NULL THEN json_extract_string(x, '$.name') ELSE name END,
    CASE WHEN el IS NULL THEN i ELSE -1 END,
    json_extract(x, '$.element'),
    CASE WHEN el IS NULL THEN json_extract(x, '$.element.fields') ELSE json_extract(el, '$.item.fields') END,
    CASE WHEN el IS NULL THEN CASE WHEN json_exists(x, '$.element.item') THEN json_extract(x, '$.element') END
         ELSE CASE WHEN json_exists(el, '$.item.item') THEN json_extract(el, '$.item') END END
  FROM (SELECT *, unnest(CASE WHEN el IS NULL THEN from_json(fields, '["JSON"]') ELSE ['0'::JSON] END) AS x,
               unnest(range(CASE WHEN el IS NULL THEN json_array_length(fields)::BIGINT ELSE 1 END)) AS i FROM walk WHERE fields IS NOT NULL OR el IS NOT NULL)),
types AS (
  SELECT schema_id, path, element AS e, '' AS before, '' AS after, false AS done FROM walk WHERE pos >= 0 AND path <> ''
  UNION ALL
  SELECT schema_id, path, json_extract(e, '$.item'),
    before || coalesce(json_extract_string(e, '$.data_type'), json_extract_string(e, '$'))
      || CASE WHEN json_exists(e, '$.item') THEN '<' || coalesce(json_extract_string(e, '$.key.data_type') || coalesce('<max=' || json_extract_string(e, '$.key.max') || '>', ''), json_extract_string(e, '$.key'), '')
                || CASE WHEN json_exists(e, '$.key') THEN ',' ELSE '' END
              WHEN json_exists(e, '$.variants') THEN '<' || array_to_string(list_sort(list_transform(from_json(json_extract(e, '$.variants'), '["JSON"]'), lambda v: json_extract_string(v, '$.name') || '=' || json_extract_string(v, '$.value'))), '|') || '>'
              WHEN json_extract_string(e, '$.max') IS NOT NULL THEN '<max=' || json_extract_string(e, '$.max') || '>' ELSE '' END,
    CASE WHEN json_exists(e, '$.item') THEN coalesce(',max=' || json_extract_string(e, '$.max'), '') || coalesce(',len=' || json_extract_string(e, '$.len'), '') || '>' ELSE '' END || after,
    NOT json_exists(e, '$.item')
  FROM types WHERE NOT done),
nodes AS (SELECT w.schema_id, w.path, w.parent, w.name, w.pos, coalesce(json_extract_string(w.element, '$.nullable') = 'true', false) AS nullable, t.before || t.after AS kind
  FROM walk w JOIN types t ON w.schema_id = t.schema_id AND w.path = t.path AND t.done WHERE w.pos >= 0 AND w.path <> '')"""

SQL: dict[str, str] = {
    "p1_found": """
WITH RECURSIVE scene AS (SELECT DISTINCT msg_id, value FROM scene_messages),
o AS (SELECT msg_id, unnest(value.objects) AS e, generate_subscripts(value.objects, 1) - 1 AS i FROM scene),
r AS (SELECT msg_id, unnest(value.regions) AS e, generate_subscripts(value.regions, 1) - 1 AS i FROM scene),
ot AS (SELECT msg_id, i, unnest(e.track) AS e, generate_subscripts(e.track, 1) - 1 AS k FROM o),
op AS (SELECT msg_id, i, unnest(e.parts) AS e, generate_subscripts(e.parts, 1) - 1 AS k FROM o),
rp AS (SELECT msg_id, i, unnest(e.polygon) AS e, generate_subscripts(e.polygon, 1) - 1 AS k FROM r),
defs AS (SELECT schema_id, any_value(field_defs)::JSON AS d FROM topic_schemas GROUP BY schema_id),
walk AS (
  SELECT schema_id, '' AS prefix, '' AS parent, '' AS path, d AS fields, NULL::JSON AS el FROM defs
  UNION ALL
  SELECT schema_id,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name')
         ELSE prefix || CASE WHEN json_extract_string(el, '$.data_type') = 'Map' THEN '{}' ELSE '[]' END END
      || CASE WHEN json_exists(CASE WHEN el IS NULL THEN x ELSE el END, CASE WHEN el IS NULL THEN '$.element.fields' ELSE '$.item.fields' END) THEN '.' ELSE '' END,
    CASE WHEN el IS NULL THEN path ELSE parent END,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name') ELSE path END,
    CASE WHEN el IS NULL THEN json_extract(x, '$.element.fields') ELSE json_extract(el, '$.item.fields') END,
    CASE WHEN el IS NULL THEN CASE WHEN json_exists(x, '$.element.item') THEN json_extract(x, '$.element') END
         ELSE CASE WHEN json_exists(el, '$.item.item') THEN json_extract(el, '$.item') END END
  FROM (SELECT *, unnest(CASE WHEN el IS NULL THEN from_json(fields, '["JSON"]') ELSE ['0'::JSON] END) AS x FROM walk WHERE fields IS NOT NULL OR el IS NOT NULL))
SELECT DISTINCT * FROM (
  SELECT 'scene' AS src, msg_id AS rec_id, 'objects[' || i || ']' AS node, '' AS parent FROM o WHERE e IS NOT NULL
  UNION ALL SELECT 'scene', msg_id, 'objects[' || i || '].track[' || k || ']', 'objects[' || i || ']' FROM ot WHERE e IS NOT NULL
  UNION ALL SELECT 'scene', msg_id, 'objects[' || i || '].parts[' || k || ']', 'objects[' || i || ']' FROM op WHERE e IS NOT NULL
  UNION ALL SELECT 'scene', msg_id, 'regions[' || i || ']', '' FROM r WHERE e IS NOT NULL
  UNION ALL SELECT 'scene', msg_id, 'regions[' || i || '].polygon[' || k || ']', 'regions[' || i || ']' FROM rp WHERE e IS NOT NULL
  UNION ALL SELECT 'schema', schema_id, path, parent FROM walk WHERE path <> '')""",
    "p1_object_table": """
SELECT msg_id, i AS pos, e.id AS id, e.label AS label, e.score AS score, e.pose.position.x AS x, e.pose.position.y AS y, e.pose.position.z AS z, e.pose.yaw AS yaw
FROM (SELECT msg_id, unnest(value.objects) AS e, generate_subscripts(value.objects, 1) - 1 AS i FROM (SELECT DISTINCT msg_id, value FROM scene_messages))
WHERE e IS NOT NULL""",
    "p1_part_codes": """
WITH o AS (SELECT msg_id, unnest(value.objects) AS e, generate_subscripts(value.objects, 1) - 1 AS i FROM (SELECT DISTINCT msg_id, value FROM scene_messages)),
p AS (SELECT msg_id, i, e.label AS label, unnest(e.parts) AS q FROM o WHERE e IS NOT NULL),
c AS (SELECT msg_id, i, label, q.name AS part_name, unnest(q.health.codes) AS code, generate_subscripts(q.health.codes, 1) - 1 AS code_pos FROM p WHERE q IS NOT NULL)
SELECT msg_id, i AS object_pos, label, part_name, code_pos, code FROM c WHERE code IS NOT NULL""",
    "p2_found": """
WITH RECURSIVE defs AS (SELECT schema_id, any_value(field_defs)::JSON AS d FROM topic_schemas GROUP BY schema_id),
walk AS (
  SELECT schema_id, '' AS prefix, '' AS parent, '' AS path, 0 AS pos, NULL::JSON AS element, d AS fields, NULL::JSON AS el FROM defs
  UNION ALL
  SELECT schema_id,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name')
         ELSE prefix || CASE WHEN json_extract_string(el, '$.data_type') = 'Map' THEN '{}' ELSE '[]' END END
      || CASE WHEN json_exists(CASE WHEN el IS NULL THEN x ELSE el END, CASE WHEN el IS NULL THEN '$.element.fields' ELSE '$.item.fields' END) THEN '.' ELSE '' END,
    CASE WHEN el IS NULL THEN path ELSE parent END,
    CASE WHEN el IS NULL THEN prefix || json_extract_string(x, '$.name') ELSE path END,
    CASE WHEN el IS NULL THEN i ELSE -1 END,
    json_extract(x, '$.element'),
    CASE WHEN el IS NULL THEN json_extract(x, '$.element.fields') ELSE json_extract(el, '$.item.fields') END,
    CASE WHEN el IS NULL THEN CASE WHEN json_exists(x, '$.element.item') THEN json_extract(x, '$.element') END
         ELSE CASE WHEN json_exists(el, '$.item.item') THEN json_extract(el, '$.item') END END
  FROM (SELECT *, unnest(CASE WHEN el IS NULL THEN from_json(fields, '["JSON"]') ELSE ['0'::JSON] END) AS x,
               unnest(range(CASE WHEN el IS NULL THEN json_array_length(fields)::BIGINT ELSE 1 END)) AS i FROM walk WHERE fields IS NOT NULL OR el IS NOT NULL)),
kinds AS (
  SELECT schema_id, path, parent, pos, element AS e, '' AS kind FROM walk WHERE pos >= 0 AND path <> ''
  UNION ALL
  SELECT schema_id, path, parent, pos, json_extract(e, '$.item'),
    kind || '/' || coalesce(json_extract_string(e, '$.data_type'), json_extract_string(e, '$')) || ':' || coalesce(json_extract_string(e, '$.max'), '') || ':' || coalesce(json_extract_string(e, '$.len'), '')
      || ':' || coalesce(json_extract_string(e, '$.key.data_type'), json_extract_string(e, '$.key'), '')
      || ':' || coalesce(array_to_string(list_sort(list_transform(from_json(json_extract(e, '$.variants'), '["JSON"]'), lambda v: json_extract_string(v, '$.name') || '=' || json_extract_string(v, '$.value'))), '|'), '')
  FROM kinds WHERE e IS NOT NULL),
nodes AS (SELECT schema_id, path, parent, pos, kind FROM kinds WHERE e IS NULL),
files AS (SELECT file_id, min(vehicle) AS vehicle, min(started_at) AS started_at FROM mcap_files WHERE started_at IS NOT NULL AND vehicle IS NOT NULL GROUP BY 1),
chosen AS (SELECT file_id, topic, min(schema_id) AS schema_id FROM topic_schemas GROUP BY 1, 2),
named AS (SELECT schema_id, any_value(schema_name) AS schema_name, any_value(schema_encoding) AS schema_encoding FROM topic_schemas GROUP BY 1),
steps AS (SELECT file_id, topic, schema_id, lag(schema_id) OVER (PARTITION BY vehicle, topic ORDER BY started_at, file_id) AS before FROM chosen JOIN files USING (file_id)),
came AS (SELECT s.file_id, s.topic, n.path, n.parent, n.pos, n.kind, o.path IS NOT NULL AS kept FROM steps s JOIN nodes n ON n.schema_id = s.schema_id
         LEFT JOIN nodes o ON o.schema_id = s.before AND o.path = n.path WHERE s.before IS NOT NULL AND (o.path IS NULL OR o.kind <> n.kind)),
went AS (SELECT s.file_id, s.topic, o.path, o.parent, o.pos, o.kind, n.path IS NOT NULL AS kept FROM steps s JOIN nodes o ON o.schema_id = s.before
         LEFT JOIN nodes n ON n.schema_id = s.schema_id AND n.path = o.path WHERE n.path IS NULL OR o.kind <> n.kind),
came_top AS (SELECT * FROM came c WHERE NOT EXISTS (SELECT 1 FROM came a WHERE a.file_id = c.file_id AND a.topic = c.topic AND c.path <> a.path
         AND (starts_with(c.path, a.path || '.') OR starts_with(c.path, a.path || '[') OR starts_with(c.path, a.path || '{')))),
went_top AS (SELECT * FROM went c WHERE NOT EXISTS (SELECT 1 FROM went a WHERE a.file_id = c.file_id AND a.topic = c.topic AND c.path <> a.path
         AND (starts_with(c.path, a.path || '.') OR starts_with(c.path, a.path || '[') OR starts_with(c.path, a.path || '{')))),
pairs AS (SELECT c.file_id, c.topic, c.path, w.path AS old FROM came_top c JOIN went_top w USING (file_id, topic, parent, pos, kind) WHERE NOT c.kept AND NOT w.kept)
SELECT file_id, topic, path AS field_path, CASE WHEN kept THEN 'retyped' WHEN (file_id, topic, path) IN (SELECT (file_id, topic, path) FROM pairs) THEN 'renamed' ELSE 'added' END AS change FROM came_top
UNION ALL
SELECT file_id, topic, path, 'removed' FROM went_top WHERE NOT kept AND (file_id, topic, path) NOT IN (SELECT (file_id, topic, old) FROM pairs)
UNION ALL
SELECT s.file_id, s.topic, '', 'schema_name' FROM steps s JOIN named n ON n.schema_id = s.schema_id JOIN named o ON o.schema_id = s.before WHERE n.schema_name IS DISTINCT FROM o.schema_name
UNION ALL
SELECT s.file_id, s.topic, '', 'schema_encoding' FROM steps s JOIN named n ON n.schema_id = s.schema_id JOIN named o ON o.schema_id = s.before WHERE n.schema_encoding IS DISTINCT FROM o.schema_encoding""",
    "p3_found": """
SELECT DISTINCT t.file_id, t.topic FROM topics t
LEFT JOIN (SELECT file_id, topic, count(DISTINCT msg_id) AS n FROM raw_messages GROUP BY 1, 2) r ON t.file_id = r.file_id AND t.topic = r.topic
WHERE NOT t.decodable AND t.message_count IS NOT NULL AND t.message_count <> coalesce(r.n, 0)""",
    "p3_counts": """
SELECT DISTINCT t.file_id, t.topic, t.message_count AS stated, coalesce(r.n, 0) AS actual, coalesce(r.n, 0) - t.message_count AS gap FROM topics t
LEFT JOIN (SELECT file_id, topic, count(DISTINCT msg_id) AS n FROM raw_messages GROUP BY 1, 2) r ON t.file_id = r.file_id AND t.topic = r.topic
WHERE NOT t.decodable""",
    "p3_topic_totals": """
SELECT f.site, r.topic, count(*) AS n_rows, sum(coalesce(octet_length(r.data), 0))::BIGINT AS n_bytes
FROM raw_messages r JOIN (SELECT DISTINCT file_id, coalesce(lower(trim(site)), 'unknown') AS site FROM mcap_files) f ON r.file_id = f.file_id
GROUP BY 1, 2""",
    "p3_weighted_bytes": """
SELECT r.topic, count(*) AS n_rows, sum(coalesce(octet_length(r.data), 0))::BIGINT AS sum_size, sum(coalesce(t.message_count, 0))::BIGINT AS sum_stated
FROM raw_messages r JOIN topics t ON r.file_id = t.file_id GROUP BY 1""",
    "p4_range": f"""WITH {_READ}
SELECT o.msg_id, o.reading FROM ok o JOIN (SELECT DISTINCT topic, min_possible, max_possible FROM signal_limits) l ON o.topic = l.topic
WHERE o.reading < l.min_possible OR o.reading > l.max_possible""",
    "p4_stuck": f"""WITH {_READ},
mark AS (SELECT *, CASE WHEN reading = lag(reading) OVER w THEN 0 ELSE 1 END AS fresh FROM ok WINDOW w AS (PARTITION BY file_id, topic ORDER BY log_time, msg_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id, topic ORDER BY log_time, msg_id) AS run FROM mark)
SELECT msg_id, reading FROM runs QUALIFY count(*) OVER (PARTITION BY file_id, topic, run) >= 10""",
    "p5_found": f"WITH {_RAW_FIRST} SELECT msg_id FROM run WHERE behind > 60000000000",
    "p5_minutes": f"""WITH {_RAW_FIRST}
SELECT topic, (publish_time // 60000000000) * 60000000000 AS window_start,
  count(*) FILTER (behind = 0) AS n_first, count(*) FILTER (behind <= 60000000000) AS n_messages,
  coalesce(sum(n_bytes) FILTER (behind <= 60000000000), 0)::BIGINT AS n_bytes,
  count(*) FILTER (behind > 0 AND behind <= 60000000000) AS n_late, count(*) FILTER (behind > 60000000000) AS n_beyond
FROM run GROUP BY 1, 2""",
    "p5_stream_found": f"WITH {_RAW_FIRST} SELECT msg_id FROM run WHERE behind > 60000000000",
    "p7_found": f"""WITH {_READ},
slots AS (SELECT DISTINCT file_id, topic, log_time // 10000000000 AS slot FROM ok),
every AS (SELECT file_id, topic, unnest(range(min(slot), max(slot) + 1)) AS slot FROM slots GROUP BY 1, 2)
SELECT file_id, topic, slot FROM every ANTI JOIN slots USING (file_id, topic, slot)""",
}
SQL["p5_stream_minutes"] = SQL["p5_minutes"]
SQL["p1_field_table"] = f"""WITH RECURSIVE {_FIELDS}
SELECT schema_id, path AS node, parent, name, pos::INTEGER AS pos, kind AS type, nullable FROM nodes"""
SQL["p2_report"] = f"""WITH RECURSIVE {_FIELDS},
files AS (SELECT file_id, min(vehicle) AS vehicle, min(started_at) AS started_at FROM mcap_files WHERE started_at IS NOT NULL AND vehicle IS NOT NULL GROUP BY 1),
chosen AS (SELECT file_id, topic, min(schema_id) AS schema_id FROM topic_schemas GROUP BY 1, 2),
named AS (SELECT schema_id, any_value(schema_name) AS schema_name, any_value(schema_encoding) AS schema_encoding FROM topic_schemas GROUP BY 1),
steps AS (SELECT vehicle AS producer, file_id, topic, schema_id, lag(schema_id) OVER w AS before, row_number() OVER w AS seq FROM chosen JOIN files USING (file_id) WINDOW w AS (PARTITION BY vehicle, topic ORDER BY started_at, file_id)),
came AS (SELECT s.*, n.path, n.parent, n.pos, n.kind, o.kind AS old_kind, o.path IS NOT NULL AS kept FROM steps s JOIN nodes n ON n.schema_id = s.schema_id
         LEFT JOIN nodes o ON o.schema_id = s.before AND o.path = n.path WHERE s.before IS NOT NULL AND (o.path IS NULL OR o.kind <> n.kind)),
went AS (SELECT s.*, o.path, o.parent, o.pos, o.kind, n.path IS NOT NULL AS kept FROM steps s JOIN nodes o ON o.schema_id = s.before
         LEFT JOIN nodes n ON n.schema_id = s.schema_id AND n.path = o.path WHERE n.path IS NULL OR o.kind <> n.kind),
came_top AS (SELECT * FROM came c WHERE NOT EXISTS (SELECT 1 FROM came a WHERE a.file_id = c.file_id AND a.topic = c.topic AND c.path <> a.path
         AND (starts_with(c.path, a.path || '.') OR starts_with(c.path, a.path || '[') OR starts_with(c.path, a.path || '{{')))),
went_top AS (SELECT * FROM went c WHERE NOT EXISTS (SELECT 1 FROM went a WHERE a.file_id = c.file_id AND a.topic = c.topic AND c.path <> a.path
         AND (starts_with(c.path, a.path || '.') OR starts_with(c.path, a.path || '[') OR starts_with(c.path, a.path || '{{')))),
pairs AS (SELECT c.file_id, c.topic, c.path, w.path AS old FROM came_top c JOIN went_top w ON c.file_id = w.file_id AND c.topic = w.topic AND c.parent = w.parent AND c.pos = w.pos AND c.kind = w.kind WHERE NOT c.kept AND NOT w.kept)
SELECT c.producer, c.topic, c.seq, c.file_id, CASE WHEN c.kept THEN 'retyped' WHEN p.old IS NOT NULL THEN 'renamed' ELSE 'added' END AS change, c.path AS field_path,
  CASE WHEN c.kept THEN c.path ELSE p.old END AS old_path, CASE WHEN c.kept THEN c.old_kind WHEN p.old IS NOT NULL THEN c.kind END AS old_type, c.kind AS new_type
FROM came_top c LEFT JOIN pairs p ON c.file_id = p.file_id AND c.topic = p.topic AND c.path = p.path
UNION ALL
SELECT w.producer, w.topic, w.seq, w.file_id, 'removed', w.path, w.path, w.kind, NULL FROM went_top w
WHERE NOT w.kept AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.file_id = w.file_id AND p.topic = w.topic AND p.old = w.path)
UNION ALL
SELECT s.producer, s.topic, s.seq, s.file_id, 'schema_name', '', '', coalesce('=' || o.schema_name, 'null'), coalesce('=' || n.schema_name, 'null')
FROM steps s JOIN named n ON n.schema_id = s.schema_id JOIN named o ON o.schema_id = s.before WHERE n.schema_name IS DISTINCT FROM o.schema_name
UNION ALL
SELECT s.producer, s.topic, s.seq, s.file_id, 'schema_encoding', '', '', coalesce('=' || o.schema_encoding, 'null'), coalesce('=' || n.schema_encoding, 'null')
FROM steps s JOIN named n ON n.schema_id = s.schema_id JOIN named o ON o.schema_id = s.before WHERE n.schema_encoding IS DISTINCT FROM o.schema_encoding"""
