"""Schemas that drift between files: a catalogue of column lifespans.

Per producer the files are numbered in time.  Successive files with the same
schema are one *run*; a schema's text says little about that, as styles and key
orders differ, so distinct texts are parsed once to a fingerprint of what they
define.  Each (producer, field, type) then lives on one or more *islands* of
consecutive runs.  An island that begins after the first run is a start, one that
ends before the last is an ending; starts and endings that meet between the same
runs pair up to retypes and renames, the rest are additions and removals.  Renames
give the alias table from which one consistent table is cast.

Only fingerprints are shuffled to find the runs, and only a run's first schema is
exploded.  Nothing here holds a producer's history in one task: versions are
numbered by time block (counts per block, then offsets), and islands are found
within blocks of runs that carry one run of context from their neighbours.

Defined cases:

* a file without a start time or vehicle, or a schema of a file that is not in the file
  table, has no place in the order and is left out;
* repeated rows count once; of several schemas for one (file, topic) the
  one with the smallest id counts;
* files of one producer with equal start times are ordered by file id;
* null or malformed field definitions are a schema without fields;
* null schema names and encodings are values of their own;
* empty tables give no changes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.exact import floor_div
from logloom.operators.dewey import NODES, parse_fields
from logloom.session import tasks

#: Runs handled together; a block sees one more run on either side.
BLOCK = 512
#: Microseconds of a time block for numbering (30 days).
SPAN_US = 30 * 86_400_000_000

NAME, ENCODING = "\x00schema_name", "\x00schema_encoding"
_KEY = ["print", "schema_name", "schema_encoding"]


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("field_defs", F.lit(""))))


def texts(schemas: DataFrame) -> DataFrame:
    """``(digest, field_defs)``: each text once, by its digest."""
    return schemas.select(_digest().alias("digest"), "field_defs").dropDuplicates(["digest"])


#: What of a field definition the catalogue needs.
_NODE = T.StructType([f for f in NODES.fields if f.name in ("node", "parent", "pos", "type", "above")])
_NODE_ARROW = pa.list_(pa.struct([("node", pa.string()), ("parent", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("above", pa.list_(pa.string()))]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = [[{k: n[k] for k in _NODE.names} for n in parse_fields(text) or []] for text in b.column(1).to_pylist()]
        prints = [hashlib.blake2b(repr(sorted((n["node"], n["pos"], n["type"]) for n in one)).encode(), digest_size=16).digest() for one in nodes]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary()), pa.array(nodes, _NODE_ARROW)], ["digest", "print", "nodes"])


def definitions(schemas: DataFrame) -> DataFrame:
    """``(digest, print, nodes)``: fingerprint and field definitions of each distinct text."""
    return texts(schemas).mapInArrow(_parse, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("print", T.BinaryType()), T.StructField("nodes", T.ArrayType(_NODE))]))


def versions(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Schemas in order of time: ``(producer, topic, seq, n_versions, run, n_runs, fresh, file_id, schema_id, schema_name, schema_encoding, digest)``.

    ``seq`` and ``run`` count from 1; ``fresh`` marks the first version of a run.
    """
    f = files.where(F.col("started_at").isNotNull() & F.col("vehicle").isNotNull()).groupBy("file_id").agg(F.min("vehicle").alias("producer"), F.min(F.unix_micros(F.col("started_at").cast("timestamp"))).alias("at"))
    s = schemas.where(F.col("topic").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "topic", "schema_id", "schema_name", "schema_encoding", _digest().alias("digest"))
    first = Window.partitionBy("file_id", "topic").orderBy("schema_id", "schema_name", "schema_encoding", "digest")
    one = s.repartition(tasks(schemas.sparkSession), "file_id").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    prints = definitions(schemas).select("digest", "print")
    placed = one.join(f, "file_id").join(prints, "digest").withColumn("span", floor_div(F.col("at"), SPAN_US)).where("producer is not null and topic is not null and span is not null")
    group = ["producer", "topic"]
    dealt = placed.repartition(tasks(schemas.sparkSession), *group, "span")
    key = F.struct(*_KEY)
    inside = Window.partitionBy(*group, "span").orderBy("at", "file_id")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).withColumn("new", (F.col("rank") > 1) & ~F.lag(key).over(inside).eqNullSafe(key)).withColumn("news", F.sum(F.col("new").cast("bigint")).over(inside))
    # One row per span, and what came before it.
    last = Window.partitionBy(*group, "span").orderBy(F.desc("at"), F.desc("file_id"))
    ends = ranked.withColumn("back", F.row_number().over(last)).where("rank = 1 or back = 1")
    # The structs take along every column, lest pruning make this another exchange than that of the versions.
    row = F.struct(*_KEY, "digest", "schema_id")
    spans = ends.groupBy(*group, "span").agg(F.max("rank").alias("n"), F.max("news").alias("news"), F.max(F.when(F.col("rank") == 1, row)).alias("head"), F.max(F.when(F.col("back") == 1, row)).alias("tail"))
    parts = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in _KEY])
    spans = spans.withColumn("head", parts("head")).withColumn("tail", parts("tail"))
    ahead, whole = Window.partitionBy(*group).orderBy("span"), Window.partitionBy(*group)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    joined = spans.withColumn("new_head", F.coalesce(~F.lag("tail").over(ahead).eqNullSafe(F.col("head")), F.lit(True)) | (F.row_number().over(ahead) == 1)).withColumn("runs", F.col("news") + F.col("new_head").cast("bigint"))
    offsets = joined.select(*group, "span", "new_head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"), F.sum("n").over(whole).alias("n_versions"), F.coalesce(F.sum("runs").over(before), F.lit(0)).alias("run0"), F.sum("runs").over(whole).alias("n_runs"))
    fresh = F.when(F.col("rank") == 1, F.col("new_head")).otherwise(F.col("new"))
    return ranked.join(offsets, [*group, "span"]).select(
        *group, (F.col("rank") + F.col("seq0")).alias("seq"), "n_versions", (F.col("news") + F.col("run0") + F.col("new_head").cast("bigint")).alias("run"), "n_runs", fresh.alias("fresh"),
        "file_id", "schema_id", "schema_name", "schema_encoding", "digest",
    )


def lifespans(runs: DataFrame, defs: DataFrame) -> DataFrame:
    """Islands of every (producer, topic, field, type): first and last run, with whether they start or end inside the history."""
    keep = ["producer", "topic", "run", "n_runs", "seq", "file_id", "after", "home", "block"]

    def pseudo(node: str, c: str) -> Column:
        """The schema's own name and encoding as fields whose type is their value."""
        value = F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
        return F.struct(F.lit(node).alias("node"), F.lit("").alias("parent"), F.lit(-1).alias("pos"), value.alias("type"), F.array().cast("array<string>").alias("above"))

    block = floor_div(F.col("run"), BLOCK)
    at = F.col("run") % BLOCK
    homes = F.filter(F.array(block, F.when(at == BLOCK - 1, block + 1), F.when((at == 0) & (block > 0), block - 1)), lambda x: x.isNotNull())
    told = runs.join(defs.select("digest", "nodes"), "digest").withColumn("home", block).withColumn("block", F.explode(homes))
    # Exploded where their islands are found, so that no single field is shuffled.
    dealt = told.repartition(tasks(runs.sparkSession), "producer", "topic", "block")
    after = F.lead(F.struct("seq", "file_id")).over(Window.partitionBy("producer", "topic", "block").orderBy("run"))
    nodes = F.concat("nodes", F.array(pseudo(NAME, "schema_name"), pseudo(ENCODING, "schema_encoding")).cast(T.ArrayType(_NODE)))
    rows = dealt.withColumn("after", after).select(*keep, F.explode(nodes).alias("x")).select(*keep, *[F.col(f"x.{c}").alias(c) for c in ("node", "parent", "pos", "type", "above")])
    w = Window.partitionBy("producer", "topic", "block", "node", "type").orderBy("run")
    edges = (
        rows.withColumn("prev", F.lag("run").over(w))
        .withColumn("next", F.lead("run").over(w))
        .where(F.col("home") == F.col("block"))
        .withColumn("starts", F.coalesce(F.col("prev") != F.col("run") - 1, F.lit(True)) & (F.col("run") > 1))
        .withColumn("ends", F.coalesce(F.col("next") != F.col("run") + 1, F.lit(True)) & (F.col("run") < F.col("n_runs")))
        .where(F.col("starts") | F.col("ends"))
    )
    return edges.drop("prev", "next", "home", "block")


def changes(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every change of a topic's schema between one file of a producer and the next.

    ``(producer, topic, seq, file_id, change, field_path, old_path, old_type, new_type)``;
    ``seq`` and ``file_id`` are those of the later file.  Below a reported field nothing is reported.
    """
    return changes_of(versions(files, schemas), definitions(schemas))


def changes_of(vers: DataFrame, defs: DataFrame) -> DataFrame:
    """``changes`` from ``versions`` and ``definitions``."""
    edges = lifespans(vers.where("fresh"), defs)
    cols = ["producer", "topic", "node", "parent", "pos", "type", "above"]
    # An ending is told by the run after it.
    here = F.struct(F.col("starts").alias("is"), F.lit(True).alias("start"), F.col("run").alias("run"), F.col("seq").alias("seq"), F.col("file_id").alias("file_id"))
    next_ = F.struct(F.col("ends").alias("is"), F.lit(False).alias("start"), (F.col("run") + 1).alias("run"), F.col("after.seq").alias("seq"), F.col("after.file_id").alias("file_id"))
    events = edges.select(*cols, F.explode(F.filter(F.array(here, next_), lambda e: e["is"])).alias("side")).select(*cols, "side.run", "side.start", "side.seq", "side.file_id")
    at = ["producer", "topic", "run"]
    whole = Window.partitionBy(*at)
    paths = lambda start: F.collect_set(F.when(F.col("start") == F.lit(start), F.col("node"))).over(whole)
    top = (
        events.withColumn("came", paths(True)).withColumn("went", paths(False))
        .where(F.when(F.col("start"), ~F.arrays_overlap("above", "came")).otherwise(~F.arrays_overlap("above", "went")))
        .withColumn("both", F.array_contains("came", F.col("node")) & F.array_contains("went", F.col("node")))
    )
    place = Window.partitionBy(*at, "parent", "both", "pos", "type")
    other = lambda c, start: F.max(F.when(F.col("start") == F.lit(start), F.col(c))).over(place)
    same = Window.partitionBy(*at, "parent", "both", "node")
    paired = (
        top.withColumn("gone_here", other("node", False)).withColumn("came_here", other("node", True))
        .withColumn("old_type", F.max(F.when(~F.col("start"), F.col("type"))).over(same))
    )
    renamed = ~F.col("both") & F.col("gone_here").isNotNull() & F.col("came_here").isNotNull()
    kind = (
        F.when(F.col("node").isin(NAME, ENCODING), F.substring("node", 2, 99))
        .when(F.col("both"), "retyped")
        .when(renamed, "renamed")
        .when(F.col("start"), "added")
        .otherwise("removed")
    )
    found = paired.withColumn("change", kind).where(F.col("start") | (F.col("change") == "removed"))
    plain = F.when(F.col("node").isin(NAME, ENCODING), F.lit("")).otherwise(F.col("node"))
    old = F.when(F.col("change") == "renamed", F.col("gone_here")).when(F.col("change") != "added", plain)
    return found.select("producer", "topic", "seq", "file_id", "change", plain.alias("field_path"), old.alias("old_path"), F.when(F.col("change") == "added", None).when(F.col("start"), F.coalesce("old_type", "type")).otherwise(F.col("type")).alias("old_type"), F.when(F.col("start"), F.col("type")).alias("new_type"))
