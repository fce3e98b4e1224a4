"""Queries of the text problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import language, leakage, packing, tickjoin
from logloom.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every sweep with the nearest frame of its mount, and how far apart they are."""
    m = tickjoin.mount()
    return tickjoin.nearest(table(spark, sf, "lidar_sweeps"), table(spark, sf, "camera_frames"), {"file_id": (F.col("file_id"), F.col("file_id")), "mount": (m, m)}, "sweep_id", "frame_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pairs(spark, sf).select("sweep_id", "frame_id")


#: Vocabulary that texts are measured with; shipped to machines that lack the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document in a container of each budget."""
    sizes = packing.token_counts(table(spark, sf, "documents"), VOCABULARY)
    return packing.pack(sizes, table(spark, sf, "context_budgets"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers of each budget are filled."""
    return packing.fill(p8_containers(spark, sf))


def p8_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Documents placed per budget, and what would be wrong with the containers."""
    sizes = checkpointed(packing.token_counts(table(spark, sf, "documents"), VOCABULARY))
    return packing.faults(packing.pack(sizes, table(spark, sf, "context_budgets")), sizes)


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every leak with the length of its longest stretch, its edits and its weighted similarity."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p10_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document and every text cell."""
    return language.label_languages(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.corrections(p10_labels(spark, sf)).select("doc_id", "cell_no", "lang")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p6_found, p6_pairs, p8_containers, p8_fill, p8_faults, p9_found, p9_leaks, p10_found, p10_labels)}

_MOUNT = "nullif(regexp_extract(topic, '^/[^/]+/([^/]+)/[^/]+$', 1), '')"

_PAIRS = f"""
WITH s AS (SELECT DISTINCT sweep_id, file_id, {_MOUNT} AS mount, log_time FROM lidar_sweeps WHERE log_time IS NOT NULL),
f AS (SELECT DISTINCT frame_id, file_id, {_MOUNT} AS mount, log_time FROM camera_frames WHERE log_time IS NOT NULL),
j AS (SELECT s.sweep_id, f.frame_id, f.log_time - s.log_time AS gap_ns,
        row_number() OVER (PARTITION BY s.sweep_id ORDER BY abs(f.log_time - s.log_time), f.frame_id) AS r
      FROM s JOIN f ON s.file_id = f.file_id AND s.mount = f.mount
       AND f.log_time BETWEEN s.log_time - 40000000 AND s.log_time + 40000000)"""

#: The operators on text cannot be expressed in SQL; they are tested against brute force and held-out labels.  The SQL states what must hold of containers.
SQL: dict[str, str] = {
    "p6_found": f"{_PAIRS} SELECT sweep_id, frame_id FROM j WHERE r = 1",
    "p6_pairs": f"{_PAIRS} SELECT sweep_id, frame_id, gap_ns FROM j WHERE r = 1",
    "p8_faults": """SELECT DISTINCT budget_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_documents,
0::BIGINT AS n_overfull, 0::BIGINT AS n_uncovered, 0::BIGINT AS n_split FROM context_budgets""",
}
