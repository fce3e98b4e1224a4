"""Filling fixed-capacity containers with texts of varying length, by hierarchical residual packing.

Texts are measured in tokens of a public tokenizer, once for all capacities.  A
text longer than a container is cut into full containers and a rest; nothing
else is split.  Then, per capacity:

1. every task packs a bounded group of items best-fit decreasing;
2. bins that are nearly full are emitted, the underfull ones become items of
   their own and go to the next round;
3. rounds merge the groups like a tree: the residue of each budget is dealt into as
   many groups as it then needs, until it is one group, whose bins are final, or a
   round leaves it as it was: then every group's bins are of sizes that do not
   fit together, and they are final too.  Budgets end one by one, each by its own residue.

A group holds about ``GROUP`` items whatever the corpus size.  Every round but a budget's last makes its residue
smaller, so the rounds end.  Each round is written to the shared checkpoint folder, so later rounds do not repeat
earlier ones and a lost executor loses none.

Defined cases: null texts are no items; empty texts have 0 tokens and take no
room, but are placed like any other; documents with equal ids are packed as they
come, each row once; capacities that are null or below 1 are refused; equal capacities are separate budgets; an empty
table gives no containers; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import checkpointed, spread, tasks

#: Items packed together, share of a container from which it is emitted before the last round.
GROUP, NEARLY = 20_000, 0.995
#: A round that leaves more than this share of a budget's bins is not worth another: merging has stopped to fill them.
STALL = 0.9
#: The pattern that the byte-level vocabularies are defined with (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """Encoder of a rank file, once per worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("logloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, tokens)`` of every document with a text.  The vocabulary travels to machines that have no such file."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    src = spread(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, best-fit decreasing: each item goes where least room is left over."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        else:
            b, left = len(bins), capacity - sizes[i]
            bins.append([i])
        if left:
            insort(room, (left, b))
        elif sizes[i] == 0:
            room.insert(0, (0, b))
    return bins


def pack(items: DataFrame, budgets: DataFrame, group: int = GROUP, nearly: float = NEARLY) -> DataFrame:
    """Containers for each budget: ``(budget_id, container, used, capacity, doc_id, piece, start, tokens)``, one row per placed piece.

    ``items`` has ``doc_id, tokens``, ``budgets`` has ``budget_id, capacity_tokens``.  ``start`` is the piece's first
    token in its document, ``container`` names a container uniquely within its budget.
    """
    spark = items.sparkSession
    caps = {r.budget_id: r.capacity_tokens for r in budgets.select("budget_id", "capacity_tokens").distinct().collect()}
    bad = [b for b, c in caps.items() if b is None or c is None or c < 1]
    if bad:
        raise ValueError(f"budgets without a capacity of at least 1: {bad}")
    kind = items.schema["doc_id"].dataType.simpleString()
    part = f"struct<doc_id: {kind}, piece: int, start: bigint, tokens: bigint>"
    empty = spark.createDataFrame([], f"budget_id bigint, container string, used bigint, capacity bigint, doc_id {kind}, piece int, start bigint, tokens bigint")
    if not caps:
        return empty
    sizes = checkpointed(items.select("doc_id", "tokens").where(F.col("tokens").isNotNull()))
    n = sizes.count()
    table = F.create_map(*[F.lit(x).cast("bigint") for kv in caps.items() for x in kv])
    each = sizes.withColumn("budget_id", F.explode(F.array(*[F.lit(b).cast("bigint") for b in caps]))).withColumn("capacity", table[F.col("budget_id")])
    # Whole containers of overlong texts are final at once; the rest is an item like others.
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    rest = F.col("tokens") - full * F.col("capacity")
    cut = each.where(F.col("tokens") >= F.col("capacity")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)))
    done = [
        cut.select("budget_id", F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece"), F.lit("."), F.monotonically_increasing_id()).alias("container"), F.col("capacity").alias("used"), "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    ]
    left = each.where((rest > 0) | (F.col("tokens") == 0)).select("budget_id", "capacity", rest.alias("size"), F.array(F.struct(F.col("doc_id"), full.cast("int").alias("piece"), (full * F.col("capacity")).alias("start"), rest.alias("tokens"))).cast(f"array<{part}>").alias("parts"))
    schema = f"budget_id bigint, capacity bigint, size bigint, parts array<{part}>, container string"
    counts = {b: n for b in caps}
    depth, final = 0, set()
    while counts:
        groups = {b: max(1, -(-c // group)) for b, c in counts.items()}
        # One group is the root of a budget's tree.
        last = {b for b, g in groups.items() if g == 1} | final
        number = F.create_map(*[F.lit(x).cast("bigint") for kv in groups.items() for x in kv])
        packed = left.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number[F.col("budget_id")]).cast("int"))
        exchange = min(sum(groups.values()), max(tasks(spark), 4 * spark.sparkContext.defaultParallelism, max(groups.values())))
        out = packed.repartition(exchange, "budget_id", "g").sortWithinPartitions("budget_id", "g", F.desc("size"), "parts").mapInArrow(_packer(nearly, last, depth), schema)
        out = checkpointed(out)
        done.append(_rows(out.where(F.col("container").isNotNull())))
        left = out.where(F.col("container").isNull()).drop("container")
        after = {r["budget_id"]: r["count"] for r in left.groupBy("budget_id").count().collect()}
        # A budget whose residue stands still is packed for the last time; the others go on.
        final = {b for b, c in after.items() if depth and c > STALL * counts[b]}
        counts = after
        depth += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def _rows(bins: DataFrame) -> DataFrame:
    return bins.select("budget_id", "container", F.col("size").alias("used"), "capacity", F.inline("parts"))


def _packer(nearly: float, last: set[int], depth: int):
    """Packs each (budget, group) of a sorted partition; bins below ``nearly`` come out without a name, to be packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def key(t: pa.Table, i: int) -> tuple[int, int]:
            return t.column("budget_id")[i].as_py(), t.column("g")[i].as_py()

        def done(t: pa.Table) -> pa.RecordBatch:
            budget, g = key(t, 0)
            capacity = t.column("capacity")[0].as_py()
            bins = best_fit(t.column("size").to_pylist(), capacity)
            parts = t.column("parts").combine_chunks()
            order = parts.take(pa.array([i for b in bins for i in b], pa.int64()))
            ends, at, off = order.offsets.to_pylist(), 0, [0]
            used = []
            size = t.column("size").to_pylist()
            for b in bins:
                at += len(b)
                off.append(ends[at] - ends[0])
                used.append(sum(size[i] for i in b))
            merged = pa.ListArray.from_arrays(pa.array(off, pa.int32()), order.flatten())
            names = [f"{depth}.{g}.{k}" if budget in last or u >= nearly * capacity else None for k, u in enumerate(used)]
            m = len(bins)
            return pa.RecordBatch.from_arrays([pa.array([budget] * m, pa.int64()), pa.array([capacity] * m, pa.int64()), pa.array(used, pa.int64()), merged, pa.array(names, pa.string())], ["budget_id", "capacity", "size", "parts", "container"])

        def cut(t: pa.Table) -> list[int]:
            import numpy as np

            b, g = t.column("budget_id").to_numpy(), t.column("g").to_numpy()
            return [0, *(np.flatnonzero((b[1:] != b[:-1]) | (g[1:] != g[:-1])) + 1).tolist(), len(t)]

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*rest, b])
            at = cut(t)
            for lo, hi in zip(at[:-2], at[1:-1], strict=True):
                yield done(t.slice(lo, hi - lo).combine_chunks())
            rest = t.slice(at[-2]).to_batches()
        if rest:
            yield done(pa.Table.from_batches(rest).combine_chunks())

    return run


def faults(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per budget: documents placed, containers that are overfull or state a wrong use, documents whose pieces do not cover them,
    and documents split although they fit a container; all but the first must be 0."""
    one = packed.groupBy("budget_id", "capacity", "container").agg(F.sum("tokens").alias("held"), F.max("used").alias("used"))
    over = one.groupBy("budget_id").agg(F.count(F.when((F.col("held") > F.col("capacity")) | (F.col("held") != F.col("used")), 1)).alias("n_overfull"))
    # Rows of equal ids count as one document of their total, as pieces name only the id.
    whole = sizes.where(F.col("tokens").isNotNull()).groupBy("doc_id").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest"))
    placed = packed.groupBy("budget_id", "capacity", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    met = placed.join(whole, placed["doc_id"].eqNullSafe(whole["doc_id"]), "left").drop(whole["doc_id"])
    least = F.when(F.col("n") == 1, F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))))
    docs = met.groupBy("budget_id").agg(
        F.sum("n").alias("n_documents"),
        F.count(F.when(~F.col("tokens").eqNullSafe(F.col("size")), 1)).alias("n_uncovered"),
        F.count(F.when(F.col("pieces") > least, 1)).alias("n_split"),
    )
    return docs.join(over, "budget_id")


def fill(packed: DataFrame) -> DataFrame:
    """Per budget: containers, tokens placed, share of room used, and the fewest containers that could hold them."""
    one = packed.groupBy("budget_id", "capacity", "container").agg(F.max("used").alias("used"))
    total = one.groupBy("budget_id", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("tokens"))
    return total.select("budget_id", "capacity", "n_containers", "tokens", (F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("used_share"), F.ceil(F.col("tokens") / F.col("capacity")).alias("n_least"))
