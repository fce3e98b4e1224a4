import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import SparkFiles
from pyspark.sql import functions as F

from logloom.llm import packing as pk
from logloom.llm.queries import VOCABULARY

ITEMS = "doc_id bigint, tokens bigint, extra string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_best_fit(sizes):
    bins = pk.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    used = [sum(sizes[i] for i in b) for b in bins]
    assert all(u <= 50 for u in used)
    # Two bins that are at most half full would have been one.
    assert sum(u <= 25 for u in used) <= 1


def pack(spark, items, caps, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in items], ITEMS)
    b = spark.createDataFrame(list(caps.items()), "budget_id bigint, capacity_tokens int")
    return pk.pack(df, b, **kw)


def check(items, caps, got):
    for b, c in caps.items():
        mine = [r for r in got if r.budget_id == b]
        placed, used = {}, {}
        for r in mine:
            placed.setdefault(r.doc_id, []).append((r.piece, r.start, r.tokens))
            used[r.container] = used.get(r.container, 0) + r.tokens
            assert r.capacity == c
        assert set(placed) == {d for d, _ in items}
        for d, t in items:
            parts = sorted(placed[d])
            assert [p for p, _, _ in parts] == list(range(len(parts)))
            assert len(parts) == max(1, -(-t // c))  # split only if longer than a container
            assert [s for _, s, _ in parts] == [k * c for k in range(len(parts))] and sum(n for _, _, n in parts) == t
        assert all(u <= c for u in used.values()) and all(used[r.container] == r.used for r in mine)


def test_pack_rounds_place_everything_once(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 7, 33, 64, 90, 100, 101, 250, rng.randrange(400)])) for i in range(700)]
    caps = {1: 100, 2: 256, 3: 100}
    for kw in ({}, {"group": 60}, {"group": 30}, {"group": 10, "nearly": 0.9}):
        got = pack(spark, items, caps, **kw).collect()
        check(items, caps, got)
    total = sum(t for _, t in items)
    n = len({r.container for r in pack(spark, items, caps, group=60).collect() if r.budget_id == 2})
    assert n <= 1.05 * total / 256 + 1


def test_budgets_end_by_their_own_residue(spark):
    """Items of 40 never fill a container of 100, which must not end the packing of one of 97."""
    rng = random.Random(4)
    items = [(i, 40) for i in range(600)] + [(1000 + i, rng.randrange(1, 39)) for i in range(1500)]
    caps = {1: 41, 2: 997}
    got = pack(spark, items, caps, group=50).collect()
    check(items, caps, got)
    total = sum(t for _, t in items)
    assert len({r.container for r in got if r.budget_id == 2}) <= -(-total // 997) + 2


def test_faults(spark):
    items = [(1, 60), (2, 40), (3, 230), (4, 0)]
    packed = pack(spark, items, {1: 100})
    sizes = spark.createDataFrame(items, "doc_id bigint, tokens bigint")
    assert [tuple(r) for r in pk.faults(packed, sizes).collect()] == [(1, 4, 0, 0, 0)]
    assert pk.faults(packed.where("doc_id <> 3 or piece = 0"), sizes).first().n_uncovered == 1
    assert pk.faults(packed.withColumn("tokens", F.col("tokens") + 1), sizes).first().n_overfull > 0


def test_hot_copies_and_edges(spark):
    items = [(i, 40) for i in range(300)]
    check(items, {1: 100}, pack(spark, items, {1: 100}, group=20).collect())
    assert pack(spark, [], {1: 100}).collect() == [] == pack(spark, [(1, 5)], {}).collect()
    with pytest.raises(ValueError):
        pack(spark, [(1, 5)], {1: 0})
    twice = pack(spark, [(7, 30), (7, 30), (None, 10), (8, None)], {1: 100}).collect()
    assert sorted((r.doc_id is None, r.tokens) for r in twice) == [(False, 30), (False, 30), (True, 10)]


def test_token_counts(spark):
    enc = pk.encoder(VOCABULARY)
    texts = ["", "hello world", "a" * 5000, "пример 例 <|endoftext|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in pk.token_counts(df, VOCABULARY).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    assert os.path.exists(SparkFiles.get(os.path.basename(VOCABULARY)))
    assert got[0] == 0 and enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_fill(spark):
    packed = pack(spark, [(1, 60), (2, 40), (3, 30)], {1: 100})
    r = pk.fill(packed).first()
    assert (r.n_containers, r.tokens, r.n_least) == (2, 130, 2) and abs(r.used_share - 0.65) < 1e-9
    assert packed.where(F.col("used") > F.col("capacity")).count() == 0
