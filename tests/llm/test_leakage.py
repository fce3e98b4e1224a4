import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import leakage as lk

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[a-z0-9]+", "".join(c if ord(c) < 128 else " " for c in text).lower())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(doc, item, n=20, rate=0.1):
    """Some stretch of n or more item words, beginning and ending with a match, within the edits of some stretch of the document."""
    for i in range(len(item)):
        for length in range(n, len(item) - i + 1):
            part, k = item[i : i + length], int(length * rate + 1e-9)
            for j in range(len(doc)):
                if doc[j] != part[0]:
                    continue
                for m in range(max(1, length - k), length + k + 1):
                    if j + m <= len(doc) and doc[j + m - 1] == part[-1] and edit(part, doc[j : j + m]) <= k:
                        return True
    return False


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["Hello World", "a1-b2", "ÄÖ x_y", "", "12 ab\n"])), min_size=1, max_size=6))
def test_word_hashes_tell_words_apart(texts):
    data = "".join(texts).encode()
    if not data:
        return
    starts = np.cumsum([0, *(len(t.encode()) for t in texts[:-1])])
    h, at = lk.word_hashes(np.frombuffer(data, np.uint8), starts)
    want = [w for t in texts for w in words(t)]
    assert len(h) == len(want)
    seen = {}
    for w, x in zip(want, h, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width", [1, 2, 5, 6, 7, 20])
def test_simhash_is_the_bitwise_majority(width):
    h = np.random.default_rng(0).integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    got = lk.simhashes(h, width)
    for i in range(len(h) - width + 1):
        bits = [sum(int(x) >> b & 1 for x in h[i : i + width]) for b in range(64)]
        assert int(got[i]) == sum(1 << b for b in range(64) if bits[b] > width / 2)
    assert len(lk.simhashes(h[: width - 1], width)) == 0


def test_blocks_miss_nothing_within_the_radius(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(WORDS[i % 400] for i in rng.integers(0, 400, 200))
    index = lk.build_index([(1, text)], 20, 0.1, 3)
    flips = rng.integers(0, 64, (len(index.prints), 3))
    near = index.prints.copy()
    for k in range(3):
        near ^= np.uint64(1) << flips[:, k].astype(np.uint64)
    found = [(int(p), int(i)) for pos, item in lk.hits(near, index) for p, i in zip(pos, item, strict=True)]
    assert set(range(len(near))) == {p for p, i in found if p == i}
    parts = lk.PAIRS
    monkeypatch.setattr(lk, "PAIRS", 7)
    assert {(int(p), int(i)) for pos, item in lk.hits(near, index) for p, i in zip(pos, item, strict=True)} == set(found) and parts > 7


def test_seed_words():
    assert lk.seed_words(20, 0.1) == 6 and lk.seed_words(20, 0.0) == 20 and lk.seed_words(10, 0.1) == 5


def planted(rng, item, n, edits):
    at = rng.randrange(len(item) - n + 1)
    part = item[at : at + n]
    for _ in range(edits):
        i, how = rng.randrange(1, len(part) - 1), rng.randrange(3)
        part = part[:i] + ([["zz"], [], ["zz", part[i]]][how]) + part[i + 1 :]
    return part


def test_rule_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, [rng.choice(WORDS) for _ in range(45)]) for k in range(4)]
    docs = []
    for d in range(60):
        noise = lambda: [rng.choice(WORDS) for _ in range(rng.randrange(12))]
        body = noise() + planted(rng, items[d % 4][1], rng.choice([14, 18, 19, 20, 21, 25, 30, 40]), rng.choice([0, 1, 2, 3, 4])) + noise()
        docs.append((d, body))
    df = spark.createDataFrame([(d, " ".join(w.upper() if i % 7 == 0 else w for i, w in enumerate(b)).replace(" ", ", "), "x") for d, b in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in lk.leaked(df, it).collect()}
    want = {(d, k) for d, b in docs for k, w in items if brute(b, w)}
    assert got == want and 10 < len(want) < 60


def test_edges(spark, monkeypatch):
    item = " ".join(WORDS[:30])
    it = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None), (None, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, "é " + item), (5, "ééé " * 50)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.words, r.similarity) for r in lk.leaked(docs, it).collect()), key=repr)
    assert got == [(3, 1, 30, 1.0), (None, 1, 30, 1.0)]
    assert lk.leaked(docs.limit(0), it).collect() == [] == lk.leaked(docs, it.limit(0)).collect()


def test_long_texts_in_pieces_and_items_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(30))) for k in range(5)]
    filler = " ".join(rng.choice(WORDS) for _ in range(3000))
    docs = [(k, filler[: 4000 * k] + " " + t + " " + filler) for k, (_, t) in enumerate(items)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lk, "MAX_WINDOWS", 100)
    assert sorted((r.doc_id, r.item_id) for r in lk.leaked(*args).collect()) == [(k, k) for k in range(5)]
    monkeypatch.setattr(lk, "CHUNK", 2000)
    monkeypatch.setattr(lk, "WORDS", 700)
    assert search(items, docs) == {(k, k): 30 for k in range(5)}


def search(items, docs):
    index = lk.build_index(items, 20, 0.1, 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    return {(r["doc_id"], r["item_id"]): r["words"] for b in lk._search(index, 20, 0.1)(iter([batch])) for r in b.to_pylist()}


def test_whatever_stands_between_the_words():
    """A passage in a text of 4 MB, its halves 300 KB of blanks apart, at the real constants."""
    part = WORDS[:20]
    text = "x " * 1_950_000 + " ".join(part[:10]) + " " * 300_000 + " ".join(part[10:]) + " y" * 50_000
    assert len(text) > 4 << 20
    assert search([(1, " ".join(part))], [(7, text)]) == {(7, 1): 20}
    one = "q" * (3 << 20)  # a single word beyond every piece
    assert search([(1, " ".join(part))], [(7, one + " " + " ".join(part) + " " + one)]) == {(7, 1): 20}


def test_items_of_any_length_are_reported_whole():
    rng = random.Random(3)
    body = [f"t{rng.randrange(10**6)}" for _ in range(40_000)]
    began = time.process_time()
    assert search([(1, " ".join(body))], [(2, " ".join(body))]) == {(2, 1): 40_000}
    part = body[:10_000]
    for k in range(15, 10_000, 40):
        part[k] = "zz"
    assert search([(1, " ".join(body[:10_000]))], [(2, " ".join(part))])[2, 1] > 9_900
    assert time.process_time() - began < 20
    assert search([(1, " ".join(body[:60]))], [(2, " ".join(body[:60] * 300))]) == {(2, 1): 60}


def test_no_admissible_stretch_fails_the_shingle_test():
    """Any stretch the rule admits has a window whose matched weight reaches the floor."""
    rng = random.Random(9)
    for _ in range(300):
        item = [rng.choice(WORDS[: rng.choice([5, 400])]) for _ in range(45)]
        n = rng.choice([20, 25, 30, 35, 40])
        body = [rng.choice(WORDS) for _ in range(5)] + planted(rng, item, n, rng.randrange(int(n * 0.1) + 1)) + [rng.choice(WORDS) for _ in range(5)]
        got = search([(1, " ".join(item)), (2, " ".join(rng.choice(WORDS) for _ in range(30)))], [(1, " ".join(body))])
        assert ((1, 1) in got) == brute(body, item), (item, body)
