"""Evaluation texts leaking into training text.

A document leaks an item if it holds a stretch of at least ``min_words``
successive words of the item in which at most one word in ``1 / edit_rate``
differs, is missing or is added.

1. SimHash windows.  Every window of words of every document gets a 64-bit
   fingerprint: the bitwise majority of its words' hashes, computed for all
   windows at once with bit-sliced counters.  The window is sized to the piece
   of an item that must survive: ``k`` edits cut a stretch of ``n`` words into
   ``k + 1`` pieces, so one of ``(n - k) / (k + 1)`` words is left whole; for 20 words
   and one in ten that is 6.  (Fingerprints of whole 20-word windows with two
   edits lie about 9 bits apart, up to 18; blocks that guarantee such a radius in 64
   bits have 3 bits and select nothing.)
2. Multi-index Hamming blocks.  ``radius + 1`` blocks of the fingerprint are
   looked up in tables of the items' windows; any two fingerprints within
   ``radius`` agree in one block, so none is missed.
3. Weighted shingles.  Around each hit the item's shingles of ``SHINGLE`` words,
   weighted by their rarity among the items, are looked up in the words of the
   document.  An edit breaks at most ``SHINGLE`` successive ones, so a window of
   ``min_words`` words whose matched weight is below its whole weight less what its
   edits can break at most (the q-gram lemma, with weights) holds no leak.
4. Alignment.  What passes is aligned exactly on the few diagonals that it can
   reach.  Every admissible stretch of any length contains one of at most
   ``2 * min_words / (1 - edit_rate)`` words (cut a longer one between two matching
   words so that both sides keep ``min_words``; one side is admissible again), so the
   edits, the diagonals and the words looked at around a hit are bounded however
   long item and document are.

The corpus is read once, in parallel, and never shuffled; only the items'
windows travel, in blocks of at most ``MAX_WINDOWS`` whose size is checked.

Words are runs of ASCII letters and digits, in lower case.  Defined cases: null
and empty texts, and items of fewer than ``min_words`` words, match nothing; a
null id is an id like any other; repeated documents and items give one row per
id pair; texts of any length are searched as one sequence of words, whatever stands
between them; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import spread

#: Bytes of text whose words are hashed at once, and words whose windows are looked up at once.
CHUNK, WORDS = 1 << 20, 1 << 20
#: Words of a shingle; pairs of windows looked at together; cells of the alignment table of a group of candidates.
SHINGLE, PAIRS, CELLS = 3, 1 << 21, 1 << 19
#: Item windows in one broadcast index (about 30 bytes each).
MAX_WINDOWS = 1_000_000

_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _i + 1
    _CODE[ord(chr(_c).upper())] = _i + 1
_P = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for k, b in (("p", _P), ("q", inv)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                _POW[k] = np.cumprod(a)
    return _POW["p"], _POW["q"]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte position of each word of ``data``; texts begin at ``starts`` and no word crosses into the next."""
    code = _CODE[data]
    inside = code > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code * p[: len(data)], out=total[1:])
        h = (total[b] - total[a]) * q[a]
    return _mix(h), a


def _add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced numbers, one per bit lane of 64."""
    out, carry = [], None
    for k in range(max(len(x), len(y))):
        a = x[k] if k < len(x) else None
        b = y[k] if k < len(y) else None
        if a is None or b is None:
            v = a if b is None else b
            if carry is None:
                out.append(v)
            else:
                out.append(v ^ carry)
                carry = v & carry
        elif carry is None:
            out.append(a ^ b)
            carry = a & b
        else:
            s = a ^ b
            out.append(s ^ carry)
            carry = (a & b) | (s & carry)
    if carry is not None:
        out.append(carry)
    return out


def simhashes(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each window of ``width`` successive words: bit ``j`` is set where more than half of the words set it."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size = [h], 1
    total: list[np.ndarray] | None = None
    at, rest = 0, width
    while rest:
        if rest & 1:
            part = [v[at : at + n] for v in power]
            total = part if total is None else _add(total, part)
            at += size
        rest >>= 1
        if rest:
            power = _add([v[:-size] for v in power], [v[size:] for v in power])
            size *= 2
    need = width // 2 + 1
    over = np.zeros(n, np.uint64)
    equal = np.full(n, ~np.uint64(0))
    for k in reversed(range(len(total))):
        if need >> k & 1:
            equal &= total[k]
        else:
            over |= equal & total[k]
            equal &= ~total[k]
    return over | equal


def seed_words(min_words: int, edit_rate: float) -> int:
    """Longest run of unedited words that every admissible stretch contains."""
    best = min_words
    for n in range(min_words, 20 * min_words):
        k = int(n * edit_rate + 1e-9)
        best = min(best, -(-(n - k) // (k + 1)))
    return max(best, 1)


@dataclass
class ItemIndex:
    """Items' words, and tables from each block of the fingerprint to the windows that have it."""

    ids: list
    words: list[np.ndarray]
    shingles: list[np.ndarray]
    weights: list[np.ndarray]
    floors: list[np.ndarray]
    width: int
    radius: int
    prints: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    shifts: list[tuple[int, int]]


def shingles(h: np.ndarray) -> np.ndarray:
    """Hash of each ``SHINGLE`` successive words."""
    n = len(h) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE if n > 0 else 0):
            out = _mix(out * _P + h[k : k + n])
    return out


def floors(weights: np.ndarray, min_words: int, edits: int) -> np.ndarray:
    """Per window of ``min_words`` words the weight of the shingles that so many edits leave whole at least."""
    m = min_words - SHINGLE + 1
    if m < 1:
        return np.zeros(len(weights) + SHINGLE - min_words)
    upto = np.cumsum(np.r_[0.0, weights])
    whole = upto[m:] - upto[:-m]
    run = upto[SHINGLE:] - upto[:-SHINGLE] if m >= SHINGLE else np.empty(0)
    worst = np.lib.stride_tricks.sliding_window_view(run, m - SHINGLE + 1).max(1) if len(run) else whole
    return whole - edits * worst - 1e-6


def build_index(items: list[tuple[object, str]], min_words: int, edit_rate: float, radius: int) -> ItemIndex:
    width = seed_words(min_words, edit_rate)
    ids, words = [], []
    for i, text in items:
        h = _long_hashes(np.frombuffer((text or "").encode(), np.uint8))
        if len(h) >= min_words:
            ids.append(i)
            words.append(h)
    shing = [shingles(h) for h in words]
    every = np.concatenate([np.unique(h) for h in shing]) if words else np.empty(0, np.uint64)
    value, count = np.unique(every, return_counts=True)
    rarity = np.log1p(len(words) / count) if len(words) else np.empty(0)
    weights = [rarity[np.searchsorted(value, h)] for h in shing]
    # The edits of a stretch of up to two lengths can all lie where any two windows overlap, hence one more than a window's own.
    low = [floors(w, min_words, int(min_words * edit_rate + 1e-9) + 1) for w in weights]
    parts = [simhashes(h, width) for h in words]
    prints = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.empty(0, int)
    start = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, int)
    blocks = radius + 1
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    shifts = [(a, min(b - a, 16)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    tables = []
    for a, bits in shifts:
        key = ((prints >> np.uint64(a)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(key, kind="stable").astype(np.int32)
        tables.append((np.searchsorted(key[order], np.arange((1 << bits) + 1)).astype(np.int32), order))
    return ItemIndex(ids, words, shing, weights, low, width, radius, prints, owner, start, tables, shifts)


def hits(prints: np.ndarray, index: ItemIndex) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (window, item window) within the radius, some at a time; a pair may come up once per block."""
    for (a, bits), (offset, order) in zip(index.shifts, index.tables, strict=True):
        key = ((prints >> np.uint64(a)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        count = offset[key + 1] - offset[key]
        every = np.flatnonzero(count)
        cut = np.searchsorted(np.cumsum(count[every], dtype=np.int64), np.arange(PAIRS, int(count.sum(dtype=np.int64)) + PAIRS, PAIRS), "right")
        edges = np.r_[0, cut]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = every[lo:hi]
            n = count[at]
            pos = np.repeat(at, n)
            inner = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
            item = order[np.repeat(offset[key[at]], n) + inner]
            near = np.bitwise_count(prints[pos] ^ index.prints[item]) <= index.radius
            yield pos[near], item[near]


@dataclass
class Candidate:
    """A stretch of an item against the document words on the diagonals around its hits."""

    pair: tuple[int, int]  # row and item
    lo: int
    hi: int
    words: np.ndarray  # of the document, from diagonal `low` on; 0 outside of the text
    seeds: int


@dataclass
class Found:
    """What of an item is known to stand in a document: words in admissible stretches, and shingles."""

    covered: np.ndarray
    matched: np.ndarray


def most_edits(min_words: int, edit_rate: float) -> tuple[int, int]:
    """(edits, words) of the longest stretch that may contain no shorter admissible one."""
    longest = int(2 * min_words / (1 - edit_rate) + 1e-9)
    return int(longest * edit_rate + 1e-9), longest


def admissible(cands: list[Candidate], index: ItemIndex, min_words: int, edit_rate: float) -> list[np.ndarray]:
    """Per candidate a mask of its item words that lie in a stretch of at most ``most_edits`` edits that fulfils the rule.

    Exact alignment of all candidates at once.  ``best[c, k, d]`` is the most item words on an alignment that begins
    with a match, has ``k`` edits and ends on diagonal ``d``; for equal edits more words are never worse.  An irreducible stretch
    contains an unedited window, hence a hit, and leaves its diagonal by at most its edits, so the band holds it whole.
    """
    most = most_edits(min_words, edit_rate)[0]
    band = 2 * most + 1
    n = np.array([c.hi - c.lo for c in cands])
    longest = int(n.max())
    doc = np.zeros((len(cands), longest + band - 1), np.uint64)
    item = np.ones((len(cands), longest), np.uint64)
    for k, c in enumerate(cands):
        doc[k, : len(c.words)] = c.words
        item[k, : n[k]] = index.words[c.pair[1]][c.lo : c.hi]
    low = np.int32(-(1 << 30))
    best = np.full((len(cands), most + 1, band), low, np.int32)
    price = np.ceil(np.arange(most + 1) / edit_rate - 1e-9) if edit_rate else np.zeros(1)
    limit = np.maximum(price, min_words).astype(np.int32)
    change = np.zeros((len(cands), longest + 1), np.int32)
    for i in range(longest):
        same = (doc[:, i : i + band] == item[:, i : i + 1])[:, None, :]
        cur = np.where(same, best + 1, low)
        np.maximum(cur[:, 0], np.where(same[:, 0], 1, low), out=cur[:, 0])
        if i >= min_words - 1:
            reach = cur.max(2)
            ok = reach >= limit
            if ok.any():
                length = np.where(ok, reach, 0).max(1)
                at = np.flatnonzero(length)
                change[at, i + 1 - length[at]] += 1
                change[at, i + 1] -= 1
        if most:
            np.maximum(cur[:, 1:], best[:, :-1] + 1, out=cur[:, 1:])  # another word
            np.maximum(cur[:, 1:, :-1], best[:, :-1, 1:] + 1, out=cur[:, 1:, :-1])  # a missing word
            for k in range(1, most + 1):  # an added word
                np.maximum(cur[:, k, 1:], cur[:, k - 1, :-1], out=cur[:, k, 1:])
        best = cur
    inside = np.cumsum(change, 1) > 0
    return [inside[k, : n[k]] for k in range(len(cands))]


def shared(c: Candidate, index: ItemIndex) -> np.ndarray:
    """Mask of the shingles of the candidate's item words that stand in its document words."""
    return np.isin(index.shingles[c.pair[1]][c.lo : c.hi - SHINGLE + 1], shingles(c.words))


def similar(c: Candidate, matched: np.ndarray, index: ItemIndex, min_words: int) -> bool:
    """Whether some window of ``min_words`` item words has the weight of shingles that every admissible stretch has."""
    if min_words < SHINGLE:
        return True
    got = np.cumsum(np.r_[0.0, index.weights[c.pair[1]][c.lo : c.hi - SHINGLE + 1] * matched])
    m = min_words - SHINGLE + 1
    return bool((got[m:] - got[:-m] >= index.floors[c.pair[1]][c.lo : c.hi - min_words + 1]).any())


def _long_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all words of one text, made piece by piece; pieces end between words."""
    out, a = [], 0
    while a < len(data):
        z = min(a + CHUNK, len(data))
        while z < len(data):
            gap = np.flatnonzero(_CODE[data[z : z + CHUNK]] == 0)
            if len(gap):
                z += int(gap[0])
                break
            z = min(z + CHUNK, len(data))
        out.append(word_hashes(data[a:z], np.zeros(1, int))[0])
        a = z
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _words(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, their texts' numbers, rows of these texts) of stretches of whole texts of about CHUNK bytes."""
    text = b.column(1).cast(pa.large_string())
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1)
        part = data[off[row] : off[end]]
        if len(part) > CHUNK:
            h = _long_hashes(part)
            yield h, np.zeros(len(h), np.int64), np.array([row])
        elif len(part):
            starts = off[row:end] - off[row]
            h, at = word_hashes(part, starts)
            yield h, np.searchsorted(starts, at, "right") - 1, np.arange(row, end)
        row = end


def _seeds(h: np.ndarray, text: np.ndarray, index: ItemIndex) -> np.ndarray:
    """Distinct (text, item, diagonal, first item word) of all hits, ascending."""
    out = []
    for a in range(0, len(h) - index.width + 1, WORDS):
        for pos, win in hits(simhashes(h[a : a + WORDS + index.width - 1], index.width), index):
            pos = pos + a
            inside = text[pos] == text[pos + index.width - 1]
            pos, win = pos[inside], win[inside]
            if len(pos):
                out.append(np.unique(np.stack([text[pos], index.owner[win], pos - index.start[win], index.start[win]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 4), int)


def _candidates(b: pa.RecordBatch, index: ItemIndex, min_words: int, edit_rate: float) -> Iterator[list[Candidate]]:
    """Candidates of some whole texts at a time: hits of one diagonal whose surroundings meet are one candidate."""
    most, reach = most_edits(min_words, edit_rate)
    for h, text, rows in _words(b):
        if len(h) < index.width:
            continue
        seeds = _seeds(h, text, index)
        if not len(seeds):
            continue
        new = np.ones(len(seeds), bool)
        new[1:] = (seeds[1:, :3] != seeds[:-1, :3]).any(1) | (seeds[1:, 3] - seeds[:-1, 3] > 2 * reach)
        head = np.flatnonzero(new)
        bounds = np.searchsorted(text, np.arange(len(rows) + 1))
        out = []
        for a, z in zip(head, np.r_[head[1:], len(seeds)], strict=True):
            t, i, diagonal = (int(v) for v in seeds[a, :3])
            lo, hi = max(int(seeds[a, 3]) - reach, 0), min(int(seeds[z - 1, 3]) + index.width + reach, len(index.words[i]))
            first = diagonal - most + lo
            words = np.zeros(hi - lo + 2 * most, np.uint64)
            x, y = max(first, int(bounds[t])), min(first + len(words), int(bounds[t + 1]))
            words[x - first : y - first] = h[x:y]
            out.append(Candidate((int(rows[t]), i), lo, hi, words, int(z - a)))
        yield out


def _groups(cands: list[Candidate], most: int) -> Iterator[list[Candidate]]:
    """Candidates of about equal length, together of a bounded size."""
    group: list[Candidate] = []
    for c in sorted(cands, key=lambda c: c.hi - c.lo):
        group.append(c)
        if len(group) * (most + 1) * (2 * most + 1) + len(group) * (c.hi - c.lo) >= CELLS:
            yield group
            group = []
    if group:
        yield group


def _decide(cands: list[Candidate], index: ItemIndex, min_words: int, edit_rate: float) -> dict[tuple[int, int], Found]:
    """What of each item stands in each document."""
    most = most_edits(min_words, edit_rate)[0]
    found: dict[tuple[int, int], Found] = {}
    # The fullest candidate of a pair goes first: where it proves an exact copy, others over the same words can add nothing.
    order = sorted(cands, key=lambda c: (c.pair, -c.seeds))
    firsts = [c for k, c in enumerate(order) if not k or order[k - 1].pair != c.pair]
    others = [c for k, c in enumerate(order) if k and order[k - 1].pair == c.pair]
    for wave in (firsts, others):
        for group in _groups(wave, most):
            open_ = []
            for c in group:
                f = found.get(c.pair)
                if f is not None and f.covered[c.lo : c.hi].all() and f.matched[c.lo : c.hi - SHINGLE + 1].all():
                    continue
                m = shared(c, index)
                if similar(c, m, index, min_words):
                    open_.append((c, m))
            if not open_:
                continue
            for (c, m), inside in zip(open_, admissible([c for c, _ in open_], index, min_words, edit_rate), strict=True):
                if inside.any():
                    n = len(index.words[c.pair[1]])
                    f = found.setdefault(c.pair, Found(np.zeros(n, bool), np.zeros(max(n - SHINGLE + 1, 0), bool)))
                    f.covered[c.lo : c.hi] |= inside
                    f.matched[c.lo : c.lo + len(m)] |= m
    return found


def similarity(f: Found, weights: np.ndarray) -> float:
    """Share of the covered words' shingles that stand in the document, by weight."""
    n = len(f.matched)
    inside = np.logical_and.reduce([f.covered[k : k + n] for k in range(SHINGLE)])
    return float(weights[inside & f.matched].sum() / weights[inside].sum()) if inside.any() else 1.0


def _search(index: ItemIndex, min_words: int, edit_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, float]] = []
            for cands in _candidates(b, index, min_words, edit_rate):
                out += [(*pair, int(f.covered.sum()), similarity(f, index.weights[pair[1]])) for pair, f in _decide(cands, index, min_words, edit_rate).items()]
            if out:
                row, item, words, sim = zip(*out, strict=True)
                ids = b.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in item], pa.int64()), pa.array(words, pa.int32()), pa.array(sim, pa.float64())], ["doc_id", "item_id", "words", "similarity"])

    return run


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = 20, edit_rate: float = 0.1, radius: int = 3) -> DataFrame:
    """``(doc_id, item_id, words, similarity)``: each document with each item of which it holds an admissible stretch.

    ``words`` counts the item's words in such stretches (of at most ``most_edits`` edits each), ``similarity`` is the weighted share
    of their shingles that the document has.  Of repeated document ids the row with the most words stands.
    ``items`` is a stated query set; it is read in blocks of at most ``MAX_WINDOWS`` windows, each block against all documents.
    """
    known = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t")).distinct()
    src = spread(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull() & (F.col("text") != "")))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id bigint, words int, similarity double"
    found: DataFrame | None = None

    def search(block: list[tuple[object, str]]) -> None:
        nonlocal found
        index = build_index(block, min_words, edit_rate, radius)
        part = src.mapInArrow(_search(index, min_words, edit_rate), schema)
        found = part if found is None else found.unionByName(part)

    block, size = [], 0
    for r in known.toLocalIterator():
        n = len(r.t) // 2 + 1  # no text has more words than that
        if block and size + n > MAX_WINDOWS:
            search(block)
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    search(block)
    best = F.max(F.struct("words", "similarity")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", "best.similarity")
