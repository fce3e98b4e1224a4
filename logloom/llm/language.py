"""Missing or wrong language labels: languages of documents and of their text cells, by a mixture model.

A document is a mixture of languages.  Its prose is cut into sentences; each
sentence has a likelihood under every language from character n-grams.
Expectation-maximisation estimates the document's language proportions; then
languages are struck out one by one while that raises the likelihood less a
penalty per language (a small language set explains the text unless a further
language really earns its place).  A cell's language is that of most of its prose
under the final responsibilities, its confidence their share; likewise for the document.

The n-gram model is fitted on all labelled samples and then once more on all
labelled documents, taking only cells where label and first model agree.  What such cells
score per letter under a model fitted on the other half of the documents sets the level
below which a text is in none of the known languages: its language is ``und``.
The corpus is read twice, as no cell can be scored before all are counted: one pass counts,
the other labels and scores.  It is never shuffled; the models (``BUCKETS`` by languages)
travel, and the labels are kept in a checkpoint until the levels are known.

Texts are lower-cased and stripped of accents (composed, decomposed or missing
accents thus count the same); fenced and inline code, formulas, links and tags
are no prose.

Defined cases: null or empty texts and documents without cells have no language
(null, confidence 0); cells beyond the text are cut to it; null entries in the
cell list, null offsets and kinds are skipped; a cell without words has no
language; a label that is null, empty or names no natural language is missing;
repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import checkpointed, spread

BUCKETS = 1 << 16
#: Letters a cell must have to tell what texts score, share of such cells that may lie below the level, and its distance from them.
TELLING, RARE, MARGIN = 60, 0.001, 0.4
#: Scores are counted in steps of this, so that what the driver gets does not grow with the corpus.
STEP = 1e-4
#: Confirmed cells a language needs, or nothing is known of what its texts score and it has no level.
LEAST_CELLS = 30
UNKNOWN = "und"

#: Letters in a sentence before it is cut, and letters whose n-grams are made at once.
LONG, CHUNK = 2000, 1 << 20

#: Two-letter codes of ISO 639-1.
CODES = set(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
#: English names and three-letter codes of the languages most often named.
NAMES = {
    "en": "english eng", "de": "german deu ger", "fr": "french fra fre", "es": "spanish spa castilian", "pt": "portuguese por", "it": "italian ita",
    "nl": "dutch nld dut flemish", "ru": "russian rus", "ja": "japanese jpn", "zh": "chinese zho chi mandarin cmn", "ko": "korean kor", "ar": "arabic ara",
    "pl": "polish pol", "cs": "czech ces cze", "sv": "swedish swe", "da": "danish dan", "no": "norwegian nor", "fi": "finnish fin", "el": "greek ell gre",
    "tr": "turkish tur", "uk": "ukrainian ukr", "hu": "hungarian hun", "ro": "romanian ron rum", "he": "hebrew heb", "hi": "hindi hin", "vi": "vietnamese vie",
    "th": "thai tha", "id": "indonesian ind", "ca": "catalan cat", "la": "latin lat", "fa": "persian fas per farsi", "bg": "bulgarian bul", "hr": "croatian hrv", "sr": "serbian srp",
}
_BY_NAME = {n: k for k, v in NAMES.items() for n in v.split()}

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_NOT_PROSE = re.compile(r"(?s)\$\$.*?\$\$|`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|<[^<>\n]{1,400}>|\([^()\n]*\(\)\)|\\[a-zA-Z]+|[A-Za-z0-9.]*[_/\\][A-Za-z0-9_/\\.]*")
_STOP = re.compile(r"[.!?。！？]+[\s\"'»”)]*|\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts without word spaces say in one letter what takes alphabets some three.
_DENSE = re.compile(r"[\u3041-\u30ff\u3400-\u9fff\uac00-\ud7af]")
DENSE_LETTERS = 2.5


def canonical(label: str | None) -> str | None:
    """ISO 639-1 code named by a label in any spelling, or None where it names no natural language."""
    if not label:
        return None
    base = re.split(r"[-_ (]", label.strip().lower(), maxsplit=1)[0]
    return _BY_NAME.get(base) or (base if base in CODES else None)


def fold(text: str) -> str:
    """Lower case without accents, letters only, one space between and around words."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return f" {' '.join(_WORD.findall(text.lower()))} "


def prose(cell: str) -> str:
    return _NOT_PROSE.sub(" ", _FENCE.sub("\n", cell))


def sentences(cell: str) -> list[str]:
    """Folded sentences that hold words."""
    out = []
    for s in _STOP.split(prose(cell)):
        for at in range(0, len(s or ""), LONG):
            part = s[at : at + LONG]
            if any(len(w) > 1 for w in _WORD.findall(part)):
                out.append(fold(part))
    return out


def amount(sentence: str) -> float:
    """How much prose a folded sentence is, in letters of an alphabet."""
    return len(sentence.replace(" ", "")) + (0 if sentence.isascii() else (DENSE_LETTERS - 1) * len(_DENSE.findall(sentence)))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 2-, 3- and 4-gram of all texts, and the text it belongs to; no gram crosses texts."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = code * np.uint64(0x9E3779B97F4A7C15)
        for n in (2, 3, 4):
            if len(code) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * np.uint64(0x94D049BB133111EB)
            same = owner[: len(h)] == owner[n - 1 :]
            buckets.append(((h >> np.uint64(40)) % np.uint64(BUCKETS))[same].astype(np.int32))
            owners.append(owner[: len(h)][same])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, int)
    return np.concatenate(buckets), np.concatenate(owners)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` letters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _summed(texts: list[str], weights: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """Sums over the grams of each text of the ``width`` weights that are given for (buckets, texts they belong to).

    A letter takes part in three grams of each length, so a third of the sum is taken for the text's.
    """
    out = np.zeros((len(texts), width))
    for a, b in _chunks(texts):
        bucket, owner = _grams(texts[a:b])
        if not len(bucket):
            continue
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])  # owners ascend within each length of grams
        for j, w in enumerate(weights(bucket, owner + a)):
            out[a:b, j] = np.bincount(owner[head], np.add.reduceat(w, head), b - a)
    return out / 6


def count_grams(texts: list[str]) -> np.ndarray:
    total = np.zeros(BUCKETS, int)
    for a, b in _chunks(texts):
        total += np.bincount(_grams(texts[a:b])[0], minlength=BUCKETS)
    return total


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log likelihood of a bucket, by language

    @staticmethod
    def fit(counts: dict[str, np.ndarray], smooth: float = 0.5) -> Model:
        """Smoothed towards the mean of all languages, so that a bucket no language has seen decides nothing."""
        langs = sorted(counts)
        share = np.stack([counts[g] / max(counts[g].sum(), 1) for g in langs], 1)
        prior = (share.mean(1, keepdims=True) + 1e-7) / (1 + 1e-7 * BUCKETS)
        total = np.array([counts[g].sum() for g in langs])
        mass = smooth * 2000
        table = np.log((share * total + mass * prior) / (total + mass)) - np.log(prior)
        return Model(langs, table.astype(np.float32))

    def weights(self) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
        """Log likelihoods of buckets, language after language."""
        columns = np.ascontiguousarray(self.table.T, float)
        return lambda bucket: (c[bucket] for c in columns)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log likelihood ratio of each text under each language."""
        own = self.weights()
        return _summed(texts, lambda bucket, _: own(bucket), len(self.langs))


def mixtures(like: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = 3.0, rounds: int = 6) -> np.ndarray:
    """Responsibilities of the languages for each sentence, after EM and the choice of the language set per document.

    ``doc`` is ascending.  Struck-out languages have responsibility 0.
    """
    n_lang = like.shape[1]
    if not len(doc):
        return np.zeros((0, n_lang))
    scaled = np.exp(np.maximum(like - like.max(1, keepdims=True), -60))
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ids = doc[head]
    row = np.repeat(np.arange(len(ids)), np.diff(np.r_[head, len(doc)]))
    weight = np.add.reduceat(size.astype(float), head)
    alive = np.ones((len(ids), n_lang))

    def settle(alive: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = scaled * share[row]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            share = np.add.reduceat(r * size[:, None], head) / weight[:, None]
            share = (share + 1e-3) * alive
            share /= share.sum(1, keepdims=True)
        return r, share

    r, share = settle(alive, alive / n_lang)
    for _ in range(n_lang - 1):
        mix = scaled * share[row]
        whole = mix.sum(1, keepdims=True)
        without = np.maximum(whole - mix, 1e-300) / np.maximum(1 - share[row], 1e-6)
        loss = np.add.reduceat(np.log(np.maximum(whole, 1e-300)) - np.log(without), head)
        loss[alive == 0] = np.inf
        worst = loss.argmin(1)
        drop = (loss[np.arange(len(ids)), worst] < penalty) & (alive.sum(1) > 1)
        if not drop.any():
            break
        alive[drop, worst[drop]] = 0
        share = share * alive
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        r, share = settle(alive, share)
    return r


def _split(b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, list[list[int]]]:
    """(sentences, document of each, cell of each, numbers of the text cells per document)."""
    texts, cells = b.column("text").to_pylist(), b.column("cells").to_pylist()
    sent: list[str] = []
    doc: list[int] = []
    cell: list[int] = []
    numbers: list[list[int]] = []
    for d, (t, cs) in enumerate(zip(texts, cells, strict=True)):
        nos: list[int] = []
        for c in cs or []:
            if t is None or c is None or c["char_start"] is None or c["char_len"] is None:
                continue
            a = max(c["char_start"], 0)
            got = sentences(t[a : a + max(c["char_len"], 0)])
            sent += got
            doc += [d] * len(got)
            cell += [len(nos)] * len(got)
            nos.append(c["cell_no"])
        numbers.append(nos)
    return sent, np.array(doc, int), np.array(cell, int), numbers


_SPANS = pa.list_(pa.struct([("cell_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("score", pa.float64())]))
_TOLD = pa.struct([("lang", pa.int32()), ("step", pa.int32())])


def _label(model: Model, first: Model, halves: list[Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Labels with their scores per letter; ``told`` is what the document's confirmed cells score under the model of the other fold."""
    n_lang = len(model.langs)
    number = {g: k for k, g in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final, sure = model.weights(), first.weights()
        # A cell of fold 0 is scored by the model of fold 1, and the other way round.
        other = np.stack([halves[1].table, halves[0].table]).astype(float)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                sent, doc, cell, numbers = _split(b)
                said = [canonical(x) for x in b.column("lang").to_pylist()]
                stated = np.array([number.get(g, -1) for g in said], int)
                side, own = b.column("fold").to_numpy()[doc], stated[doc]

                def weights(bucket: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
                    yield from final(bucket)
                    yield from sure(bucket)
                    yield other[side[owner], bucket, own[owner]]

                sums = _summed(sent, weights, 2 * n_lang + 1)
                like, before, cross = sums[:, :n_lang], sums[:, n_lang:-1], sums[:, -1]
                size = np.array([amount(s) for s in sent], float)
                r = mixtures(like, size, doc, b.num_rows) if sent else like
                votes = r * size[:, None] if len(r) else r
                start = np.cumsum([0, *map(len, numbers)])
                at = start[doc] + cell if len(doc) else np.empty(0, int)
                letters = np.array([len(s) for s in sent], float)

                def by(key: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
                    return np.stack([np.bincount(key, v[:, j], n) for j in range(n_lang)], 1) if len(key) else np.zeros((n, n_lang))

                def best(key: np.ndarray, n: int) -> tuple[list[str | None], list[float], list[int], list[float]]:
                    """Language, confidence, letters, and score per letter of what is taken for the language, under it."""
                    v = by(key, votes, n)
                    total, top = v.sum(1), v.argmax(1)
                    score = by(key, r * like, n) / np.maximum(by(key, r * letters[:, None], n), 1e-9)
                    return [model.langs[k] if t > 0 else None for k, t in zip(top, total, strict=True)], np.where(total > 0, v.max(1) / np.maximum(total, 1e-12), 0.0).tolist(), [round(x) for x in total], score[np.arange(n), top].tolist()

                cl, cc, cn, cs = best(at, int(start[-1]))
                dl, dc, _, ds = best(doc, b.num_rows)
                spans = [[{"cell_no": no, "lang": cl[k], "confidence": cc[k], "letters": cn[k], "score": cs[k]} for no, k in zip(nos, range(start[d], start[d + 1]), strict=True)] for d, nos in enumerate(numbers)]

                owner = np.repeat(np.arange(b.num_rows), np.diff(start))
                long = np.bincount(at, letters, start[-1])
                tell = (by(at, before, int(start[-1])).argmax(1) == stated[owner]) & (long >= TELLING)
                step = np.floor(np.bincount(at, cross, start[-1])[tell] / long[tell] / STEP).astype(np.int32)
                heads = np.cumsum(np.r_[0, np.bincount(owner[tell], minlength=b.num_rows)]).astype(np.int32)
                told = pa.ListArray.from_arrays(pa.array(heads), pa.StructArray.from_arrays([pa.array(stated[owner[tell]], pa.int32()), pa.array(step)], fields=list(_TOLD)))
                columns = [b.column("doc_id"), pa.array(said, pa.string()), pa.array(dl, pa.string()), pa.array(dc, pa.float64()), pa.array(ds, pa.float64()), pa.array(spans, _SPANS), told]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "lang", "confidence", "score", "cells", "told"])

    return run


def _confirmed(model: Model, b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(sentences, cell of each, language of each cell or -1, fold of each cell): cells whose label the model confirms have a language."""
    sent, doc, cell, _ = _split(b)
    if not sent:
        return sent, np.empty(0, int), np.empty(0, int), np.empty(0, int)
    key, at = np.unique(np.stack([doc, cell]), axis=1, return_inverse=True)
    like = model.likelihoods(sent)
    mean = np.stack([np.bincount(at.ravel(), like[:, j]) for j in range(like.shape[1])], 1)
    said = [canonical(x) for x in b.column("lang").to_pylist()]
    guess = mean.argmax(1)
    right = np.array([model.langs[g] == said[d] for g, d in zip(guess, key[0], strict=True)])
    return sent, at.ravel(), np.where(right, guess, -1), b.column("fold").to_numpy()[key[0]]


_COUNTS = "fold int, lang string, bucket int, n bigint"


def _sparse(total: dict[tuple[int, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (f, g), c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.int32()), pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["fold", "lang", "bucket", "n"])


def _totals(rows: DataFrame) -> dict[tuple[int, str], np.ndarray]:
    """n-gram counts by fold and language, summed over all tasks; at most ``BUCKETS`` rows of each come to the driver."""
    got = rows.groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for f, g in (x.values() for x in got.group_by(["fold", "lang"]).aggregate([]).to_pylist()):
        part = got.filter(pc.and_(pc.equal(got.column("lang"), g), pc.equal(got.column("fold"), f)))
        out[f, g] = np.zeros(BUCKETS, int)
        out[f, g][part.column("bucket").to_numpy()] = part.column("n").to_numpy()
    return out


def _agreeing(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n-gram counts per fold and language of the cells whose label the first model confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for b in batches:
            sent, at, lang, fold = _confirmed(model, b)
            grouped: dict[tuple[int, str], list[str]] = {}
            for k, s in zip(at, sent, strict=True):
                if lang[k] >= 0:
                    grouped.setdefault((int(fold[k]), model.langs[lang[k]]), []).append(s)
            for g, texts in grouped.items():
                total[g] = total.get(g, 0) + count_grams(texts)
        yield from _sparse(total)

    return run


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language of labelled samples."""
    total: dict[tuple[int, str], np.ndarray] = {}
    for b in batches:
        grouped: dict[str, list[str]] = {}
        for label, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if canonical(label) and text:
                grouped.setdefault(canonical(label), []).extend(sentences(text))
        for g, texts in grouped.items():
            if texts:
                total[0, g] = total.get((0, g), 0) + count_grams(texts)
    yield from _sparse(total)


def _source(docs: DataFrame) -> DataFrame:
    """What the passes read: of the cells only the text cells; ``fold`` is the half of the documents each is in, by a hash of its id."""
    fold = F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(2)).cast("int").alias("fold")
    return spread(docs.select(fold, "doc_id", "lang", "text", F.expr("filter(cells, c -> c.kind = 'text')").alias("cells")))


def sample_counts(samples: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts per language of all labelled samples."""
    return {g: c for (_, g), c in _totals(spread(samples.select("lang", "text")).mapInArrow(_said, _COUNTS)).items()}


def adapted(counts: dict[str, np.ndarray], docs: DataFrame) -> tuple[Model, Model, list[Model]]:
    """The samples' model, the model fitted again with the agreeing cells of all documents, and such models of either half of them.

    Only sums per fold, language and bucket come to the driver, whatever the number of documents.
    """
    first = Model.fit(counts)
    got = _totals(_source(docs).mapInArrow(_agreeing(first), _COUNTS))
    halves = [{g: c + got.get((f, g), 0) for g, c in counts.items()} for f in range(2)]
    return first, Model.fit({g: halves[0][g] + halves[1][g] - c for g, c in counts.items()}), [Model.fit(h) for h in halves]


def levels(told: DataFrame, langs: list[str]) -> dict[str, float]:
    """Score per letter below which a text is not in a language, from the ``(lang, step)`` of all cells that tell."""
    got = told.groupBy("lang", "step").count().toArrow()
    lang, step, n = (got.column(c).to_numpy() for c in ("lang", "step", "count"))
    out = {}
    for k, g in enumerate(langs):
        own = np.flatnonzero(lang == k)
        own = own[step[own].argsort()]
        upto = n[own].cumsum()
        if len(own) and upto[-1] >= LEAST_CELLS:
            place = RARE * (upto[-1] - 1)
            low, high = (step[own][upto.searchsorted(int(x), "right")] * STEP for x in (np.floor(place), np.ceil(place)))
            out[g] = float(low + (place - np.floor(place)) * (high - low) - MARGIN)
    return out


def label_languages(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """``(doc_id, label, lang, confidence, cells)``; ``label`` is the stated language as a code, ``cells`` has one
    ``(cell_no, lang, confidence, letters)`` per text cell.
    """
    counts = sample_counts(samples)
    if not counts:
        raise ValueError("the labelled samples hold no language")
    first, model, halves = adapted(counts, docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, label string, lang string, confidence double, score double, cells array<struct<cell_no: bigint, lang: string, confidence: double, letters: bigint, score: double>>, told array<struct<lang: int, step: int>>"
    scored = checkpointed(_source(docs).mapInArrow(_label(model, first, halves), out))
    level = levels(scored.select(F.inline("told")), model.langs)
    floor = F.create_map(*[F.lit(x) for item in level.items() for x in item]) if level else F.lit(None).cast("map<string,double>")
    known = lambda lang, score: F.when(score < F.element_at(floor, lang), UNKNOWN).otherwise(lang)
    cells = F.transform("cells", lambda c: F.struct(c["cell_no"].alias("cell_no"), known(c["lang"], c["score"]).alias("lang"), c["confidence"].alias("confidence"), c["letters"].alias("letters")))
    return scored.select("doc_id", "label", known(F.col("lang"), F.col("score")).alias("lang"), "confidence", cells.alias("cells"))


def corrections(labelled: DataFrame) -> DataFrame:
    """``(doc_id, cell_no, lang, confidence)`` of the documents (``cell_no`` -1) and text cells whose label is missing or another language; texts in no known language correct nothing."""
    wrong = lambda c: c.isNotNull() & (c != UNKNOWN) & (F.col("label").isNull() | (F.col("label") != c))
    whole = F.array(F.struct(F.lit(-1).cast("bigint").alias("cell_no"), F.col("lang"), F.col("confidence")))
    cells = F.transform("cells", lambda c: F.struct(c["cell_no"].alias("cell_no"), c["lang"].alias("lang"), c["confidence"].alias("confidence")))
    rows = labelled.select("doc_id", "label", F.explode(F.concat(whole, F.coalesce(cells, F.array().cast(labelled.select(cells.alias("x")).schema["x"].dataType)))).alias("x")).select("doc_id", "label", "x.*")
    return rows.where(wrong(F.col("lang"))).select("doc_id", "cell_no", "lang", "confidence")
