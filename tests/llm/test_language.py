import numpy as np
import pytest

from logloom.llm import language as lg

CELLS = "doc_id bigint, lang string, text string, cells array<struct<cell_no: int, kind: string, exec_count: int, char_start: int, char_len: int>>"


@pytest.mark.parametrize("label,want", [("en", "en"), ("EN", "en"), ("en-US", "en"), ("fr_FR", "fr"), ("German", "de"), ("deu", "de"), (" Portuguese ", "pt"), ("ja-JP", "ja"), ("zh", "zh"), ("code", None), ("python", None), ("und", None), ("n/a", None), ("", None), (None, None)])
def test_canonical(label, want):
    assert lg.canonical(label) == want


def test_folding_makes_accents_equal():
    assert lg.fold("Próxima célula") == lg.fold("Proxima celula") == lg.fold("Próxima célula") == " proxima celula "


def test_prose_leaves_out_what_is_no_language():
    assert lg.sentences("```python\nimport os\n```") == []
    assert lg.sentences("$$ v = \\frac{1}{2} $$") == [] == lg.sentences("![](1_2.png)") == lg.sentences("| 3 | 4 |\n|---|---|")
    assert lg.sentences("One two. Three `code_x` four!\n\n```\nopen fence words") == [" one two ", " three four "]
    assert lg.sentences("これはペンです(log_time)次の行です。") != []


@pytest.fixture(scope="module")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_samples.parquet").cache()


@pytest.fixture(scope="module")
def model(samples):
    return lg.Model.fit(lg.sample_counts(samples))


def test_held_out_samples(samples):
    rows = [r for r in samples.collect()]
    right = 0
    for fold in range(4):
        by = {}
        for k, r in enumerate(rows):
            if k % 4 != fold:
                by.setdefault(r.lang, []).extend(lg.sentences(r.text))
        m = lg.Model.fit({g: lg.count_grams(t) for g, t in by.items()})
        for k, r in enumerate(rows):
            if k % 4 == fold:
                right += m.langs[int(m.likelihoods([lg.fold(r.text)]).argmax())] == r.lang
    assert right >= 0.98 * len(rows)


def test_mixture_keeps_a_rare_language_and_drops_chance_ones(model):
    en = ["the log file compares the first ten lines", "our small script skips a short summary of the run", "the team reads the broken rows"] * 5
    de = ["jede nachricht zeigt die zeitstempel der kamera bevor die nächste zelle läuft"]
    sent = [lg.fold(x) for x in en + de]
    like, size = model.likelihoods(sent), np.array([float(len(s)) for s in sent])
    r = lg.mixtures(like, size, np.zeros(len(sent), int), 1)
    names = [model.langs[k] for k in r.argmax(1)]
    assert names == ["en"] * 15 + ["de"]
    assert {model.langs[k] for k in np.flatnonzero(r.sum(0) > 0)} == {"en", "de"}
    assert np.allclose(r.sum(1), 1)


def doc(i, label, *cells):
    text, spans = "", []
    for k, (kind, body) in enumerate(cells):
        spans.append((k, kind, None, len(text), len(body)))
        text += body + "\n\n"
    return i, label, text, spans


EN, DE, JA = "There are many messages in this file and the team reads all of them.", "Hier stehen viele Nachrichten, und die Gruppe liest sie alle vor dem Essen.", "この手順では、ログファイルは最初の十行を表示します。"


def test_documents_and_cells(spark, samples):
    docs = spark.createDataFrame(
        [
            doc(1, "English", ("text", EN), ("code", DE), ("text", DE)),
            doc(2, None, ("text", DE * 2), ("text", f"```\n{EN * 9}\n```\n{DE}"), ("text", "$$ x $$")),
            doc(3, "fr", ("text", JA), ("text", JA + '\n> "The team."')),
            doc(4, "de", ("code", EN)),
            (5, "en", None, [(0, "text", None, 0, 5)]),
            (6, "en", "", []),
            (7, "en", EN, None),
            (8, None, EN, [None, (3, "text", None, 0, 9999), (4, None, None, 0, 5), (5, "text", None, None, 5)]),
        ],
        CELLS,
    )
    labelled = lg.label_languages(docs, samples)
    got = {r.doc_id: (r.label, r.lang) for r in labelled.collect()}
    assert got == {1: ("en", got[1][1]), 2: (None, "de"), 3: ("fr", "ja"), 4: ("de", None), 5: ("en", None), 6: ("en", None), 7: ("en", None), 8: (None, "en")}
    fixed = sorted((r.doc_id, r.cell_no, r.lang) for r in lg.corrections(labelled).collect() if r.doc_id != 1 or r.cell_no >= 0)
    assert fixed == [(1, 2, "de"), (2, -1, "de"), (2, 0, "de"), (2, 1, "de"), (3, -1, "ja"), (3, 0, "ja"), (3, 1, "ja"), (8, -1, "en"), (8, 3, "en")]
    assert all(0 <= r.confidence <= 1 for r in lg.corrections(labelled).collect())
    assert lg.label_languages(docs.limit(0), samples).collect() == []
    with pytest.raises(ValueError):
        lg.label_languages(docs, samples.limit(0))


def test_agreement_with_right_labels(spark, sf, samples):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [r for r in lg.label_languages(docs, samples).select("label", "lang").collect() if r.label and r.lang]
    assert sum(r.label == r.lang for r in got) > 0.8 * len(got)


def test_very_long_cells(spark, samples, monkeypatch):
    monkeypatch.setattr(lg, "CHUNK", 5000)
    long = "the reader shows the chart below and " * 20000
    assert sum(len(x.split()) for x in lg.sentences(long)) >= 7 * 20000
    docs = spark.createDataFrame([doc(1, "fr", ("text", long), ("text", DE))], CELLS)
    r = lg.label_languages(docs, samples).first()
    assert r.lang == "en" and [c.lang for c in r.cells] == ["en", "de"]


def test_languages_outside_the_samples_are_unknown(spark, samples):
    foreign = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    }
    own = spark.createDataFrame([doc(-1 - k, g, ("text", t), ("text", DE * 2)) for k, (g, t) in enumerate(foreign.items())], CELLS)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text", "cells")
    labelled = lg.label_languages(own.select(docs.columns).unionByName(docs), samples)
    got = {r.doc_id: r for r in labelled.collect()}
    for k in range(len(foreign)):
        assert [c.lang for c in got[-1 - k].cells] == ["und", "de"]
    rest = [c.lang for i, r in got.items() if i is not None and i >= 0 for c in r.cells if c.lang]
    assert sum(x == "und" for x in rest) < 0.002 * len(rest)
    assert lg.corrections(labelled).where("lang = 'und'").count() == 0


def test_confidence_is_the_share_of_the_language(spark, samples):
    """Texts put together from held-out samples of two languages: the language of most of the prose, and how much of it."""
    by = {}
    for r in sorted(samples.collect(), key=lambda r: r.sample_id):
        by.setdefault(lg.canonical(r.lang), []).append(r.text)
    langs = sorted(by)
    fit = spark.createDataFrame([(k, g, t) for g in langs for k, t in enumerate(by[g][::2])], "sample_id bigint, lang string, text string")
    held = {g: by[g][1::2] for g in langs}
    mixed, want = [], {}
    for k in range(150):
        a, b = langs[k % len(langs)], langs[(k * 4 + 1 + k // len(langs)) % len(langs)]
        first, second = held[a][k % len(held[a])] + "\n" + held[a][(k + 1) % len(held[a])], held[b][k % len(held[b])]
        size = [sum(lg.amount(s) for s in lg.sentences(t)) for t in (first, second)]
        if a != b and size[0] > 1.3 * size[1] > 0:
            mixed.append(doc(-1 - k, None, ("text", first + "\n" + second)))
            want[-1 - k] = a, size[0] / sum(size)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text", "cells")
    got = {r.doc_id: (r.lang, r.confidence) for r in lg.label_languages(spark.createDataFrame(mixed, CELLS).select(docs.columns).unionByName(docs), fit).where("doc_id < 0").collect()}
    assert len(want) > 50 and sum(got[k][0] == a for k, (a, _) in want.items()) >= 0.97 * len(want)
    off = [abs(got[k][1] - share) for k, (a, share) in want.items() if got[k][0] == a]
    assert sum(off) / len(off) < 0.06


def test_tables_of_many_files_are_adapted_as_one(spark, samples, tmp_path):
    foreign = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text", "cells").dropDuplicates(["doc_id"])
    docs = spark.createDataFrame([doc(-1, "pl", ("text", foreign), ("text", DE * 2))], CELLS).select(docs.columns).unionByName(docs)
    got = []
    for n in (1, 9):
        docs.repartition(n, "doc_id").write.parquet(path := str(tmp_path / str(n)))
        rows = lg.label_languages(spark.read.parquet(path), samples).collect()
        got.append({r.doc_id: (r.lang, [(c.cell_no, c.lang) for c in r.cells]) for r in rows})
    assert got[0] == got[1] and got[1][-1][1] == [(0, "und"), (1, "de")]


def test_model_counts_every_document(spark, samples):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text", "cells")
    counts = lg.sample_counts(samples)
    assert docs.count() > 9000
    first = lg.Model.fit(counts)
    want = {g: c.copy() for g, c in counts.items()}
    for b in lg._source(docs).toArrow().to_batches():
        sent, at, lang, _ = lg._confirmed(first, b)
        for k, g in enumerate(first.langs):
            want[g] += lg.count_grams([s for s, j in zip(sent, at, strict=True) if lang[j] == k])
    _, model, halves = lg.adapted(counts, docs)
    assert np.array_equal(model.table, lg.Model.fit(want).table)
    assert not np.array_equal(halves[0].table, halves[1].table)


def test_all_labelled_samples_count(spark):
    many = spark.range(51_000).selectExpr("id AS sample_id", "'en' AS lang", f"'{EN}' AS text").coalesce(1)
    last = spark.createDataFrame([(-1, "de", DE), (-2, "ja", JA)], many.schema)
    counts = lg.sample_counts(many.unionByName(last))
    assert sorted(counts) == ["de", "en", "ja"]
    assert np.array_equal(counts["en"], 51_000 * lg.count_grams(lg.sentences(EN)))


def test_levels_are_quantiles_of_all_scores(spark):
    rng = np.random.default_rng(3)
    steps = {0: rng.normal(9000, 2000, 4321).astype(int), 1: rng.integers(-5, 5, 5000), 2: rng.integers(0, 9, lg.LEAST_CELLS - 1)}
    told = spark.createDataFrame([(k, int(x)) for k, v in steps.items() for x in v], "lang int, step int")
    got = lg.levels(told, ["de", "en", "fr", "ja"])
    assert got == pytest.approx({g: np.quantile(steps[k] * lg.STEP, lg.RARE) - lg.MARGIN for k, g in enumerate(["de", "en"])})
