"""Language identification: sums over all segmentations against enumeration, held-out accuracy, odd inputs."""

import numpy as np
import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import language, packing, queries  # noqa: E402

PATH = packing.vocabulary(language.VOCABULARY)


def enumerated(lattice, model, word):
    """Sum over every segmentation, one by one."""
    marked = language.START + word
    def sums(at):
        if at == len(marked):
            return np.ones(len(model))
        total = np.zeros(len(model))
        for _, b, ids in (a for a in lattice.arcs(word) if a[0] == at):
            total += np.exp(model[:, ids].sum(axis=1)) * sums(b)
        return total
    return np.log(sums(0))


@pytest.fixture(scope="module")
def fitted():
    lattice = language.Lattice(PATH)
    rng = np.random.default_rng(1)
    raw = rng.random((3, lattice.size)) + 0.01
    return lattice, np.log(raw / raw.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("word", ["a", "the", "straße", "niño", "日本", "ꙮ", "banana"])
def test_forward_sums_all_segmentations(fitted, word):
    lattice, model = fitted
    true = enumerated(lattice, model, word)
    assert np.allclose(lattice.score([word, "b", word], model)[2], true)
    prefixes = language.Prefixes(lattice, model)
    prefixes.learn([word, "b", word + "s"])
    assert np.allclose(prefixes.score(["b", word])[1], true)


def test_expected_counts_spell_the_word(fitted):
    lattice, model = fitted
    counts = lattice.expected(["banana", "the"], np.array([[2.0] * 3, [1.0] * 3]), model)
    length = np.zeros(lattice.size)
    for piece, i in lattice.index.items():
        length[i] = 1 if piece.startswith("<0x") else len(piece)
    assert np.allclose(counts @ length, 2 * 7 + 4)


def test_a_very_long_word_has_a_score(fitted):
    lattice, model = fitted
    prefixes = language.Prefixes(lattice, model)
    prefixes.learn(["ab" * 2000, "日本" * 10])
    assert np.isfinite(prefixes.score(["ab" * 2000, "日本" * 10])).all()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.segmentation_language(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out.keys() == truth.keys()
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].lang_pred == truth[i] for i in held) / len(held) > 0.98


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "der die das und", "de", "x"), (2, "the and of to", "en", "x"), (3, None, "en", "x"),
                                  (4, "12 !", None, "x"), (5, "", "de", "x"), (5, "und der", None, "x")],
                                 "doc_id long, text string, lang string, score string")
    langs, model = language.fit(docs, PATH)
    assert langs == ["de", "en"]
    out = sorted((r.doc_id, r.lang_pred) for r in language.predict(docs, langs, model, PATH).collect())
    assert out == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "de"), (5, "und")]
    none, nothing = language.fit(docs.limit(0), PATH)
    assert {r.lang_pred for r in language.predict(docs, none, nothing, PATH).collect()} == {"und"}


def test_a_rare_language_is_learnt_from_a_bounded_sample(spark):
    """One row of a third language among thousands, with a bound of ten rows a language."""
    rows = [(i, f"the and of to that with number {chr(97 + i % 26)}", "en") for i in range(2000)]
    rows += [(5000 + i, f"der die das und nicht mit nummer {chr(97 + i % 26)}", "de") for i in range(500)] + [(9999, "siamo andati questa notte", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.lang: r.n for r in language.sampled_by(docs, "lang", 10, "doc_id").groupBy("lang").agg({"*": "count"}).toDF("lang", "n").collect()}
    assert kept["it"] == 1 and set(kept) == {"en", "de", "it"}
    langs, model = language.fit(docs, PATH, rows=100)
    assert langs == ["de", "en", "it"]
    asked = spark.createDataFrame([(1, "questa notte"), (2, "und nicht"), (3, "that with")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in language.predict(asked, langs, model, PATH).collect()) == [(1, "it"), (2, "de"), (3, "en")]


def test_all_pieces_of_the_vocabulary_are_used(fitted):
    """A word that is one piece of over eight letters has that piece among its segmentations."""
    lattice, model = fitted
    long = max((p for p in lattice.index if p.startswith(language.START) and p[1:].isalpha()), key=len)
    assert len(long) > 9 and any(a == 0 and b == len(long) for a, b, _ in lattice.arcs(long[1:]))
    short = max((p for p in lattice.index if p.startswith(language.START) and p[1:].isalpha() and 9 < len(p) < 12), key=len)
    prefixes = language.Prefixes(lattice, model)
    prefixes.learn([short[1:]])
    assert np.allclose(prefixes.score([short[1:]])[0], enumerated(lattice, model, short[1:]))
