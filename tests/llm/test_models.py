"""Quality, language and toxicity: accuracy on rows that were not learned from, estimates against plain versions, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import chargrams, language, quality, toxicity
from palisade.llm.frames import held_out
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_folds(spark, awkward):
    for r in awkward.select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect():
        assert r["h"] == (brute.remainder(r["doc_id"], 5) == 0)


def test_character_grams():
    def plain(text, n):
        t = f" {text.lower()} "
        t = "".join(c if c.isalpha() else " " for c in t)
        grams = [t[i : i + n] for i in range(len(t) - n + 1)]
        return sum(" " not in g[1:-1] and (g.strip() != "" or n > 2) for g in grams)

    texts = ["Hello world", "", "a", "É1é  xyz", "日本語", "1 2 3"]
    for n in (1, 2, 3):
        for text, (columns, letters) in zip(texts, chargrams.grams(texts, (n,), 15)):
            assert len(columns) == plain(text, n)
            assert letters == sum(c.isalpha() for c in text.lower())
    alone = [c.tolist() for c, _ in chargrams.grams(["Hello world"], (1, 2, 3), 15)]
    assert [c.tolist() for c, _ in chargrams.grams(["x y", "Hello world"], (1, 2, 3), 15)][1:] == alone


def test_quality_against_labels(docs, labels):
    found = quality.classify(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in found}
    good, junk = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, True), 0) >= 0.99 * good and n.get((0, False), 0) >= 0.85 * junk


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.8
    rates = [(0.95, 0.9), (0.9, 0.8), (0.97, 0.7), (0.9, 0.85)]
    votes = np.array([np.where(truth, rng.random(len(truth)) < g, rng.random(len(truth)) >= b) for g, b in rates]).T.astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    for k, (g, b) in enumerate(rates):
        assert abs(model.tables[k, quality.GOOD, quality.GOOD] - g) < 0.03
        assert abs(model.tables[k, quality.BAD, quality.BAD] - b) < 0.05


def test_quality_edges(spark, awkward, no_documents):
    rows = {r["doc_id"]: r for r in quality.classify(awkward).collect()}
    assert all(not rows[i]["keep"] and rows[i]["score"] == 0 for i in (0, 1, 2))
    assert quality.classify(awkward).count() == awkward.count()
    assert quality.classify(no_documents).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    wanted = quality.classify(awkward).where("keep").count()
    assert kept.count() == wanted
    assert quality.keep_good(no_documents).count() == 0


def test_language_accuracy(spark, docs):
    found = language.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[0] > 0.98 and held[1] > 100


def test_language_ftrl_by_hand():
    """One step from zero weights is the closed form of the update."""
    model = language.Ftrl(3, 2)
    model.learn(np.array([0, 2]), np.array([0.6, 0.8]), 1)
    g = np.array([[0.6], [0.8]]) * np.array([[0.5, -0.5]])
    assert np.allclose(model.z[[0, 2]], g) and np.allclose(model.n[[0, 2]], g * g)
    w = -np.sign(g) * (np.abs(g) - language.L1) / ((language.BETA + np.abs(g)) / language.ALPHA + language.L2)
    assert np.allclose(model.weights(np.array([0, 2])), w) and not model.weights()[1].any()


def test_temperature_sharpens_and_softens():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(20_000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert language.temperature(z * 4, y) == pytest.approx(4, rel=0.1)
    assert language.temperature(z / 3, y) == pytest.approx(1 / 3, rel=0.1)


def test_language_edges(spark, awkward, no_documents, docs):
    model = language.train(docs)
    rows = {r["doc_id"]: r for r in language.predict(awkward, model, held_out("doc_id", 5, 0)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2))
    assert rows[9]["lang_pred"] in {"en", "de", "fr", "es"} and 0 <= rows[9]["score"] <= 1
    assert language.train(no_documents) is None
    assert language.predict(awkward, None, held_out("doc_id", 5, 0)).where("lang_pred <> 'und'").count() == 0
    assert language.predict(no_documents, model, held_out("doc_id", 5, 0)).count() == 0


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.6 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * n[0, 0]


def test_toxicity_shares_vectors_with_misspellings():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(400)]
    labels = np.arange(400) % 2
    texts = [t + " obnoxious" * 2 if y else t for t, y in zip(texts, labels)]
    model = toxicity.Model(list(toxicity.bags(texts)), labels)
    margins, base = model.margins()

    def score(text):
        (columns, counts), = toxicity.bags([text])
        own = model.kept[columns]
        return toxicity.weights_of(counts[own]) @ margins[columns[own]] + base

    plain = " ".join(words[:20])
    assert score(plain + " obnoxxious") > score(plain) and score(plain + " obnoxiouz") > score(plain)


def test_toxicity_edges(spark, awkward, no_documents, docs, labels):
    held = held_out("doc_id", 5, 0)
    model = toxicity.train(docs, labels)
    rows = toxicity.predict(awkward, model, held).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.train(docs, labels.limit(0)) is None
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 5), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, odd) is not None
    assert {r["score"] for r in toxicity.predict(awkward, None, held).collect()} == {0.5}
    assert toxicity.predict(no_documents, model, held).count() == 0


def test_toxicity_sample_is_not_shrunk_to_fit_a_memory_limit():
    from palisade.llm import toxicity

    assert (toxicity.TOXIC, toxicity.CLEAN) == (3000, 9000)
