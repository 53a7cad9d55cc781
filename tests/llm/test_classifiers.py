"""Held-out accuracy on planted structure, and the awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, empty
from tillroll.llm import language, quality, sampling, toxicity
from tillroll.llm.text import span_hashes

NO_LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "ti", "er", "on", "sh", "ou"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        for at in range(9, len(words), 10):
            words[at] += "."
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "vequ" + word()]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic), "clash"))
    labels += [(0, 1, 1, "contradicts"), (None, 1, 1, "no id"), (3, None, None, "no label"), (9999, 1, 0, "no document")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, NO_LABELS)


@pytest.mark.parametrize("kind, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(corpus, kind, label):
    docs, labels = corpus
    model = kind.fit(docs, labels, F.col("doc_id") % 3 != 0)
    scored = kind.score(docs, model, ["doc_id"]).join(labels.filter("text = 'clash'"), "doc_id").filter("doc_id % 3 = 0")
    rows = scored.collect()
    right = np.mean([(r.score >= 0.5) == bool(r[label]) for r in rows])
    assert len(rows) == 200 and right > 0.95


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_labels_of_held_out_rows_are_not_seen(corpus, kind):
    docs, labels = corpus
    other = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = other.withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (kind.fit(docs, x, F.col("doc_id") % 3 != 0) for x in (labels, other))
    assert np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("kind, low, high", [(quality, 0.5, 0.5), (toxicity, 0.0, 1e-6)])
def test_without_labels(spark, kind, low, high):
    docs = awkward(spark)
    model = kind.fit(docs, spark.createDataFrame([], NO_LABELS), F.lit(True))
    rows = kind.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(low <= r.score <= high for r in rows)
    assert kind.score(empty(spark), model, ["doc_id"]).count() == 0


def test_offending_sentence(corpus, spark):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.lit(True))
    text = "Éantion erou shti. You moron and scum, anti! Ouer onsh."
    row = toxicity.score(awkward(spark, [text]), model, ["doc_id"]).filter("doc_id = 100").first()
    assert row.score > 0.7 and row.n_offending == 1
    assert text[row.worst_start : row.worst_end] == "You moron and scum, anti"
    kept = toxicity.drop_toxic(awkward(spark, [text, "anti erou"]), model, 0.7)
    assert kept.filter("doc_id = 100").count() == 0 and kept.filter("doc_id = 101").count() == 1
    assert kept.count() == 9 and toxicity.drop_toxic(empty(spark), model, 0.7).count() == 0


def test_noisy_or(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.lit(True))
    total, found, p = model.scores([b"You moron. Some scum. anti", b""])
    assert total[0] == pytest.approx(1 - np.prod(1 - p)) and total[1] == 0 and len(p) == 3


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = quality.fit_hinge([np.arange(5)] * 60, list(x), y, 5, epochs=2000)
    loss = lambda w: w @ w / 2 + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(loss(w) <= loss(w + 0.05 * rng.normal(size=5)) + 1e-3 for _ in range(200))


def test_ratios_count_rows_outside_the_sample(spark):
    rows = [(k, f"plain common words {'zebra' if k % 2 else 'lemur'}{k // 20 % 10}") for k in range(400)]
    docs = spark.createDataFrame([*rows, (401, None), (402, "zebra0"), (None, "zebra0")], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(402)] + [(402, 0), (402, 1), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    learnable = F.coalesce(F.col("doc_id") >= 10, F.lit(False))
    expected = np.zeros((2, 1 << quality.BITS))
    for k, text in rows[10:]:
        expected[k % 2, quality.ngrams([text.encode()])[1]] += 1
    assert (quality.class_counts(docs, labels, learnable) == expected).all()
    model = quality.fit(docs, labels, learnable, per_class=2)  # most animals are in no sampled row
    scores = {w: model.score([w.encode()])[0] for w in (f"{a}{k}" for a in ("zebra", "lemur") for k in range(10))}
    assert all(scores[f"zebra{k}"] > scores[f"lemur{k}"] for k in range(10))


def test_repeated_words_are_seen_once():
    found = toxicity.sentences([b"same same same"])
    assert len(found.owner) == 1


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"ab xx ab ", np.uint8)
    a, b = span_hashes(data, np.array([0, 6]), np.array([2, 8]))
    assert a == b and a == span_hashes(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0]


def test_languages(spark):
    rng = random.Random(2)
    sound = {"en": ["the", "ing", "wh", "ough"], "de": ["sch", "ung", "ü", "keit"], "ru": ["ый", "что", "на", "ов"], "el": ["ος", "και", "α", "να"]}
    rows = []
    for k in range(400):
        lang = ["en", "de", "ru", "el"][k % 4]
        rows.append((k, " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[k].lang_pred == lang for k, _, lang in rows if k % 5 == 0]) > 0.95
    odd = {r.doc_id: r for r in language.predict(awkward(spark, ["123 !?", "x"]), model, ["doc_id"]).collect()}
    for k in (1, 2, 3, 100):
        assert odd[k].lang_pred == "und" and odd[k].score == 0
    assert odd[101].lang_pred in sound and 0 <= odd[4].score <= 1


def test_every_language_can_be_predicted(spark):
    rng, rows = random.Random(5), []
    for k in range(230):  # the later, the rarer; the last has one row to learn from
        letters = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        for j in range(6 if k < 120 else 4 if k < 229 else 1):
            text = " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(20))
            rows.append((len(rows), text, f"l{k:03d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert len(model.names) == 230
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert {got[k] for k, _, _ in rows} == {lang for _, _, lang in rows}
    assert np.mean([got[k] == lang for k, _, lang in rows]) > 0.95


def test_language_without_training_rows(spark):
    model = language.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in language.predict(awkward(spark, ["x"]), model, ["doc_id"]).collect()} == {"und"}
    assert language.predict(empty(spark), model, ["doc_id"]).count() == 0


def test_document_frequencies(spark):
    docs = spark.createDataFrame([("ab ab",), ("ab",), ("é",)] * 3, "text string")
    total, seen = language.document_frequencies(docs)
    counts, _ = language.grams([b"ab ab", b"ab", "é".encode()])
    assert total == 9 and (seen == 3 * (counts > 0).sum(axis=0)).all()


def test_gradient_of_the_noisy_or_against_differences():
    rng = np.random.default_rng(4)
    row = np.sort(rng.integers(0, 6, 20))
    labels, logits = np.array([0, 1, 0, 1, 1, 0]), rng.normal(-2, 1, 20)

    def loss(x):
        total = 0.0
        for k, label in enumerate(labels):
            clean = np.prod([1 - 1 / (1 + np.exp(-v)) for v in x[row == k]])
            total -= np.log(1 - clean if label else clean) / len(labels) if (row == k).any() or not label else 0.0
        return total

    slope, _ = toxicity.slopes(logits, row, labels)
    for k in range(len(row)):
        step = np.zeros(len(row))
        step[k] = 1e-5
        assert slope[k] == pytest.approx((loss(logits - step) - loss(logits + step)) / 2e-5, rel=1e-4, abs=1e-9)


def test_training_starts_at_the_share_of_toxic_documents():
    counts, labels = np.array([1, 4, 10, 30]), np.array([0, 0, 1, 0])
    p = 1 / (1 + np.exp(-toxicity.even_bias(counts, labels)))
    assert np.mean(1 - (1 - p) ** counts) == pytest.approx(0.25, abs=1e-6)


def test_few_toxic_documents_are_learned_without_false_alarms():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    insults = ["zvark", "zquol", "zmept"]
    text = lambda toxic: " ".join([word() + rng.choice(["", "", "", "."]) for _ in range(80)] + [rng.choice(insults)] * toxic).encode()
    made = [(text(k % 9 == 0), int(k % 9 == 0)) for k in range(300)]
    found = [toxicity.sentences([t]) for t, _ in made]
    model = toxicity.fit_rows([(f.owner, f.bucket) for f in found], np.array([y for _, y in made]))
    scores = model.scores([text(k % 2) for k in range(200)])[0] >= 0.7
    assert scores[1::2].mean() > 0.9 and scores[0::2].mean() < 0.02


def test_one_text_of_a_repeated_id_is_learned(spark):
    docs = spark.range(100_000).selectExpr("1L AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    docs = docs.unionByName(spark.createDataFrame([(2, None, "de"), (2, "zwei", "de"), (3, "drei", "de")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    rows = sampling.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 0)]
    again = sampling.labelled_sample(docs.repartition(7), labels, "toxic", F.lit(True), 10).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    assert language.fit(docs, F.lit(True)).names == ["de", "en"]
