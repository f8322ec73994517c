import random

import numpy as np

from pricegrid.llm import toxicity
from tests.llm.helpers import awkward, none


def planted(n, seed, stems=("grobl", "snarf"), loud=("dolt", "oaf")):
    """Clean prose; toxic texts hold a few words of a list, or with a listed beginning, in one of their sentences."""
    rnd = random.Random(seed)
    words = [a + b + c for a in ("ta", "re", "mi", "so", "un") for b in ("ble", "ing", "on", "er") for c in ("", "s", "ta", "ly")]
    out = []
    for i in range(n):
        sentences = [[rnd.choice(words) for _ in range(rnd.randint(3, 14))] for _ in range(rnd.randint(1, 30))]
        toxic, bad = int(rnd.random() < 0.15), rnd.randrange(len(sentences))
        if toxic:
            for _ in range(2):
                word = rnd.choice(loud) if rnd.random() < 0.5 else rnd.choice(stems) + rnd.choice(words)
                sentences[bad].insert(rnd.randrange(len(sentences[bad])), word)
        out.append((i, ". ".join(" ".join(s).capitalize() for s in sentences) + ".", toxic, bad))
    return out


def test_held_out_documents_and_their_sentences_are_found(spark):
    rows = planted(3000, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    test = planted(600, 2)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([r[:2] for r in test], "doc_id long, text string"), model).collect()}
    caught = [got[i]["score"] >= 0.5 for i, _, toxic, _ in test if toxic]
    wrong = [got[i]["score"] >= 0.5 for i, _, toxic, _ in test if not toxic]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.02
    placed = []
    for i, text, toxic, bad in test:
        if toxic and got[i]["score"] >= 0.5:
            begin = sum(len(s) + 1 for s in text.split(".")[:bad])
            placed.append(any(begin <= s["start"] <= begin + 1 for s in got[i]["offending"]))
    assert np.mean(placed) > 0.95


def test_noisy_or_is_one_minus_the_product():
    p = np.array([0.1, 0.5, 0.01])
    assert abs(toxicity.noisy_or(np.log(p / (1 - p))) - (1 - np.prod(1 - p))) < 1e-12
    assert toxicity.noisy_or(np.array([])) == 0 and toxicity.noisy_or(np.array([800.0])) == 1


def test_only_telling_parts_carry_weight():
    rows = [(r[2], r[1]) for r in planted(1500, 3)]
    model = toxicity.fit_model(rows, np.mean([r[0] for r in rows]))
    assert model.score_of("dolt") > 2 and model.score_of("groblanything") > 2
    assert abs(model.score_of("tableta")) < 1 and model.bias < -3


def test_fit_does_not_look_at_held_out_labels_nor_at_other_columns(spark):
    rows = planted(800, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", (toxicity.held_out(labels.doc_id).cast("int") + labels.toxic) % 2)
    extra = docs.selectExpr("doc_id", "text", "text AS id", "doc_id AS rank", "'x' AS toxic", "'y' AS lang")
    a, b = toxicity.fit(docs, labels), toxicity.fit(extra, flipped)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_awkward_rows_labels_and_empty_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [(r["score"], r["n_sentences"]) for r in got if r["doc_id"] in (4, 5, 6)] == [(0.0, 0)] * 3
    model = toxicity.fit(docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.score(docs, model).collect()) < 1e-4
    assert toxicity.score(none(spark), toxicity.fit(none(spark), labels)).count() == 0
    # one class only
    assert min(r["score"] for r in toxicity.score(docs, toxicity.fit_model([(1, "a b")], 1.0)).collect() if r["n_sentences"]) > 0.99


def test_texts_beyond_the_bound_are_not_learned_from():
    rows = [(r[2], r[1]) for r in planted(300, 5)]
    model = toxicity.fit_model([*rows, (0, "dolt oaf " * 5000)], 0.15, most_chars=20_000)
    assert model.score_of("dolt") >= 0
    long = ("Fine words. " * 50_000) + "dolt"
    odds, spans = model.sentences(long, toxicity.Scores(model))
    assert len(odds) == 50_001 and spans[-1][1] == len(long)
