import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglark.llm import quality, queries, toxicity


def say(rng, n, *extra):
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(n)] + list(extra)
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts that are toxic by one of two words, and of low quality by signs or repetition."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        toxic, good = i % 5 == 0, i % 3 != 0
        text = say(rng, rng.randint(20, 120), *([rng.choice(["Blockhead", "nitwit,"])] * 2 if toxic else []))
        if not good:
            text = " ".join(w + rng.choice(["%%%", "***"]) for w in text.split()) if i % 2 else (text[:12] + " ") * 60
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (1, None, None), (10_000, 0, 1)]
    docs += [(None, "nobody"), (500, None), (501, ""), (502, "nitwit nitwit " * 50_000), (7, docs[7][1])]
    frame = spark.createDataFrame([(*d, "mine", 0.5) for d in docs], "doc_id long, text string, _score string, score double")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((r[0], r) for r in labels)


def held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_texts(corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", toxicity.score(docs, model).alias("p")).collect()
    assert len(rows) == docs.count() and all(0 <= r.p <= 1 for r in rows)
    test = [r for r in rows if r.doc_id in truth and held(r.doc_id) and r.doc_id < 400]
    assert len(test) > 50 and np.mean([(r.p >= 0.5) == truth[r.doc_id][2] for r in test]) > 0.95
    by_id = {r.doc_id: r.p for r in rows}
    assert by_id[500] == by_id[501] < 0.5 < by_id[502]
    kept = toxicity.keep_clean(docs, labels, model=model)
    assert kept.columns == docs.columns and {r._score for r in kept.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.p < 0.5)


def test_quality_on_held_out_texts(corpus):
    docs, labels, truth = corpus
    model = quality.train(docs, labels)
    rows = docs.select("doc_id", quality.score(docs, model).alias("p")).collect()
    assert len(rows) == docs.count() and all(0 <= r.p <= 1 for r in rows)
    test = [r for r in rows if r.doc_id in truth and held(r.doc_id) and r.doc_id < 400]
    assert np.mean([(r.p >= 0.3) == truth[r.doc_id][1] for r in test]) > 0.95
    kept = quality.keep_good(docs, labels, model=model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.p >= 0.3)


def test_held_out_labels_do_not_train(spark, corpus):
    docs, labels, _ = corpus
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.select("doc_id", *[F.when(fold, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables)) and a.intercept == b.intercept


@pytest.mark.parametrize("sample", [80, 40_000])
def test_labels_without_a_text_change_nothing(spark, corpus, sample):
    docs, labels, _ = corpus
    own = labels.select("doc_id", "toxic")
    more = spark.range(100_000, 101_000).selectExpr("id AS doc_id", "CAST(1 AS INT) AS toxic")
    a, b = (toxicity.train(docs, x, sample=sample) for x in (own, own.union(more)))
    assert a.weights.any() and np.allclose(a.weights, b.weights) and a.intercept == pytest.approx(b.intercept)


def test_ngrams_are_those_of_the_text(monkeypatch):
    seen = np.zeros(toxicity.BUCKETS, bool)
    whole = toxicity.features(("Some  Text\n" * 300).encode(), seen)
    monkeypatch.setattr(toxicity, "_PIECE", 64)
    assert np.array_equal(whole, toxicity.features(("some text " * 300).encode(), seen))
    assert not seen.any() and len(toxicity.features(b"", seen)) == 0
    # " abc " has two n-grams of four bytes and one of five.
    assert len(toxicity.features(b"abc", seen)) == 3


def test_log_count_ratio():
    got = toxicity.log_count_ratio(np.array([9, 0]), np.array([0, 9]), 10, 20)
    assert got == pytest.approx([np.log(10 / 12) - np.log(1 / 22), np.log(1 / 12) - np.log(10 / 22)])


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(7)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    # A score is the sum of one entry of each table.
    z = model.intercept + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, x[0]))
    z += sum(t[np.searchsorted(a, x[0, i], "right"), np.searchsorted(b, x[0, j], "right")] for i, j, a, b, t in model.pairs)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_numbers():
    got = dict(zip(quality.FEATURES, quality.numbers(b"AB ab% ab%\nx1 | \xc3\xa9.\n")))
    assert got["words"] == pytest.approx(np.log(6)) and got["all_capitals"] == pytest.approx(1 / 6)
    assert got["words_with_symbol"] == pytest.approx(3 / 6) and got["bare_symbols"] == pytest.approx(1 / 6)
    assert got["same_as_last"] == pytest.approx(1 / 6) and got["most_common"] == pytest.approx(2 / 6)
    assert set(quality.numbers(b" \n")) == {0.0} and len(quality.numbers(b"a")) == len(quality.FEATURES)


def test_without_training_rows(corpus):
    docs, labels, _ = corpus
    none = labels.where("doc_id = -1")
    few = docs.limit(3)
    assert [r[0] for r in few.select(quality.score(few, quality.train(docs, none))).collect()] == [0.5] * 3
    assert [r[0] for r in few.select(toxicity.score(few, toxicity.train(docs, none))).collect()] == pytest.approx([0] * 3)
    only = labels.where("toxic = 1")
    assert [r[0] for r in few.select(toxicity.score(few, toxicity.train(docs, only))).collect()] == pytest.approx([1] * 3)
    gone = docs.where("doc_id = -1")
    assert gone.select(quality.score(gone, quality.train(gone, labels))).count() == 0
    assert gone.select(toxicity.score(gone, toxicity.train(gone, labels))).count() == 0


def test_queries(spark, sf):
    for query, least in ((queries.op3_toxicity, 0.5), (queries.op9_quality, 0.3)):
        rows = query(spark, sf).collect()
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= least) for r in rows)
