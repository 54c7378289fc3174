"""The pipeline stage by stage against plain versions of the stages, and the queries against their SQL."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loglark.llm import mix, quality, queries, simhash, toxicity
from loglark.llm.oracles import ORACLES
from loglark.session import materialize
from test_decontaminate import plain_words
from test_simhash import plain_components, plain_fingerprint


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mix"]

    good = corpus_pipeline.good_quality(spark, docs, sf)
    model = quality.train(docs, labels)
    rows = docs.collect()
    import numpy as np

    x = np.array([quality.numbers((r.text or "").encode()) for r in rows], np.float32).astype(float)
    want = sorted(r.doc_id for r, s in zip(rows, model.score(x)) if s >= 0.3)
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == want and 0 < len(want) < len(rows)

    good = good.cache()
    clean = corpus_pipeline.not_toxic(spark, good, sf).cache()
    judge = toxicity.train(good, labels)
    want = sorted(r.doc_id for r in good.collect() if judge.score((r.text or "").encode()) < 0.5)
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == want

    single = corpus_pipeline.no_near_duplicates(spark, clean, sf).cache()
    rows = sorted(clean.collect(), key=lambda r: r.doc_id)
    component = plain_components([plain_fingerprint(r.text) for r in rows])
    want = [r.doc_id for i, r in enumerate(rows) if component[i] == i]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want

    apart = corpus_pipeline.not_contaminated(spark, single, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for r in single.collect():
        n, hit, _ = _quick_marks(items, r.text)
        if not (hit and 20 * len(hit) >= n):
            want.append(r.doc_id)
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(want)

    mixed = corpus_pipeline.to_weights(spark, apart, sf)
    copies = {r.id: r.copies for r in mix.decide(apart).collect() if r.copies}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert 1 <= r.copy <= copies[r.doc_id]
    assert got == copies
    for frame in (good, clean, single, apart):
        frame.unpersist()


def _quick_marks(items, text):
    """plain_marks with the windows of the items in a table."""

    tokens, windows = plain_words(text), {}
    for name, item in items:
        own = plain_words(item)
        m = min(13, len(own))
        for k in range(len(own) - m + 1) if own else []:
            windows.setdefault((m, tuple(own[k : k + m])), set()).add(name)
    hit, found = set(), set()
    for m in {m for m, _ in windows}:
        for i in range(len(tokens) - m + 1):
            names = windows.get((m, tuple(tokens[i : i + m])))
            if names:
                hit.update(range(i, i + m))
                found |= names
    return len(tokens), hit, found


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert set(spark.read.parquet(f"{sf}/documents.parquet").columns) < set(got.columns) and got.count() > 0
    assert simhash.near_duplicates(got.where("copy = 1")).where("id <> component_id").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, copy string, _id int, fp binary"


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "own", 3, b"x") for i, t, s in rows], ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, (i or 0) % 2, int((i or 0) % 5 == 0)) for i, _, _ in rows if i is not None and i % 7]
    spark.createDataFrame([*labels, (None, 1, None), (9999, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [("q1", " ".join(f"bench{k}" for k in range(20))), ("q2", None), ("q3", ""), (None, "short item")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_go_through(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, long texts, and columns that are named like those the stages make."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(60)), "s1" if i % 3 else None) for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (None, "a text without an id that is long enough", "s1"), (None, None, None)]
    rows += [rows[4], rows[4], (200, rows[4][1], "s2"), (300, "word " * 20_000, "s1")]
    odd_tables(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, frame = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = materialize(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == names
    assert corpus_pipeline.no_near_duplicates(spark, docs, str(tmp_path)).where(F.col("text") == rows[4][1]).count() == 1
    kept = corpus_pipeline.not_contaminated(spark, docs, str(tmp_path))
    assert kept.count() == docs.count()
    mixed = corpus_pipeline.to_weights(spark, docs, str(tmp_path))
    assert mixed.columns == [*names, "_copy"]
    assert {r.copy for r in mixed.collect()} == {"own"} and mixed.where("doc_id = 300").count() <= 3


def test_empty_tables_give_an_empty_mix(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
