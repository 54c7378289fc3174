import hashlib
import random

import pytest

from loglark.llm import pieces, queries

spm = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return pieces.model_bytes(tokenizers.path("piece_bpe_32k.model"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(spark, model, rows, **more):
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int, doc int")
    return pieces.encode(table, model, **more)


NASTY = [" ", "  ", "   ", "\n", "\t", "\x00", "▁", "▁▁", "a", "the", "　", "é", "🙂", "日本語", "ﬁ", "Å", "x" * 30, "<s>", "<0x41>",
         " ", "‍", "1234567", "\\n", ","]


def test_like_the_library(spark, model):
    rng = random.Random(3)
    texts = ["".join(rng.choice(NASTY) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += ["", None, " ", "▁", "word ", " word", "word  ", "日" * 3000, "a b " * 4000, "x" * 20_000]
    texts += texts[:50]  # repeated rows
    rows = [(i % 700, t, "i", 1, 2) for i, t in enumerate(texts)] + [(None, "a null id", "", 0, 0)]
    sp = spm.SentencePieceProcessor(model_proto=model)
    out = encoded(spark, model, rows, decoded="own")
    out = out.select("doc_id", "ids", "own", pieces.decode(out.ids, model).alias("back"))
    want = sorted(((r[0], sp.encode(r[1] or "")) for r in rows), key=repr)
    got = out.collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    assert all(r.own == r.back == sp.decode(r.ids) for r in got)


def test_blocks_of_any_size_give_the_same_ids(spark, model, monkeypatch):
    rows = [(i, f"one two {i % 7} three  {'four ' * (i % 5)}", "", 0, 0) for i in range(300)]
    whole = {r.doc_id: r.ids for r in encoded(spark, model, rows).collect()}
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 50)
    assert {r.doc_id: r.ids for r in encoded(spark, model, rows).collect()} == whole


def test_each_distinct_word_is_segmented_once(model, monkeypatch):
    import pyarrow as pa

    asked = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def encode(self, words, num_threads):
            asked.extend(words)
            return self.real.encode(words, num_threads=num_threads)

        def piece_to_id(self, piece):
            return self.real.piece_to_id(piece)

    real = pieces._processor(model)
    monkeypatch.setattr(pieces, "_processor", lambda _: Counting(real))
    words = ["▁a ▁b ▁".encode(), "▁b ▁c".encode(), "▁d".encode()]
    batch = pa.RecordBatch.from_pydict({"bucket": [3, 3, 4], "block": [1, 2, 1], "n": [len(w) for w in words],
                                        "packed": [pa.compress(w, codec="zstd", asbytes=True) for w in words]})
    out = [r for b in pieces._segment(iter([batch]), model) for r in b.to_pylist()]
    assert sorted(asked) == ["", "a", "b", "c", "d"]
    assert [pieces._unpacked(r["lens"], r["n_words"]).tolist() for r in out] == [[1, 1, 1], [1, 1], [1]]


def test_other_models_take_whole_texts(spark, model, monkeypatch):
    assert pieces.splits_at_markers(model)
    monkeypatch.setattr(pieces, "splits_at_markers", lambda _: False)
    rows = [(1, "one two  three", "", 0, 0), (2, "", "", 0, 0), (3, " ", "", 0, 0), (4, "one two  three", "", 0, 0)]
    sp = spm.SentencePieceProcessor(model_proto=model)
    assert {r.doc_id: r.ids for r in encoded(spark, model, rows).collect()} == {r[0]: sp.encode(r[1]) for r in rows}


def test_bytes_that_are_no_text(spark, model):
    bad = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    (row,) = pieces.encode(bad, model).collect()
    assert row.ids == spm.SentencePieceProcessor(model_proto=model).encode("a�b")


def test_columns_with_other_names(spark, model):
    out = encoded(spark, model, [(1, "a b", "own", 5, 6)], keep=("doc_id", "ids", "doc", "block"), to="pieces")
    assert out.columns == ["doc_id", "ids", "doc", "block", "pieces"]
    assert [tuple(r)[:4] for r in out.collect()] == [(1, "own", 6, 5)]


def test_empty_table_and_empty_texts(spark, model):
    assert encoded(spark, model, []).count() == 0
    assert [r.ids for r in encoded(spark, model, [(1, None, "", 0, 0), (2, "", "", 0, 0)]).collect()] == [[], []]


def test_texts_are_not_shuffled_after_they_were_cut(spark, model):
    plan = encoded(spark, model, [(1, "a b", "", 0, 0)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Exchange hashpartitioning(bucket" in plan  # words out, ids back


def test_query(spark, sf, model):
    sp = spm.SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op11_pieces(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {tuple(r) for r in out.collect()}
    want = set()
    for doc_id, text in texts.items():
        ids = sp.encode(text)
        want.add((doc_id, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))))
    assert got == want
