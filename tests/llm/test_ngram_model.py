import math
import mmap
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglark.llm import elias_fano, ngram_model, ngram_trie
from loglark.llm.elias_fano import EliasFano
from loglark.llm.ngram_trie import IDS, Trie
from loglark.llm.text import fold_of


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 40), (5, 5), (9000, 9000), (9000, 1 << 54), (20000, 40000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64)) if top > n else np.arange(n, dtype=np.uint64)
    built = EliasFano.from_parts([np.frombuffer(p.tobytes(), p.dtype) for p in EliasFano.of(values).parts])
    assert np.array_equal(built.values(np.arange(len(values))), values)
    asked = np.unique(np.concatenate([values[::3], rng.integers(0, top, 500, dtype=np.uint64)]))
    want = {int(v): k for k, v in enumerate(values)}
    assert built.find(asked).tolist() == [want.get(int(v), -1) for v in asked]
    if n == 9000 and top > n:
        assert sum(p.nbytes for p in built.parts) < len(values) * (math.log2(top / n) + 2.6) / 8


def test_elias_fano_keeps_equal_values():
    values = np.sort(np.random.default_rng(1).integers(0, 50, 9000, dtype=np.uint64))  # pointers may repeat
    assert np.array_equal(EliasFano.of(values).values(np.arange(9000)), values)
    assert elias_fano.BLOCK % 8 == 0


class Plain:
    """The model with dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.three = Counter(), defaultdict(Counter), defaultdict(Counter)
        for tokens in texts:
            u = v = "<s>"
            for w in tokens:
                self.one[w] += 1
                self.two[v][w] += 1
                self.three[u, v][w] += 1
                u, v = v, w
        self.n, self.v = sum(self.one.values()), len(self.one)

    def base(self, w):
        return (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, u, v, w):
        p = self.base(w)
        for found in (self.two.get(v), self.three.get((u, v))):
            if found:
                n = sum(found.values())
                taken = found[w] - ngram_trie.DISCOUNT if found[w] else 0
                p = (taken + (ngram_trie.PRIOR + ngram_trie.DISCOUNT * len(found)) * p) / (n + ngram_trie.PRIOR)
        return p


def texts_of(rng, n):
    words = ["the", "a", "É", "x1", "of", *(f"w{k}" for k in range(40))]
    weights = [20, 10, 5, 5, 5, *([1] * 40)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(n)]


def test_scores_match_a_plain_model(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_model, "TOKENS_AT_ONCE", 500)
    rng = random.Random(13)
    rows = list(enumerate(texts_of(rng, 150))) + [(1000, None), (1001, " \n"), (1002, "never-seen THE"), (None, "a a")]
    table = docs(*rows, (3, rows[3][1])).repartition(3)
    train = {i for i, _ in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10}
    tokens = lambda t: (t or "").lower().split() + ["</s>"]
    plain = Plain([tokens(t) for i, t in [*rows, (3, rows[3][1])] if i in train])
    got = ngram_model.score(table, fold_of(F.col("doc_id"), 10) != 0).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        own = tokens(dict(rows)[r.id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (
            len(own), sum(plain.one[w] > 0 for w in own), plain.n, r.id not in train
        )
        assert r.base_score == pytest.approx(sum(math.log10(plain.base(w)) for w in own), rel=1e-9)
        want, u, v = 0.0, "<s>", "<s>"
        for w in own:
            want += math.log10(plain.p(u, v, w))
            u, v = v, w
        assert r.score == pytest.approx(want, rel=0.01, abs=0.05)


def test_rare_words_share_a_class(docs):
    """With few ids: probabilities of all words after a context still add up to one, and the base score is the same."""
    rng = random.Random(14)
    table = docs(*enumerate(texts_of(rng, 120)))
    full = {r.id: r for r in ngram_model.score(table, F.lit(True)).collect()}
    few = {r.id: r for r in ngram_model.score(table, F.lit(True), head=5).collect()}
    assert all(few[i].base_score == pytest.approx(full[i].base_score) and few[i].n_known == full[i].n_known for i in full)
    v = ngram_model.Vocabulary(np.array([5, 9], np.uint64), np.array([30.0, 20.0]), 4, 60, 7, 3)
    assert v.unigram[[0, 1, 3, 4]].sum() == pytest.approx(1)
    assert sum(r.score for r in few.values()) > sum(r.base_score for r in few.values())


@pytest.mark.parametrize("most", [None, 90])
def test_scores_match_a_plain_model_with_more_words_than_ids(spark, docs, monkeypatch, most):
    """Most words have no broadcast id; in the second run shards are also cut into parts, and rows are short."""
    monkeypatch.setattr(ngram_model, "TOKENS_AT_ONCE", 500)
    if most:
        monkeypatch.setattr(ngram_model, "MOST_IDS", most)
        monkeypatch.setattr(ngram_model, "TOKENS_IN_ROW", 7)
        monkeypatch.setattr(ngram_model, "SHARDS_IN_TASK", 1)
    rng = random.Random(17)
    names = ["the", "a", "of", *(f"w{k}" for k in range(200))]
    rows = [(i, " ".join(rng.choices(names, [30, 10, 5, *([1] * 200)], k=rng.randint(0, 6)) * 3)) for i in range(60 if most else 200)]
    rows += [(1000, "never-seen THE never-seen"), (1001, None)]
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10}
    tokens = lambda t: (t or "").lower().split() + ["</s>"]
    plain = Plain([tokens(t) for i, t in rows if i in train])
    got = ngram_model.score(docs(*rows).repartition(3), fold_of(F.col("doc_id"), 10) != 0, head=3).collect()
    assert len(got) == len(rows)
    for r in got:
        want, u, v = 0.0, "<s>", "<s>"
        for w in tokens(dict(rows)[r.id]):
            want += math.log10(plain.p(u, v, w))
            u, v = v, w
        assert r.score == pytest.approx(want, rel=0.01, abs=0.05)


def test_parts_of_a_shard_keep_each_context_whole(monkeypatch):
    rng = np.random.default_rng(18)
    words = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    base, bits = 5, ngram_model._BITS
    v, u, w = rng.integers(2, base + len(words), (3, 300)).astype(np.uint64)
    mark = np.arange(300, dtype=np.uint16)
    part = (7, words, (v << bits | u) << bits | w, mark)
    name = lambda own, x: int(x) if x < base else int(own[int(x) - base])
    want = {int(m): tuple(name(words, x[m]) for x in (v, u, w)) for m in mark}
    monkeypatch.setattr(ngram_model, "MOST_IDS", 60)
    got, seen = {}, []
    for own, parts, _ in ngram_model._shard_parts([part], [], base):
        assert base + len(own) <= 60
        for _, mine, key, marks in parts:
            columns = key >> bits * np.uint64(2), key >> bits & ngram_model._LOW, key & ngram_model._LOW
            got |= {int(m): tuple(name(mine, x[k]) for x in columns) for k, m in enumerate(marks)}
            seen.append({name(mine, x) for x in columns[0]})
    assert got == want and len(seen) > 3 and sum(map(len, seen)) == len(set().union(*seen))
    monkeypatch.setattr(ngram_model, "MOST_IDS", 6)
    with pytest.raises(ValueError, match="shuffle.partitions"):
        list(ngram_model._shard_parts([part], [], base))


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(15)
    keys = np.sort(rng.integers(0, 6, (400, 3)), axis=0)
    keys = rng.integers(0, 6, (400, 3)).astype(np.uint64)
    flat = (keys[:, 0] * np.uint64(IDS) + keys[:, 1]) * np.uint64(IDS) + keys[:, 2]
    trigrams, counts = np.unique(flat, return_counts=True)
    bigrams, to = np.unique((trigrams >> np.uint64(36) << np.uint64(18)) | (trigrams & np.uint64(IDS - 1)), return_inverse=True)
    unigram = np.full(7, 1 / 7)
    trie = Trie.build(bigrams, np.bincount(to, counts), trigrams, counts, unigram)
    for v in (0, 3, 6):
        for u in (1, 5, 6):
            asked = np.array([(v * IDS + u) * IDS + w for w in range(7)], np.uint64)
            assert (10 ** trie.log10(asked, np.log10(unigram))).sum() == pytest.approx(1, abs=0.01)
    words, histories = trie.children(3)
    assert words.tolist() == sorted({int(k[2]) for k in keys if k[0] == 3})
    assert histories.tolist() == sorted({int(k[1]) for k in keys if k[0] == 3})


def test_trie_over_a_mapped_file(tmp_path):
    trigrams = np.array([5, 5 + IDS, 7 * IDS * IDS], np.uint64)
    bigrams, to = np.unique((trigrams >> np.uint64(36) << np.uint64(18)) | (trigrams & np.uint64(IDS - 1)), return_inverse=True)
    trie = Trie.build(bigrams, np.bincount(to, [1, 2, 3]).astype(float), trigrams, np.array([1, 2, 3.0]), np.full(9, 1 / 9))
    file = tmp_path / "trie"
    file.write_bytes(trie.packed())
    with open(file, "rb") as f:
        other = Trie.over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    asked = np.array([0, 5, 6, 5 + IDS, 7 * IDS * IDS, 8 * IDS * IDS + 3], np.uint64)
    want = trie.log10(asked, np.full(9, np.log10(1 / 9)))
    for t in (other, trie.mapped()):
        assert np.array_equal(t.log10(asked, np.full(9, np.log10(1 / 9))), want)


def test_frequent_contexts_are_spread():
    words, counts = np.arange(1, 40, dtype=np.uint64), np.full(39, 100.0)
    counts[0] = 8000
    v = ngram_model.Vocabulary(words, counts, 50, 13000, 60, 20)
    assert v.spread[ngram_model.FIRST_WORD] == 20 and v.spread.min() == 1
    shards = v.shard_of(np.full(500, ngram_model.FIRST_WORD), np.arange(500))
    assert len(set(shards.tolist())) > 15
    again = v.shard_of(np.full(500, ngram_model.FIRST_WORD + 1), np.arange(500))
    assert len(set(again.tolist())) <= v.spread[ngram_model.FIRST_WORD + 1]


def test_without_training_texts_and_without_rows(docs):
    table = docs((1, "some words"), (2, None))
    rows = ngram_model.score(table, F.lit(False)).collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r.base_score == pytest.approx(0) and r.score == pytest.approx(0, abs=1e-6) for r in rows)
    assert ngram_model.score(table.where("doc_id = 9"), F.lit(True)).count() == 0
