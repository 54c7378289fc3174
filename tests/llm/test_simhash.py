import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loglark.llm import simhash
from loglark.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(values, least=4):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= least:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprint_matches_its_definition():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one two three", "A b C d", "é\x0bÀ b c d e f", "x " * 9000]
    texts += [" ".join(rng.choice(["ab", "Ce", "d", "É"]) for _ in range(n)) for n in range(1, 60)]
    for text in texts:
        assert simhash.text_fingerprint(text.encode()) == plain_fingerprint(text)


def cluster(rng, n, spread):
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        value = centre
        for _ in range(rng.randint(1, spread)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return list(out)


def check_links(spark, values, **options):
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), **options)
    # A link joins two fingerprints of one component, which need not be near each other: a task sends a spanning forest.
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(v, v) for v in signed]
    want = plain_components(values)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_links_join_the_same_components_as_all_pairs(spark):
    rng = random.Random(2)
    values = list({v for k in range(12) for v in cluster(rng, 12, 3 + k % 4)} | {rng.getrandbits(64) for _ in range(100)})
    check_links(spark, values)
    check_links(spark, values, bits=20)


def test_dense_cluster_is_cut_into_smaller_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 12)
    check_links(spark, cluster(random.Random(3), 150, 4), bits=8)


def test_bits_at_the_limit(spark):
    base = 0xF0F0F0F0F0F0F0F0
    four = base ^ 0b1111
    five = base ^ (0b11111 << 40)
    signed = np.array([base, four, five], np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset(signed[:2])}


def test_rows_nulls_and_repeats(docs):
    text = " ".join(f"word{i}" for i in range(50))
    table = docs((7, text), (3, text), (3, text), (9, None), (8, ""), (None, "else entirely here now"), (5, "of its own kind"))
    got = sorted(simhash.near_duplicates(table).select("id", "component_id").collect(), key=str)
    assert sorted((r.id, r.component_id) for r in got if r.id is not None) == [(3, 3), (3, 3), (5, 5), (7, 3), (8, 8), (9, 8)]
    kept = simhash.keep_one(table.withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")))
    assert kept.columns == [*table.columns, "fp", "id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, 8, None]


def test_one_row_of_each_component_stays_whatever_it_shares(docs):
    text = " ".join(f"word{i}" for i in range(50))
    table = docs((1, text), (1, text), (1, "other words of the same number"), (2, text), (None, text))
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(table).collect()) == sorted(
        [(1, text), (1, "other words of the same number")]
    )


def test_empty_table(docs):
    table = docs((1, "a")).where("doc_id = 2")
    assert simhash.near_duplicates(table).count() == 0 and simhash.keep_one(table).count() == 0


def test_long_chain_of_components(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, n + 1)}
