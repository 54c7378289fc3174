import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loglark.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """{conv_id: turns (role, text)} after the first turns are taken over, by the rule of the query."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(s)] for c, s in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(sequences):
    """The nodes of the trie, each prefix for itself."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def collected(out):
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.select(*COLUMNS).collect())


def sequence_rows(spark, sequences):
    rows = [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], len(t[1])) for t in turns]) for c, turns in sequences.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<digest: string, chars: int>>")


def trie(spark, sequences, partitions=None):
    return collected(prefix_trie.nodes(sequence_rows(spark, sequences), partitions).withColumnRenamed("saved_chars", "saved_tokens"))


def made_up(n, seed, alphabet=3, most=6):
    rng = random.Random(seed)
    words = [("r", "x" * k) for k in range(alphabet)]
    return {rng.randint(0, 10**6) - 1000: [rng.choice(words) for _ in range(rng.randint(0, most))] for _ in range(n)}


def test_many_partitions(spark):
    sequences = made_up(400, 1)
    assert trie(spark, sequences, 7) == plain(sequences)


@pytest.mark.parametrize("seed", range(4))
def test_small_runs_and_folds(seed, monkeypatch):
    """Runs of a few conversations, forests merged two at a time: every node is open at some time."""
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 60)
    monkeypatch.setattr(prefix_trie, "FOLD", 2)
    sequences = made_up(150, seed, alphabet=2 + seed % 2, most=5)
    assert by_hand(sequences, 5 + seed) == plain(sequences)


def by_hand(sequences, parts):
    """The tasks one after the other, without Spark: sorted ranges, merges, and the joins on names."""
    import numpy as np
    import pyarrow as pa

    names = {t: hashlib.sha256(repr(t).encode()).digest()[:16] for turns in sequences.values() for t in turns}
    items = sorted((b"".join(names[t] for t in turns), c, [len(t[1]) for t in turns]) for c, turns in sequences.items())
    rows, step = [], -(-len(items) // parts)
    for part in range(parts):
        own = items[part * step : (part + 1) * step]
        if own:
            batch = pa.RecordBatch.from_pydict({"key": [x[0] for x in own], "conv_id": [x[1] for x in own],
                                                "chars": pa.array([x[2] for x in own], pa.list_(pa.int32()))})
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(prefix_trie, "TaskContext", type("T", (), {"get": staticmethod(lambda p=part: type("C", (), {"partitionId": lambda s: p})())}))
                rows += [r for b in prefix_trie._sorted_task(iter([batch])) for r in b.to_pylist()]
    level = [r for r in rows if r["kind"] == "spine"]
    done = [r for r in rows if r["kind"] == "node"]
    while level:
        groups = defaultdict(list)
        for r in level:
            groups[r["part"] // prefix_trie.FOLD].append(r | {"fold": r["part"] // prefix_trie.FOLD})
        closed = set(groups) == {0}
        made = [r for g in groups.values() for r in prefix_trie._merge(pa.Table.from_pylist(g), closed).to_pylist()]
        done += [r for r in made if r["kind"] == "node"]
        level = [r for r in made if r["kind"] == "spine"]
    ids = defaultdict(list)
    for r in rows:
        if r["kind"] == "ids":
            ids[r["own"]].append((r["conv_id"], r["ids"]))
    digests = {k: hashlib.sha256(",".join(x[1] for x in sorted(v)).encode()).hexdigest() for k, v in ids.items()}
    members = {r["own"]: r["conv_id"] for r in done if r["own"] is not None}
    out = []
    for r in done:
        parent = members[r["up"]] if r["up"] is not None else -1 if r["parent_conv_id"] is None else r["parent_conv_id"]
        ends = r["ends"] or digests.get(r["own"], prefix_trie.NOBODY)
        out.append((r["conv_id"], r["depth"], parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_chars"], ends))
    return sorted(out)


def test_a_group_of_equal_conversations_over_many_partitions(spark):
    sequences = {c: [("u", "hi"), ("a", "yo")] for c in range(500)}
    sequences |= {c: [("u", "hi"), ("a", "yo"), ("u", str(c % 3))] for c in range(500, 520)} | {999: [], 1000: [("u", "hi")]}
    assert trie(spark, sequences, 9) == plain(sequences)


def test_one_conversation_and_none(spark):
    assert trie(spark, {5: [("u", "abc")]}) == plain({5: [("u", "abc")]})
    assert trie(spark, {5: []}) == plain({5: []})
    assert trie(spark, {}) == []


def test_long_conversations(spark):
    turns = [("u", "x" * (k % 7)) for k in range(20_000)]
    sequences = {1: turns, 2: turns[:15_000], 3: turns[:15_000] + [("a", "other")]}
    got = trie(spark, sequences, 3)
    assert len(got) == 20_002
    assert {r[:6] for r in got if r[1] in (0, 15_000)} == {(1, 0, -1, 3, 1, 2), (1, 15_000, 1, 3, 2, 2)}


@pytest.fixture
def run(spark, tmp_path):
    def made(rows):
        table = spark.createDataFrame([(*r, "k", b"", 1) for r in rows],
                                      "conv_id long, turn long, role string, text string, key string, own binary, depth int")
        table.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        return collected(queries.op13_prefix_trie(spark, str(tmp_path)))

    return made


def test_nulls_ties_repeats_and_missing_bases(run):
    rng = random.Random(8)
    texts = ["", None, "a", "b", "é🙂", "<|im_end|>"]
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(205, 230), 1_000_000, -100]:
        for _ in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += rows[:20] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    assert run(rows) == plain(rebuilt(rows))


def test_empty_table(run):
    assert run([]) == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_prefix_trie(spark, sf)
    assert out.columns == COLUMNS and dict(out.dtypes) == {c: "bigint" for c in COLUMNS[:-1]} | {"ends_sha256": "string"}
    assert collected(out) == plain(rebuilt(rows))


def test_digests_tell_roles_and_texts_apart(spark):
    turns = spark.createDataFrame([(1, 1, "a", "bc"), (2, 1, "ab", "c"), (3, 1, None, "abc"), (4, 1, "abc", None)],
                                  "conv_id long, turn long, role string, text string")
    found = prefix_trie.sequences(turns).select(F.col("turns")[0]["digest"].alias("d")).collect()
    assert len({r.d for r in found}) == 4
