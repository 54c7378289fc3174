import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import row_set, rows
from loglark.operators import misra_gries, space_saving, task_summaries


def batches(stream, size):
    for i in range(0, len(stream), size):
        part = stream[i : i + size]
        yield pa.RecordBatch.from_pydict(
            {"dim": [""] * len(part), "key": [k for k, _ in part], "w": pa.array([w for _, w in part], pa.int64())}
        )


def summary_of(step, stream, size, capacity):
    return [r for batch in step(batches(stream, size), capacity) for r in batch.to_pylist()]


STREAM = st.lists(st.tuples(st.sampled_from("abcdefghij"), st.integers(1, 20)), min_size=1, max_size=80)


def exact_of(stream):
    exact = Counter()
    for key, w in stream:
        exact[key] += w
    return exact


def check_mg(found: dict, exact: Counter, k: int):
    total = sum(exact.values())
    assert len(found) <= k and all(n > 0 for n in found.values())
    for key, n in exact.items():
        est = found.get(key, 0)
        assert est <= n
        assert est * (k + 1) >= n * (k + 1) - total
        assert key in found or n * (k + 1) <= total
    assert set(found) <= set(exact)


def check_ss(found: dict, exact: Counter, m: int):
    total = sum(exact.values())
    assert len(found) <= m
    for key, (n, err, floor) in found.items():
        assert exact[key] <= n and n * m <= exact[key] * m + total
        assert n - err <= exact[key] and n >= floor
    floors = {floor for _, _, floor in found.values()}
    assert len(floors) <= 1
    for key, n in exact.items():
        if key not in found:
            assert n * m <= total
            assert n <= max(floors)


@settings(max_examples=300, deadline=None)
@given(STREAM, st.integers(1, 8), st.integers(1, 30))
def test_task_summaries(stream, capacity, size):
    exact = exact_of(stream)
    mg = summary_of(task_summaries.misra_gries, stream, size, capacity)
    check_mg({r["key"]: r["n"] for r in mg}, exact, capacity)
    ss = summary_of(task_summaries.space_saving, stream, size, capacity)
    assert [r["rank"] for r in ss] == list(range(1, len(ss) + 1))
    assert sum(r["n"] for r in ss) <= sum(exact.values())
    check_ss({r["key"]: (r["n"], r["err"], r["floor"]) for r in ss}, exact, capacity)


def test_documented_stream():
    stream = [("A", 1)] * 100 + [("B", 1)] * 60 + [("C", 1)] * 30 + [("D", 1)] * 10 + [("E", 1)] * 5
    for size in (1, 7, 1_000):
        got = [(r["key"], r["n"], r["err"]) for r in summary_of(task_summaries.space_saving, stream, size, 3)]
        assert got[:2] == [("A", 100, 0), ("B", 60, 0)] and len(got) == 3
        # The third is one of the rest, with a count and an error that hold.
        key, n, err = got[2]
        true = dict(A=100, B=60, C=30, D=10, E=5)[key]
        assert n - err <= true <= n <= true + 205 / 3


def test_documented_stream_on_spark(spark):
    stream = spark.createDataFrame([("A", 100), ("B", 60), ("C", 30), ("D", 10), ("E", 5)], "key string, cnt long")
    summary = space_saving.build(stream.coalesce(1), "key", 3, weight="cnt")
    assert rows(space_saving.top(summary, 2)) == [("A", 100, 0, 100), ("B", 60, 0, 60)]
    assert rows(space_saving.top(summary))[2] == ("C", 30, 0, 30)


def test_zero_capacity_is_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string").coalesce(1)
    assert len(rows(space_saving.top(space_saving.build(df, "k", 0)))) == 1
    assert misra_gries.build(df, "k", 0).capacity == 1


def skewed(seed: int, n: int) -> list[tuple[str, int]]:
    rng = random.Random(seed)
    return [(f"k{int(200 * rng.random() ** 4)}", rng.randint(1, 9)) for _ in range(n)]


@pytest.mark.parametrize("seed,capacity,partitions,weighted", [(1, 4, 1, False), (2, 16, 5, True), (3, 1, 3, True), (4, 300, 4, False)])
def test_on_partitions_and_merged_twice(spark, seed, capacity, partitions, weighted):
    stream = skewed(seed, 3_000)
    weight = "w" if weighted else None
    parts = [stream[:500], stream[500:1_800], stream[1_800:]]
    frames = [spark.createDataFrame(p, "key string, w long").repartition(partitions) for p in parts]
    exact = exact_of(stream if weighted else [(k, 1) for k, _ in stream])

    mg = [misra_gries.build(f, "key", capacity, weight) for f in frames]
    merged = misra_gries.merge(misra_gries.merge(mg[0], mg[1]), mg[2])
    check_mg(dict(rows(misra_gries.top(merged))), exact, capacity)

    ss = [space_saving.build(f, "key", capacity, weight) for f in frames]
    merged = space_saving.merge(ss[0], space_saving.merge(ss[1], ss[2]))
    found = {r.key: (r.n, r.err, r.floor) for r in merged.rows.collect()}
    check_ss(found, exact, capacity)
    if capacity >= len(exact):
        assert {k: n for k, (n, _, _) in found.items()} == dict(exact)
        assert all(err == 0 for _, err, _ in found.values())


def test_several_dims(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "a"), (None, "a"), ("x", None)], "d string, k string")
    mg = misra_gries.build(df, "k", 5, by="d")
    assert row_set(mg.rows) == {("x", "a", 2), ("x", "b", 1), ("y", "a", 1)}
    ss = space_saving.build(df, "k", 5, by="d")
    assert row_set(ss.rows.select("dim", "rank", "key", "n", "err", "floor")) == {
        ("x", 1, "a", 2, 0, 0),
        ("x", 2, "b", 1, 0, 0),
        ("y", 1, "a", 1, 0, 0),
    }
    assert rows(misra_gries.top(mg, 1, dim="x")) == [("a", 2)]
    small = space_saving.build(df.coalesce(1), "k", 1, by="d")
    assert {r.dim: r.floor for r in small.rows.collect()} == {"x": 1, "y": 0}


def test_estimates_and_mismatch(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    probes = spark.createDataFrame([("a",), ("zzz",), (None,)], "k string")
    mg, ss = misra_gries.build(df, "k", 5), space_saving.build(df, "k", 5)
    assert row_set(misra_gries.estimate(mg, probes, "k")) == {("a", 2), ("zzz", 0), (None, 0)}
    assert row_set(space_saving.estimate(ss, probes, "k", err_name="err")) == {("a", 2, 0), ("zzz", 0, 0), (None, 0, 0)}
    with pytest.raises(ValueError):
        misra_gries.merge(mg, misra_gries.build(df, "k", 6))
    with pytest.raises(ValueError):
        space_saving.merge(ss, space_saving.build(df, "k", 6))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string")
    assert rows(misra_gries.top(misra_gries.build(df, "k"))) == []
    assert rows(space_saving.top(space_saving.build(df, "k"))) == []


def test_one_shuffle_of_summaries(spark, tmp_path):
    spark.range(1_000).select(F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for summary in (misra_gries.build(table, "k", 8), space_saving.build(table, "k", 8)):
        text = summary.rows._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(dim") == 1 and text.count("FileScan") == 1


@given(st.lists(STREAM, min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_folded_summaries_keep_their_bounds(streams, capacity):
    """Summaries of tasks folded in one task, as a level of the tree does."""
    whole = [pair for stream in streams for pair in stream]
    ss = [b for stream in streams for b in task_summaries.space_saving(batches(stream, 7), capacity)]
    found = [r for b in task_summaries.fold_space_saving(iter(ss), capacity) for r in b.to_pylist()]
    check_ss({r["key"]: (r["n"], r["err"], r["floor"]) for r in found}, exact_of(whole), capacity)
    mg = [b for stream in streams for b in task_summaries.misra_gries(batches(stream, 7), capacity)]
    again = [pa.RecordBatch.from_arrays(b.columns, names=["dim", "key", "w"]) for b in mg]
    found = [r for b in task_summaries.misra_gries(iter(again), capacity) for r in b.to_pylist()]
    check_mg({r["key"]: r["n"] for r in found}, exact_of(whole), capacity)


def test_a_tree_of_summaries_sends_few_rows_to_its_top(spark):
    """Thirty tasks of many keys: at most groups x capacity rows of a dim reach the last grouping."""
    df = spark.range(60_000, numPartitions=30).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.col("id") * 7919 % 20_011).cast("string").alias("key")
    )
    exact = Counter(r.key for r in df.collect())
    capacity, groups = 20, 4
    for build, top_rows in ((misra_gries.build, misra_gries._merged), (space_saving.build, space_saving._merged)):
        seen = []
        module = misra_gries if build is misra_gries.build else space_saving
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "_merged", lambda rows, *a, top=top_rows, seen=seen: (seen.append(rows), top(rows, *a))[1])
            found = build(df, "key", capacity, groups=groups).rows.collect()
        assert 0 < seen[0].count() <= groups * capacity
        if module is misra_gries:
            check_mg({r.key: r.n for r in found}, exact, capacity)
        else:
            check_ss({r.key: (r.n, r.err, r.floor) for r in found}, exact, capacity)
