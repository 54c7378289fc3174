import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import plan, row_set, rows
from loglark.operators import cms, counts
from loglark.params import CmsParams


def keys_of(seed: int, n: int, distinct: int) -> list[str]:
    rng = random.Random(seed)
    return [f"k{int(distinct * rng.random() ** 3)}" for _ in range(n)]


@pytest.mark.parametrize("width,depth,seed", [(7, 1, 0), (16, 3, 5), (256, 4, 1)])
def test_bounds(spark, width, depth, seed):
    keys = keys_of(seed, 4_000, 200)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    sketch = cms.build(df, "k", CmsParams(width, depth, seed))
    assert row_set(cms.row_totals(sketch)) == {(r, len(keys)) for r in range(depth)}
    cells = rows(sketch.cells)
    assert all(0 <= r < depth and 0 <= b < width for r, b, _ in cells) and len(cells) <= width * depth
    found = rows(cms.estimate(sketch, counts.count_by(df, "k"), "k"))
    over = [est - n for _, n, est in found]
    assert min(over) >= 0
    # Markov: a row is off by more than 2N/width with probability at most 1/2.
    assert sum(o > 2 * len(keys) / width for o in over) <= len(over) * (0.5**depth + 0.2)


def test_broadcast_and_shuffle_agree(spark):
    df = spark.createDataFrame([(k,) for k in keys_of(1, 3_000, 300)], "k string")
    sketch = cms.build(df, "k", CmsParams(32, 3))
    probes = spark.createDataFrame([("k1",), ("k1",), ("never",), (None,), ("k250",)], "k string")
    one, two = cms.estimate(sketch, probes, "k"), cms.estimate(sketch, probes, "k", as_value=False)
    assert sorted(rows(one), key=str) == sorted(rows(two), key=str)
    assert (None, 0) in rows(one) and len(rows(one)) == 5
    assert "Join" not in plan(one) and "CartesianProduct" not in plan(two) and "NestedLoop" not in plan(two)


def test_empty_sketch(spark):
    sketch = cms.build(spark.createDataFrame([], "k string"), "k")
    probes = spark.createDataFrame([("a",)], "k string")
    assert rows(cms.estimate(sketch, probes, "k")) == [("a", 0)]
    assert rows(cms.estimate(sketch, probes, "k", as_value=False)) == [("a", 0)]


def test_weights_equal_repeats(spark):
    keys = keys_of(2, 500, 20)
    plain = spark.createDataFrame([(k,) for k in keys], "k string")
    summed = spark.createDataFrame(list(Counter(keys).items()), "k string, w long")
    p = CmsParams(16, 2)
    assert row_set(cms.build(plain, "k", p).cells) == row_set(cms.build(summed, "k", p, weight="w").cells)


def test_merge(spark):
    keys = keys_of(3, 900, 50)
    p = CmsParams(16, 2, 9)
    parts = [cms.build(spark.createDataFrame([(k,) for k in keys[i::3]], "k string"), "k", p) for i in range(3)]
    whole = cms.build(spark.createDataFrame([(k,) for k in keys], "k string"), "k", p)
    assert row_set(cms.merge(*parts).cells) == row_set(whole.cells)
    with pytest.raises(ValueError, match="different parameters"):
        cms.merge(parts[0], cms.build(spark.createDataFrame([("a",)], "k string"), "k", CmsParams(16, 2, 8)))


def test_seed_moves_the_buckets(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    one, two = (cms.build(df, "k", CmsParams(1_000, 2, s)).cells for s in (0, 1))
    assert row_set(one) != row_set(two)
    first, second = (row_set(one.where(F.col("row") == r).select("bucket", "n")) for r in (0, 1))
    assert first != second
