import re

import pytest
from pyspark.sql import functions as F

from helpers import GOOD, lines, plan, row_set, rows
from loglark.operators import counts, topk
from loglark.operators.parse import parse_logs
from loglark.session import settings

A = '192.0.2.17 - - [03/Mar/2024:21:14:05 -0300] "GET /shelf/7 HTTP/1.1" 200 812'
B = '198.51.100.4 - - [03/Mar/2024:21:14:09 -0300] "PUT /basket HTTP/1.1" 403 77'


def test_three_lines(spark):
    parsed = parse_logs(lines(spark, A, A, B))
    assert rows(counts.totals(parsed)) == [(3, 0)]
    assert row_set(counts.count_by(parsed.where("ok"), "status")) == {(200, 2), (403, 1)}
    assert row_set(counts.all_counts(parsed)) == {
        ("total", "", 3),
        ("ip", "192.0.2.17", 2),
        ("ip", "198.51.100.4", 1),
        ("endpoint", "/shelf/7", 2),
        ("endpoint", "/basket", 1),
        ("status", "200", 2),
        ("status", "403", 1),
    }


def test_errors_are_counted_apart(spark):
    parsed = parse_logs(lines(spark, GOOD, "", "bad", None))
    assert rows(counts.totals(parsed)) == [(1, 3)]
    assert ("error", "", 3) in row_set(counts.all_counts(parsed))


def test_nothing(spark):
    parsed = parse_logs(lines(spark).limit(0))
    assert rows(counts.totals(parsed)) == [(0, 0)]
    assert rows(counts.all_counts(parsed)) == []


def test_counts_and_errors_add_up(spark):
    old, new = parse_logs(lines(spark, A, "x")), parse_logs(lines(spark, A, B))
    whole = parse_logs(lines(spark, A, "x", A, B))
    merged = counts.add_counts(counts.all_counts(old), counts.all_counts(new))
    assert row_set(merged) == row_set(counts.all_counts(whole))


def test_weights(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("b", 0), ("c", None), ("d", 1)], "k string, w long")
    assert row_set(counts.count_by(df, "k", weight="w")) == {("a", 5), ("d", 1)}
    negative = spark.createDataFrame([("a", -1)], "k string, w long")
    with pytest.raises(Exception, match="must not be negative"):
        counts.count_by(negative, "k", weight="w").collect()
    for kind in ("double", "decimal(9,1)", "string"):
        with pytest.raises(ValueError, match="whole numbers"):
            counts.count_by(df.withColumn("w", F.lit(0.5).cast(kind)), "k", weight="w")
    assert row_set(counts.count_by(df.withColumn("w", F.lit(2).cast("decimal(9,0)")), "k", weight="w")) >= {("a", 4)}


def test_top_k_ties_and_limits(spark):
    df = spark.createDataFrame([(k,) for k in "ccbbaad"], "k string")
    assert rows(topk.top_k(df, "k", 2)) == [("a", 2), ("b", 2)]
    assert rows(topk.ranked(topk.top_k(df, "k", 3), "k")) == [(1, "a", 2), (2, "b", 2), (3, "c", 2)]
    many = spark.range(50).select(F.col("id").cast("string").alias("k"))
    assert topk.top_k(many, "k", 0).count() == 10
    assert topk.top_k(spark.range(20_500).select(F.col("id").alias("k")), "k", 30_000).count() == 20_500


def test_selection_of_any_length(spark, monkeypatch):
    """Counts of every size, many ties at the threshold, null keys: held against a sort."""
    table = [(f"k{i * 37 % 1000:03d}", [1, 1, 2, 5, 4096, 5000, 1 << 40][i % 7] + (i % 3 if i % 7 > 3 else 0)) for i in range(1000)]
    table.append((None, 1))
    df = spark.createDataFrame(table, "k string, n long").repartition(5)
    want = sorted(table, key=lambda r: (-r[1], r[0] is not None, r[0] or ""))
    monkeypatch.setattr(topk, "GATHERED", 0)
    monkeypatch.setattr(topk, "DIGIT", 3)
    for k in (1, 144, 573, 1001, 5000):
        assert rows(topk.top_of(df, "k", k)) == want[:k], k
    assert rows(topk.top_of(df.limit(0), "k", 5)) == []


def test_a_long_selection_stays_spread(spark):
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("n"))
    out = topk.top_of(df, "k", 30_500)
    text = plan(out)
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text and "SinglePartition" not in text
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_500 and max(sizes) < 3 * 30_500 / 8
    assert out.where("n = 2").agg(F.max("k"), F.count("*")).first()[:] == (24_992, 2_500)


def test_top_per_dim(spark):
    table = spark.createDataFrame(
        [("x", "a", 1), ("x", "b", 3), ("x", "c", 2), ("y", "a", 9)], "dim string, key string, n long"
    )
    assert row_set(topk.top_per_dim(table, 2)) == {("x", 1, "b", 3), ("x", 2, "c", 2), ("y", 1, "a", 9)}


def test_plans(spark, tmp_path):
    lines(spark, A, B).write.text(str(tmp_path / "in"))
    parsed = parse_logs(spark.read.text(str(tmp_path / "in")))
    fan_out = plan(counts.all_counts(parsed))
    assert fan_out.count("Exchange") == 1 and fan_out.count("HashAggregate") == 2
    top = plan(topk.ranked(topk.top_k(parsed.where("ok"), "ip", 5), "ip"))
    assert "TakeOrderedAndProject" in top and top.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in top
    per_dim = plan(topk.top_per_dim(counts.all_counts(parsed), 5))
    # Ranked in parts of a dimension first, so no task gets more than parts x k rows of it.
    assert per_dim.count("WindowGroupLimit") == 4
    assert re.search(r"Exchange hashpartitioning\(dim#\d+, _part#\d+", per_dim)


def test_parquet_counts_read_one_column(spark, tmp_path):
    parse_logs(lines(spark, A, B)).write.parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    text = plan(topk.top_k(table.where("status = 200"), "ip", 5))
    assert "ReadSchema: struct<ip:string,status:int>" in text
    assert "EqualTo(status,200)" in text


def test_query_param_and_path_counts(spark):
    df = spark.createDataFrame([("/a?k=1",), ("/a?k=2",), ("/b?k=1",), ("/b",)], "endpoint string")
    assert row_set(counts.count_by_query_param(df, "endpoint", "k")) == {("1", 2), ("2", 1)}
    assert row_set(counts.count_by_path(df, "endpoint")) == {("/a", 2), ("/b", 2)}
