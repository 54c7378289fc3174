"""Small builders shared by the tests."""

from pyspark.sql import DataFrame, SparkSession

GOOD = '203.0.113.9 - - [11/Nov/2023:04:31:52 +0100] "GET /atlas/maps.html HTTP/1.1" 200 5077'


def lines(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def row_set(df: DataFrame) -> set[tuple]:
    got = rows(df)
    assert len(got) == len(set(got))
    return set(got)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
