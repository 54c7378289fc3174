"""Exact counts. Every grouping sums within each task first, so a hot key costs one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loglark import schema
from loglark.functions.once import with_once
from loglark.functions.text import path_of, query_param
from loglark.functions.weight import column, weighted
from loglark.session import materialize


def count_by(df: DataFrame, key: str | list[str], weight: str | Column | None = None) -> DataFrame:
    """``n`` per value of the key column(s)."""
    keys = [key] if isinstance(key, str) else list(key)
    rows, amount = weighted(df, [F.col(k) for k in keys], weight)
    return rows.groupBy(*keys).agg(F.sum(amount).alias("n"))


def _amounts() -> list[Column]:
    return [F.count_if("ok").alias("total_lines"), F.count_if(~F.col("ok")).alias("parse_errors")]


def totals(parsed: DataFrame) -> DataFrame:
    """One row: parsed lines and parse errors."""
    return parsed.agg(*_amounts())


def observed(parsed: DataFrame, name: str = "totals") -> tuple[DataFrame, Observation]:
    """``parsed`` with its totals collected by the way of the first job that is run from it: no further scan, no shuffle.

    ``Observation.get`` has them once that job is done. It must use all rows: a limit above would cut the totals as well.
    """
    found = Observation(name)
    return parsed.observe(found, *_amounts()), found


def observed_stream(parsed: DataFrame, name: str = "totals") -> DataFrame:
    """The same for a stream: each progress of its query, and so every listener, has the totals of the batch under ``name``."""
    return parsed.observe(name, *_amounts())


def fan_out(parsed: DataFrame, with_seconds: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Each line as the (dim, key) pairs it counts towards, beside its columns ``by``."""

    def pair(dim: str, key: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), key.alias("key"))

    pairs = [
        pair(schema.DIM_TOTAL, F.lit("")),
        pair(schema.DIM_IP, F.col("ip")),
        pair(schema.DIM_ENDPOINT, F.col("endpoint")),
        pair(schema.DIM_STATUS, F.col("status").cast("string")),
    ]
    if with_seconds:
        pairs.append(pair(schema.DIM_SECOND, F.unix_timestamp("ts_received").cast("string")))
    error = F.array(pair(schema.DIM_ERROR, F.lit("")))
    return parsed.select(*by, F.inline(F.when(F.col("ok"), F.array(*pairs)).otherwise(error)))


def all_counts(parsed: DataFrame, with_seconds: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Total, errors and the counts per client, endpoint and status (and columns ``by``): one scan, one shuffle.

    Works on batch and on streaming DataFrames.
    """
    return fan_out(parsed, with_seconds, by).groupBy(*by, "dim", "key").agg(F.count(F.lit(1)).alias("n"))


def buckets_of(seconds: DataFrame) -> DataFrame:
    """The bucket table held in the "second" rows of a fan-out. Lines without a time are in no bucket."""
    sec = F.timestamp_seconds(F.col("key").cast("bigint"))
    return seconds.where("key IS NOT NULL").select(sec.alias("sec"), "n")


def counts_and_buckets(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """COUNTS and the lines per second from one scan. The result is written once, as both parts come from it."""
    return split_seconds(materialize(all_counts(parsed, with_seconds=True), "counts"))


def split_seconds(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts of a fan-out that was counted ``with_seconds``."""
    seconds = F.col("dim") == schema.DIM_SECOND
    return both.where(~seconds), buckets_of(both.where(seconds))


def add_counts(*parts: DataFrame) -> DataFrame:
    """Sum COUNTS tables of disjoint inputs."""
    both = parts[0].select("dim", "key", "n")
    for part in parts[1:]:
        both = both.unionByName(part.select("dim", "key", "n"))
    return both.groupBy("dim", "key").agg(F.sum("n").alias("n"))


def count_by_query_param(
    df: DataFrame, endpoint: str | Column, param: str, name: str = "param_value"
) -> DataFrame:
    """Rows per decoded value of one query parameter; rows without it are left out."""
    values = with_once(df.select(column(endpoint).alias("_e")), name, query_param(F.col("_e"), param))
    return count_by(values.where(F.col(name).isNotNull()), name)


def count_by_path(df: DataFrame, endpoint: str | Column) -> DataFrame:
    """Rows per endpoint without its query string."""
    return count_by(df.select(path_of(column(endpoint)).alias("path")), "path")
