"""What the two heavy-hitter operators share: weighted (dim, key, w) rows fed to per-task Arrow summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglark.functions.weight import column, weighted
from loglark.operators import topk

SINGLE = ""


def keyed_weights(
    df: DataFrame, key: str | Column, weight: str | Column | None, by: str | Column | None
) -> DataFrame:
    """Rows (dim, key, w) without NULL keys. ``dim`` is one constant where there is no ``by``."""
    dim = F.lit(SINGLE) if by is None else column(by).cast("string")
    rows, amount = weighted(df, [dim.alias("dim"), column(key).cast("string").alias("key")], weight)
    return rows.where("dim IS NOT NULL AND key IS NOT NULL").select("dim", "key", amount.alias("w"))


def folded(rows: DataFrame, fold, schema: StructType, groups: int | None) -> DataFrame:
    """The summaries of tasks folded into those of ``groups`` tasks, so at most groups x capacity rows of a dim go on.

    The summaries of a task go to one group whole. Without ``groups`` they stay as they are.
    """
    if groups is None:
        return rows
    dealt = rows.withColumn("_task", F.spark_partition_id()).repartition(groups, F.pmod("_task", F.lit(groups)))
    return dealt.drop("_task").mapInArrow(fold, schema)


def best_per_dim(rows: DataFrame, order: list[Column], limit: int, split: bool) -> DataFrame:
    """The first ``limit`` rows of each dim with their position ``_r``; tasks cut to the limit first."""
    if split:
        return topk.best_per_dim(rows, order, limit, "_r")
    position = F.row_number().over(Window.partitionBy("dim").orderBy(*order))
    return rows.orderBy(*order).limit(limit).withColumn("_r", position)


def lookup(counters: DataFrame, probes: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Left join of the probes with counters keyed ``_k``; missing values become 0.

    Keys can be long, so the size in bytes of the counters is not known here; adaptive execution picks the join by it.
    """
    joined = probes.join(counters, F.col(key).cast("string") == F.col("_k"), "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(*probes.columns, *(F.coalesce(c, zero).alias(n) for n, c in columns.items()))
