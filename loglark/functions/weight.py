"""The optional weight argument of the counting operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NullType


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def weighted(df: DataFrame, keys: list[Column], weight: str | Column | None) -> tuple[DataFrame, Column]:
    """The key columns plus what to sum: 1 per row, or the weight.

    Rows of weight 0 or NULL add nothing and are left out; a negative weight fails the query. Weights are whole numbers: a
    column of another type is an error, as its fractions would be lost.
    """
    if weight is None:
        return df.select(*keys), F.lit(1).cast("bigint")
    kind = df.select(column(weight)).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)) and not (isinstance(kind, DecimalType) and kind.scale == 0):
        raise ValueError(f"weights must be whole numbers, got a column of type {kind.simpleString()}")
    w = column(weight).cast("bigint")
    checked = F.when(w < 0, F.raise_error(F.lit("a weight must not be negative"))).otherwise(w)
    return df.select(*keys, checked.alias("_w")).where(F.col("_w") > 0), F.col("_w")
