"""Keeping a costly expression single."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, also where later filters use it.

    Catalyst copies the expression of an ordinary column into the filters on it. It does not look through a
    generator, and the explode of a one-element array gives exactly one row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
