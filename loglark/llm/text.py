"""Small helpers shared by the operators: tables, row folds, and how texts become bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglark.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: Column) -> Column:
    """The bytes of a text; a null text is empty. Workers get bytes, so no text is decoded that need not be."""
    return F.coalesce(col, F.lit("")).cast("binary")


def fold_of(doc_id: Column, folds: int) -> Column:
    """Which of ``folds`` parts a row belongs to: the CRC-32 of its id as text. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as one more column, computed once for each row however often it is used later.

    A generator of one element stands in between, as the optimizer would copy the expression to each use.
    """
    return df.select(*columns(df), F.explode(F.array(value)).alias(name))
