"""Parquet folders that ``foreachBatch`` fills: one part for each micro-batch, so a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglark.session import path_is_missing


@dataclass(frozen=True)
class Kept:
    """The parts of a folder, told apart by ``batch_id``. What is current is an ordinary grouping over them."""

    path: str
    layout: T.StructType

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.select(*self.layout.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with their ``batch_id``; none if nothing was written yet."""
        layout = T.StructType([*self.layout.fields, T.StructField("batch_id", T.LongType())])
        try:
            return spark.read.schema(layout).parquet(self.path)
        except AnalysisException as error:
            if not path_is_missing(error):
                raise
            return spark.createDataFrame([], layout)

    def batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.rows(spark).where(F.col("batch_id") == batch_id).drop("batch_id")

    def newest(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows of the newest batch that has any, of those before a batch if one is given. The id is read from the folders' names."""
        rows = self.rows(spark)
        rows = rows if before is None else rows.where(F.col("batch_id") < before)
        return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).drop("batch_id")


def newest_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The values that the newest batch gives each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return found.select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def sum_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The sum over all batches for each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def compact(spark: SparkSession, table: Kept, to: str, current: Callable[[DataFrame], DataFrame]) -> Kept:
    """Copy ``table`` to a new folder with all batches but the newest as one. Run it between two runs of the query.

    The newest batch stays as it is, as it is the only one that a restart may write again. The next run gets the new folder.
    """
    rows = table.rows(spark)
    last = rows.agg(F.max("batch_id")).first()[0]
    out = Kept(to, table.layout)
    if last is not None:
        out.write(table.batch(spark, last), last)
        out.write(current(rows.where(F.col("batch_id") < last)), last - 1)
    return out
