"""Late events: those older than the window that ends at the newest second seen so far."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, TimestampNTZType, TimestampType

from loglark import params
from loglark.functions.weight import column
from loglark.session import use_utc

#: Rows that are looked at for each range of the order.
SAMPLED = 50


def _newest_before(partition: list[str], order: list[str]) -> Column:
    earlier = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max("_s").over(earlier)


def _comparable(df: DataFrame, value: Column) -> Column:
    """Times as numbers, which compare alike in the driver and in the workers."""
    kind = df.select(value).schema[0].dataType
    return F.unix_micros(value.cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType)) else value


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """(arrival, tie) pairs that cut the rows into ``parts`` ranges of about equal size, from a sample of a bounded size."""
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    found = rows.select("_a", "_t").sample(share, seed=1).collect()
    some = sorted(((r["_a"], r["_t"]) for r in found), key=lambda pair: tuple((v is not None, v) for v in pair))
    return list(dict.fromkeys(some[len(some) * k // parts] for k in range(1, parts))) if some else []


def _range_of(bounds: list[tuple]):
    """The number of the range that an (arrival, tie) lies in. Nulls come first."""
    keys = [tuple((v is not None, v) for v in pair) for pair in bounds]

    @F.arrow_udf(IntegerType())
    def number(arrivals: pa.Array, ties: pa.Array) -> pa.Array:
        pairs = zip(arrivals.to_pylist(), ties.to_pylist())
        return pa.array([bisect_right(keys, ((a is not None, a), (t is not None, t))) for a, t in pairs], pa.int32())

    return number


def mark_late(
    df: DataFrame,
    arrival: str | Column,
    tie: str | Column,
    ts: str | Column,
    window: int,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``late``: the second lies before (newest second of all earlier arrivals) - (window - 1).

    Rows are ordered by ``arrival``, then ``tie``, and cut into ranges of that order (``partitions``, or as many as the session
    shuffles into) at fixed values, which a sample of the two columns gives: the result does not depend on them, only the sizes of the
    ranges do. Each range is summed up in one row, its newest second, and the running maximum of these is what stands before a
    range; inside of it an ordered window does the same. A busy arrival is cut by its ties, so no task gets more than its range, and
    the rows are shuffled once and written nowhere.
    """
    window = params.positive("window", window)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    use_utc(df.sparkSession)
    rows = df.withColumns(
        {"_a": _comparable(df, column(arrival)), "_t": _comparable(df, column(tie)), "_s": F.unix_timestamp(F.date_trunc("second", column(ts)))}
    )
    number = _range_of(_bounds(rows, parts))
    ranged = rows.withColumn("_p", number("_a", "_t"))
    ranges = ranged.groupBy("_p").agg(F.max("_s").alias("_s"))
    ranges = ranges.select("_p", _newest_before([], ["_p"]).alias("_before"))
    newest = F.greatest(_newest_before(["_p"], ["_a", "_t"]), F.col("_before"))
    late = F.coalesce(F.col("_s") < newest - F.lit(window - 1), F.lit(False))
    # One row per range: the number of ranges is a setting, not a property of the data.
    return ranged.join(F.broadcast(ranges), "_p").select(*df.columns, late.alias("late"))
