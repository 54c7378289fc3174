"""Per-second series, trailing rates, hopping windows, retention.

A bucket table ``(sec, n)`` has at most one row per second (and key), so all of these after ``per_second`` work on
data that no longer grows with the traffic.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from loglark import params
from loglark.functions.weight import column, weighted

MIN_CHUNK_SECONDS = 3_600


def per_second(
    df: DataFrame,
    ts: str | Column = "ts_received",
    by: list[str] | None = None,
    weight: str | Column | None = None,
) -> DataFrame:
    """Rows per absolute second (and key). Rows without a time are left out."""
    by = by or []
    second = F.date_trunc("second", column(ts)).alias("sec")
    rows, amount = weighted(df, [*(F.col(c) for c in by), second], weight)
    return rows.where("sec IS NOT NULL").groupBy(*by, "sec").agg(F.sum(amount).alias("n"))


def last_second(buckets: DataFrame) -> Column:
    """The newest second of the table, as a scalar to pass for ``as_of``."""
    return buckets.agg(F.max("sec")).scalar()


def newest(df: DataFrame, ts: str = "ts_received") -> datetime | None:
    """The newest time of the rows; on Parquet the scan reads one column."""
    return df.agg(F.max(ts)).first()[0]


def recent(df: DataFrame, ts: str, seconds: int, as_of: datetime) -> DataFrame:
    """The rows of the last ``seconds`` seconds up to ``as_of``, both whole seconds.

    The bound is on the time column itself, in its own type, so a scan of a table skips all files and row groups that are
    older. Apply it before ``per_second``.
    """
    kind = df.schema[ts].dataType

    def bound(value: datetime) -> Column:
        # A time without a zone must not pass through the zone of this process.
        return F.lit(str(value)).cast(kind) if isinstance(kind, TimestampNTZType) else F.lit(value)

    end = as_of.replace(microsecond=0) + timedelta(seconds=1)
    start = end - timedelta(seconds=params.positive("seconds", seconds))
    return df.where((F.col(ts) >= bound(start)) & (F.col(ts) < bound(end)))


def rate_last_n(
    buckets: DataFrame,
    n: int | None = None,
    as_of: Column | None = None,
    retention: int | None = None,
) -> DataFrame:
    """One row: events per second over the ``n`` seconds up to ``as_of`` (default: now).

    A ``retention`` given for the buckets must cover ``n``.
    """
    n = params.rate_seconds(n)
    params.retention(retention, n)
    if n == 0:
        return buckets.sparkSession.range(1).select(F.lit(0.0).alias("rate"))
    end = F.current_timestamp() if as_of is None else as_of
    inside = buckets.where((F.col("sec") > end - F.make_dt_interval(secs=F.lit(n))) & (F.col("sec") <= end))
    return inside.agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(n))).alias("rate"))


def rate_series(
    buckets: DataFrame,
    n: int | None = None,
    by: list[str] | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """The trailing ``n``-second rate at every second that has events.

    Time is cut into chunks of at least ``n`` seconds, and the last n-1 seconds of a chunk are copied into the next. A
    task then needs one chunk of one key, at most chunk + n - 1 rows, however long the series or busy the key. The
    trailing sum is the difference of two running sums, which costs the same for every ``n``.
    """
    n = params.positive("n", params.rate_seconds(n))
    by = by or []
    chunk = max(n, MIN_CHUNK_SECONDS if chunk is None else chunk)
    second = F.unix_timestamp("sec")
    own = F.floor(second / F.lit(chunk))
    placed = buckets.select(*by, "sec", "n", second.alias("_s"), own.alias("_own")).select(
        "*",
        F.explode(
            F.when((F.col("_own") + 1) * chunk - F.col("_s") < n, F.array("_own", F.col("_own") + 1)).otherwise(
                F.array("_own")
            )
        ).alias("_chunk"),
    )
    in_order = Window.partitionBy(*by, "_chunk").orderBy("_s")
    so_far = F.sum("n").over(in_order.rangeBetween(Window.unboundedPreceding, 0))
    too_old = F.sum("n").over(in_order.rangeBetween(Window.unboundedPreceding, -n))
    rate = (so_far - F.coalesce(too_old, F.lit(0))) / F.lit(float(n))
    return placed.withColumn("rate", rate).where("_chunk = _own").select(*by, "sec", "rate")


def hopping(
    df: DataFrame,
    ts: str | Column,
    size: int,
    slide: int,
    by: list[str] | None = None,
    weight: str | Column | None = None,
) -> DataFrame:
    """Rows per window of ``size`` seconds starting every ``slide`` seconds.

    Rows are first counted in panes (the common divisor of size and slide); only panes are spread over windows.
    """
    size, slide = params.positive("size", size), params.positive("slide", slide)
    if slide > size:
        raise ValueError("slide must not exceed size")
    by = by or []
    pane = f"{math.gcd(size, slide)} seconds"
    rows, amount = weighted(df, [*(F.col(c) for c in by), column(ts).alias("_ts")], weight)
    panes = (
        rows.where("_ts IS NOT NULL")
        .groupBy(*by, F.window("_ts", pane).alias("_p"))
        .agg(F.sum(amount).alias("_n"))
        .select(*by, "_n", F.col("_p.start").alias("_start"))
    )
    windows = panes.groupBy(*by, F.window("_start", f"{size} seconds", f"{slide} seconds").alias("_w"))
    return windows.agg(F.sum("_n").alias("n")).select(
        *by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n"
    )


def retain(buckets: DataFrame, seconds: int | None = None, as_of: Column | None = None) -> DataFrame:
    """The buckets of the last ``seconds`` seconds up to ``as_of`` (default: the newest bucket)."""
    end = last_second(buckets) if as_of is None else as_of
    return buckets.where(F.col("sec") > end - F.make_dt_interval(secs=F.lit(params.retention(seconds))))
