"""Exact top-K lists. Ties go to the smaller key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglark import params
from loglark.operators.counts import count_by
from loglark.session import materialize


def order_of(key: str) -> list[Column]:
    return [F.desc("n"), F.asc(key)]


def top_k(df: DataFrame, key: str, k: int | None = None, weight: str | Column | None = None) -> DataFrame:
    """The ``k`` most frequent keys: each task keeps its own best ``k``, then those are merged."""
    return top_of(count_by(df, key, weight), key, k)


#: Up to this many rows a list is gathered from all tasks by one; a longer one is selected where it lies.
GATHERED = 1_000


def top_of(counts: DataFrame, key: str, k: int | None = None) -> DataFrame:
    k = params.top_k(k)
    return counts.orderBy(*order_of(key)).limit(k) if k <= GATHERED else select_top(counts, key, k)


#: Bits of a count that one histogram tells apart.
DIGIT = 12


def _threshold(counts: DataFrame, k: int) -> tuple[int, int] | None:
    """(n, r): keys above ``n`` are all among the first ``k``, and ``r`` more of those with exactly ``n``. None: there are no more than k.

    The count is found digit by digit from the top: a histogram has at most 2^DIGIT rows, whatever the number of keys.
    """
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return None
    width, left, inside = max(0, int(most).bit_length() - DIGIT), k, F.lit(True)
    while True:
        digit = F.shiftrightunsigned(F.col("n"), width)
        found = counts.where(inside).groupBy(digit.alias("d")).agg(F.count("*").alias("keys")).collect()
        for row in sorted(found, key=lambda r: -r["d"]):
            if row["keys"] >= left:
                break
            left -= row["keys"]
        else:
            return None
        if width == 0:
            return row["d"], left
        inside = F.shiftrightunsigned(F.col("n"), width) == row["d"]
        width = max(0, width - DIGIT)


def _first_keys(ties: DataFrame, key: str, r: int) -> DataFrame:
    """The first ``r`` rows in the order of the key: ranges of keys are taken whole, one of them in part."""
    place, position = "_part", "_nth"
    ranged = ties.repartitionByRange(key).sortWithinPartitions(key)
    ranged = materialize(ranged.withColumn(place, F.spark_partition_id()), "ties")
    before = 0
    sizes = ranged.groupBy(place).agg(F.count("*").alias("rows")).orderBy(place).collect()  # a row for each task
    for size in sizes:
        if before + size["rows"] > r:
            break
        before += size["rows"]
    else:
        return ranged.drop(place)
    cut = size[place]
    nth = F.row_number().over(Window.partitionBy(place).orderBy(key))
    part = ranged.where(F.col(place) == cut).withColumn(position, nth).where(F.col(position) <= r - before)
    return ranged.where(F.col(place) < cut).drop(place).unionByName(part.drop(place, position))


def select_top(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The first ``k`` rows of any number, in order and spread over tasks by ranges of that order.

    Histograms of the counts give the threshold; only the keys that have exactly that count are put in order to find the last ones.
    """
    rows = materialize(counts, "selection")
    found = _threshold(rows, k)
    if found is not None:
        n, r = found
        rows = rows.where(F.col("n") > n).unionByName(_first_keys(rows.where(F.col("n") == n), key, r))
    return rows.orderBy(*order_of(key))


def ranked(top: DataFrame, key: str) -> DataFrame:
    """Number the rows of a top-K list. Apply it after the limit: the window holds at most ``k`` rows."""
    rank = F.row_number().over(Window.orderBy(*order_of(key)))
    return top.select(rank.alias("rank"), F.col(key).alias("key"), "n")


#: Parts that the keys of a dimension are ranked in before the dimension as a whole is.
PARTS = 64


def best_per_dim(rows: DataFrame, order: list[Column], limit: int, place: str) -> DataFrame:
    """The first ``limit`` rows of each ``dim``, their position in ``place``.

    There are few dims, so their keys are ranked in parts first; the task that ranks a whole dim gets at most
    ``PARTS * limit`` rows. Tasks cut each part to the limit before they shuffle it.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("dim", "_part").orderBy(*order))
    first = rows.withColumn("_part", part).withColumn("_within", within).where(F.col("_within") <= limit)
    position = F.row_number().over(Window.partitionBy("dim").orderBy(*order))
    return first.drop("_part", "_within").withColumn(place, position).where(F.col(place) <= limit)


def top_per_dim(counts: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` most frequent keys of each dimension, ranked."""
    best = best_per_dim(counts.select("dim", "key", "n"), order_of("key"), params.top_k(k), "rank")
    return best.select("dim", "rank", "key", "n")
