"""Misra-Gries heavy hitters: at most ``capacity`` counters per summary, never above the true count.

With k counters over total weight N: ``true - N/(k+1) <= n <= true``, and every key above N/(k+1) is listed.
Merging sums the counters and takes the (k+1)-th largest off all of them (Agarwal et al., "Mergeable
Summaries", PODS 2012). A plain count is a summary without error, so the same step folds the batches of a task,
joins the tasks, and merges stored summaries. Feed ``build`` from a scan or a written table: a task that is
run again then sees its rows in the same order and gives the same summary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglark import params, schema
from loglark.operators import _partials, task_summaries


@dataclass(frozen=True)
class MisraGries:
    """Counters ``(dim, key, n)``, one summary per ``dim``."""

    rows: DataFrame
    capacity: int
    split: bool = False


def _merged(rows: DataFrame, capacity: int, split: bool) -> DataFrame:
    sums = rows.groupBy("dim", "key").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("key")]
    best = _partials.best_per_dim(sums, order, capacity + 1, split)
    # At most capacity+1 rows per dim are left, so this window is small.
    surplus = F.max(F.when(F.col("_r") == capacity + 1, F.col("n"))).over(Window.partitionBy("dim"))
    left = F.col("n") - F.coalesce(surplus, F.lit(0).cast("bigint"))
    return best.select("dim", "key", left.alias("n")).where("n > 0")


def build(
    df: DataFrame,
    key: str | Column,
    capacity: int | None = None,
    weight: str | Column | None = None,
    by: str | Column | None = None,
    groups: int | None = None,
) -> MisraGries:
    """Summarize ``df``, one summary per value of ``by`` (few values). Each task ships its summary only.

    With very many tasks, ``groups`` folds their summaries in as many tasks first (see ``_partials.folded``).
    """
    capacity = params.capacity(capacity)
    summarize = task_summaries.misra_gries

    def partial(batches):
        return summarize(batches, capacity)

    partials = _partials.keyed_weights(df, key, weight, by).mapInArrow(partial, schema.MG)
    renamed = partials if groups is None else partials.withColumnRenamed("n", "w")  # a counter is a weighted key
    return from_partials(_partials.folded(renamed, partial, schema.MG, groups), capacity, by is not None)


def from_partials(rows: DataFrame, capacity: int, split: bool) -> MisraGries:
    """The summary of the rows that tasks have summarized."""
    return MisraGries(_merged(rows, capacity, split), capacity, split)


def merge(*summaries: MisraGries) -> MisraGries:
    """Summary of the union of the inputs. All capacities must agree."""
    first = summaries[0]
    if any(s.capacity != first.capacity for s in summaries):
        raise ValueError("Misra-Gries summaries of different capacity cannot be merged")
    rows = reduce(DataFrame.unionByName, [s.rows for s in summaries])
    split = any(s.split for s in summaries)
    return MisraGries(_merged(rows, first.capacity, split), first.capacity, split)


def top(summary: MisraGries, k: int | None = None, dim: str = _partials.SINGLE) -> DataFrame:
    """The ``k`` largest counters of one dim; all of them for ``k=None``."""
    rows = summary.rows.where(F.col("dim") == dim).select("key", "n").orderBy(F.desc("n"), F.asc("key"))
    return rows if k is None else rows.limit(params.top_k(k))


def estimate(
    summary: MisraGries, probes: DataFrame, key: str, dim: str = _partials.SINGLE, name: str = "est"
) -> DataFrame:
    """Add the counter of each probe key; 0 if it is not tracked."""
    rows = summary.rows.where(F.col("dim") == dim).select(
        F.col("key").alias("_k"), F.col("n").alias("_n")
    )
    return _partials.lookup(rows, probes, key, {name: F.col("_n")})
