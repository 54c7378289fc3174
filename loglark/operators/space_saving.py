"""Space-Saving heavy hitters: at most ``capacity`` counters per summary, never below the true count.

With m counters over total weight N: ``true <= n <= true + N/m``, ``n - err <= true``, and every key above N/m is
listed. ``floor`` bounds the count of every key that is not listed.

Merging gives a key, for each part that does not list it, that part's floor as both count and error. With T the sum
of all floors this is ``sum(n - floor) + T`` over the parts that list the key, so one grouping is enough: T is the
same for all keys and does not change their order. T reaches the end of the plan as one extra row, made from
the rank-1 row of each part. The merged floor is the count of the first key cut off, or T if none was. These
merges can be repeated: they keep ``n >= floor`` and ``sum(n - floor) <= N - m * floor``, from which the bounds follow
(Agarwal et al., "Mergeable Summaries", PODS 2012). Feed ``build`` from a scan or a written table, so that a task that
is run again gives the same summary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglark import params, schema
from loglark.operators import _partials, task_summaries


@dataclass(frozen=True)
class SpaceSaving:
    """Counters ``(dim, rank, key, n, err, floor)``, one summary per ``dim``."""

    rows: DataFrame
    capacity: int
    split: bool = False


def _merged(rows: DataFrame, capacity: int, split: bool) -> DataFrame:
    def entry(key: Column, over: Column, err: Column) -> Column:
        return F.struct(key.alias("key"), over.alias("over"), err.alias("err_over"))

    floor = F.col("floor")
    own = entry(F.col("key"), F.col("n") - floor, F.col("err") - floor)
    extra = entry(F.lit(None).cast("string"), floor, floor)
    entries = rows.select(
        "dim", F.inline(F.when(F.col("rank") == 1, F.array(own, extra)).otherwise(F.array(own)))
    )
    sums = entries.groupBy("dim", "key").agg(F.sum("over").alias("over"), F.sum("err_over").alias("err_over"))
    # The NULL key is the extra row with T. Not split: one dim, so it comes first overall as well.
    order = [F.col("key").isNotNull().asc(), F.desc("over"), F.asc("key")]
    best = _partials.best_per_dim(sums, order, capacity + 2, split)
    # At most capacity+2 rows per dim are left, so this window is small.
    whole = Window.partitionBy("dim")
    floors = F.max(F.when(F.col("key").isNull(), F.col("over"))).over(whole)
    first_cut = F.max(F.when(F.col("_r") == capacity + 2, F.col("over"))).over(whole)
    return (
        best.withColumn("_t", floors)
        .withColumn("_cut", F.coalesce(first_cut, F.lit(0).cast("bigint")))
        .where(f"key IS NOT NULL AND _r <= {capacity + 1}")
        .selectExpr(
            "dim",
            "_r - 1 AS rank",
            "key",
            "over + _t AS n",
            "err_over + _t AS err",
            "_cut + _t AS floor",
        )
    )


def build(
    df: DataFrame,
    key: str | Column,
    capacity: int | None = None,
    weight: str | Column | None = None,
    by: str | Column | None = None,
    groups: int | None = None,
) -> SpaceSaving:
    """Summarize ``df``, one summary per value of ``by`` (few values). Each task ships its summary only.

    With very many tasks, ``groups`` folds their summaries in as many tasks first (see ``_partials.folded``).
    """
    capacity = params.capacity(capacity)
    summarize, fold = task_summaries.space_saving, task_summaries.fold_space_saving

    def partial(batches):
        return summarize(batches, capacity)

    def combined(batches):
        return fold(batches, capacity)

    partials = _partials.keyed_weights(df, key, weight, by).mapInArrow(partial, schema.SS)
    return from_partials(_partials.folded(partials, combined, schema.SS, groups), capacity, by is not None)


def from_partials(rows: DataFrame, capacity: int, split: bool) -> SpaceSaving:
    """The summary of the rows that tasks have summarized."""
    return SpaceSaving(_merged(rows, capacity, split), capacity, split)


def from_parts(rows: DataFrame, capacity: int) -> SpaceSaving:
    """The summary of (dim, key, n, err, floor) rows of summaries whose keys are apart, each with at most ``capacity`` counters.

    A key is then counted in one part alone, and the floors of the other parts do not concern it. The first key cut off
    bounds all others that are; one that its own part has cut off is bounded by the floor of that part.
    """
    best = _partials.best_per_dim(rows, [F.desc("n"), F.asc("key")], capacity + 1, True)
    whole = Window.partitionBy("dim")
    first_cut = F.max(F.when(F.col("_r") == capacity + 1, F.col("n"))).over(whole)
    # A floor is at most the least count of its part, so those of parts with no row among the best are below the first cut.
    floor = F.greatest(F.coalesce(first_cut, F.lit(0).cast("bigint")), F.max("floor").over(whole))
    kept = best.withColumn("_floor", floor).where(F.col("_r") <= capacity)
    found = kept.select("dim", F.col("_r").alias("rank"), "key", "n", "err", F.col("_floor").alias("floor"))
    return SpaceSaving(found, capacity, True)


def merge(*summaries: SpaceSaving) -> SpaceSaving:
    """Summary of the union of the inputs. All capacities must agree."""
    first = summaries[0]
    if any(s.capacity != first.capacity for s in summaries):
        raise ValueError("Space-Saving summaries of different capacity cannot be merged")
    rows = reduce(DataFrame.unionByName, [s.rows for s in summaries])
    split = any(s.split for s in summaries)
    return SpaceSaving(_merged(rows, first.capacity, split), first.capacity, split)


def top(summary: SpaceSaving, k: int | None = None, dim: str = _partials.SINGLE) -> DataFrame:
    """The ``k`` largest counters of one dim, with their error; all of them for ``k=None``."""
    rows = (
        summary.rows.where(F.col("dim") == dim)
        .select("key", "n", "err", (F.col("n") - F.col("err")).alias("guaranteed"))
        .orderBy(F.desc("n"), F.asc("key"))
    )
    return rows if k is None else rows.limit(params.top_k(k))


def estimate(
    summary: SpaceSaving,
    probes: DataFrame,
    key: str,
    dim: str = _partials.SINGLE,
    name: str = "est",
    err_name: str | None = None,
) -> DataFrame:
    """Add the counter of each probe key, and its error if ``err_name`` is given; 0 if it is not tracked."""
    rows = summary.rows.where(F.col("dim") == dim).select(
        F.col("key").alias("_k"), F.col("n").alias("_n"), F.col("err").alias("_err")
    )
    columns = {name: F.col("_n")}
    if err_name:
        columns[err_name] = F.col("_err")
    return _partials.lookup(rows, probes, key, columns)
