"""Count-min sketch as a table of cells.

``true <= estimate`` always, and ``estimate <= true + 2 N / width`` with probability at least 1 - 2^-depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglark.functions.weight import weighted
from loglark.params import CmsParams

@dataclass(frozen=True)
class CountMin:
    """Cells ``(row, bucket, n)``; cells that are zero may be missing."""

    cells: DataFrame
    params: CmsParams


def _bucket(row: int, key: Column, params: CmsParams) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), F.lit(params.seed), key), F.lit(params.width).cast("bigint"))


def _positions(key: Column, params: CmsParams) -> Column:
    return F.array(
        *(
            F.struct(F.lit(r).alias("row"), _bucket(r, key, params).alias("bucket"))
            for r in range(params.depth)
        )
    )


def build(
    df: DataFrame,
    key: str,
    params: CmsParams | None = None,
    weight: str | Column | None = None,
) -> CountMin:
    """At most width x depth cells leave each task. NULL keys are left out. Batch or streaming."""
    params = params or CmsParams()
    rows, amount = weighted(df, [F.col(key).cast("string").alias("_k")], weight)
    placed = rows.where(F.col("_k").isNotNull()).select(
        F.inline(_positions(F.col("_k"), params)), amount.alias("n")
    )
    return CountMin(placed.groupBy("row", "bucket").agg(F.sum("n").alias("n")), params)


def merge(*sketches: CountMin) -> CountMin:
    """Sketch of the union of the inputs. All parameters must agree."""
    params = sketches[0].params
    if any(s.params != params for s in sketches):
        raise ValueError("count-min sketches with different parameters cannot be merged")
    cells = reduce(DataFrame.unionByName, [s.cells.select("row", "bucket", "n") for s in sketches])
    return CountMin(cells.groupBy("row", "bucket").agg(F.sum("n").alias("n")), params)


def _as_one_row(sketch: CountMin) -> DataFrame:
    """All cells as ARRAY<ARRAY<BIGINT>>, zeros filled in. The size is fixed by the parameters."""
    p = sketch.params
    spark = sketch.cells.sparkSession
    zeros = spark.range(p.width).select(
        F.explode(F.array(*(F.lit(r) for r in range(p.depth)))).alias("row"),
        F.col("id").alias("bucket"),
        F.lit(0).cast("bigint").alias("n"),
    )
    full = sketch.cells.select("row", "bucket", "n").unionByName(zeros)
    summed = full.groupBy("row", "bucket").agg(F.sum("n").alias("n"))

    def in_order(index: str, value: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(index, value)))
        return F.transform(pairs, lambda pair: pair[value])

    rows = summed.groupBy("row").agg(in_order("bucket", "n").alias("ns"))
    return rows.agg(in_order("row", "ns").alias("_table"))


def estimate(
    sketch: CountMin,
    probes: DataFrame,
    key: str,
    name: str = "est",
    as_value: bool = True,
) -> DataFrame:
    """Add the estimated count of each probe key; 0 if unseen or NULL.

    The sketch travels with the query as one value of eight bytes a cell, so its size is fixed by its parameters. For one
    too large for that, ``as_value=False`` looks the cells up by shuffle.
    """
    p = sketch.params
    text = F.col(key).cast("string")
    zero = F.lit(0).cast("bigint")
    if as_value:
        table = _as_one_row(sketch).scalar()
        found = [F.get(F.get(table, F.lit(r)), _bucket(r, text, p).cast("int")) for r in range(p.depth)]
        least = found[0] if p.depth == 1 else F.least(*found)
        return probes.select(*probes.columns, F.when(text.isNotNull(), least).otherwise(zero).alias(name))
    # Look the cells of each distinct key up, then attach the result.
    keys = probes.select(text.alias("_k")).where("_k IS NOT NULL").distinct()
    at = keys.select("_k", F.inline(_positions(F.col("_k"), p)))
    cell = sketch.cells.select("row", "bucket", F.col("n").alias("_n"))
    found = at.join(cell, ["row", "bucket"], "left").groupBy("_k").agg(
        F.min(F.coalesce("_n", zero)).alias("_est")
    )
    joined = probes.join(found, text == F.col("_k"), "left")
    return joined.select(*probes.columns, F.coalesce("_est", zero).alias(name))


def row_totals(sketch: CountMin) -> DataFrame:
    """Sum of each row of cells; every row sums to the total weight."""
    return sketch.cells.groupBy("row").agg(F.sum("n").alias("n"))

