"""Misra-Gries and Space-Saving summaries of the same rows from one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglark import params, schema
from loglark.operators import _partials, misra_gries, space_saving, task_summaries
from loglark.operators.misra_gries import MisraGries
from loglark.operators.space_saving import SpaceSaving
from loglark.session import materialize

_BOTH = T.StructType([T.StructField("kind", T.StringType()), *schema.SS.fields])


def build(
    df: DataFrame,
    key: str | Column,
    mg_capacity: int | None = None,
    ss_capacity: int | None = None,
    weight: str | Column | None = None,
    by: str | Column | None = None,
) -> tuple[MisraGries, SpaceSaving]:
    """Both summaries of ``df``, per value of ``by``.

    The summaries of the tasks, at most the two capacities for each task and dim, are written to the shared folder, as both
    results come from them.
    """
    mg_capacity, ss_capacity = params.capacity(mg_capacity), params.capacity(ss_capacity)
    summarize = task_summaries.both

    def partial(batches):
        return summarize(batches, mg_capacity, ss_capacity)

    rows = _partials.keyed_weights(df, key, weight, by).mapInArrow(partial, _BOTH)
    rows = materialize(rows, "summaries")
    split = by is not None
    mg = rows.where(F.col("kind") == "mg").select(*schema.MG.fieldNames())
    ss = rows.where(F.col("kind") == "ss").select(*schema.SS.fieldNames())
    return misra_gries.from_partials(mg, mg_capacity, split), space_saving.from_partials(ss, ss_capacity, split)
