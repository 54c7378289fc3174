"""Saved states: counts, per-second buckets and summaries, kept as a versioned folder of Parquet tables.

A save writes its tables under a new version folder and then appends one row to ``commits``. That row is what makes
the version visible, so a save that fails half-way is never read.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglark import params, schema
from loglark.operators import cms, counts, heavy_hitters, misra_gries, space_saving, windows
from loglark.operators.cms import CountMin
from loglark.operators.misra_gries import MisraGries
from loglark.operators.space_saving import SpaceSaving
from loglark.params import CmsParams
from loglark.session import materialize, path_is_missing

# Version 1 holds no endpoints, 2 adds them, 3 adds count-min, 4 adds heavy hitters.
FORMAT = 4

COMMITS = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("saved_at", T.LongType()),
        T.StructField("format", T.IntegerType()),
        T.StructField("sections", T.ArrayType(T.StringType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("mg_capacity", T.IntegerType()),
        T.StructField("ss_capacity", T.IntegerType()),
    ]
)


class SnapshotError(ValueError):
    """The snapshot cannot be used: missing, of an unknown version, or made with other parameters."""


@dataclass(frozen=True)
class State:
    """COUNTS, buckets and summaries of one input. Count-min covers clients; the others clients and endpoints."""

    counts: DataFrame
    buckets: DataFrame
    cms: CountMin
    mg: MisraGries
    ss: SpaceSaving
    #: Nothing was ever added to it.
    fresh: bool = False


def build(
    parsed: DataFrame,
    cms_params: CmsParams | None = None,
    mg_capacity: int | None = None,
    ss_capacity: int | None = None,
) -> State:
    """State of a batch of parsed lines, from one scan: the counts are written once and the rest derives from them."""
    return of_counts(counts.all_counts(parsed, with_seconds=True), cms_params, mg_capacity, ss_capacity)


def of_counts(
    both: DataFrame,
    cms_params: CmsParams | None = None,
    mg_capacity: int | None = None,
    ss_capacity: int | None = None,
) -> State:
    """State of COUNTS with their seconds. They are written once, as all parts come from them."""
    exact, buckets = counts.split_seconds(materialize(both, "counts"))
    return State(counts=exact, buckets=buckets, **_summaries(exact, cms_params, mg_capacity, ss_capacity))


def _summaries(exact: DataFrame, cms_params: CmsParams | None, mg_capacity: int | None, ss_capacity: int | None) -> dict:
    keys = exact.where(F.col("dim").isin(schema.DIM_IP, schema.DIM_ENDPOINT))
    clients = exact.where(F.col("dim") == schema.DIM_IP)
    mg, ss = heavy_hitters.build(keys, "key", mg_capacity, ss_capacity, weight="n", by="dim")
    return {"cms": cms.build(clients, "key", cms_params, weight="n"), "mg": mg, "ss": ss}


def empty(
    spark: SparkSession,
    cms_params: CmsParams | None = None,
    mg_capacity: int | None = None,
    ss_capacity: int | None = None,
) -> State:
    """The state before any line: also what a reset leaves."""
    return State(
        counts=spark.createDataFrame([], schema.COUNTS),
        buckets=spark.createDataFrame([], schema.BUCKETS),
        cms=CountMin(spark.createDataFrame([], schema.CMS), cms_params or CmsParams()),
        mg=MisraGries(spark.createDataFrame([], schema.MG), params.capacity(mg_capacity), split=True),
        ss=SpaceSaving(spark.createDataFrame([], schema.SS), params.capacity(ss_capacity), split=True),
        fresh=True,
    )


def resume(old: State, new: State) -> State:
    """State of both inputs together; they must not overlap. A state before any line takes on the other's parameters."""
    if old.fresh or new.fresh:
        return new if old.fresh else old
    if old.cms.params != new.cms.params:
        raise SnapshotError(f"count-min parameters differ: {old.cms.params} and {new.cms.params}")
    buckets = old.buckets.select("sec", "n").unionByName(new.buckets.select("sec", "n"))
    return State(
        counts=counts.add_counts(old.counts, new.counts),
        buckets=buckets.groupBy("sec").agg(F.sum("n").alias("n")),
        cms=cms.merge(old.cms, new.cms),
        mg=misra_gries.merge(old.mg, new.mg),
        ss=space_saving.merge(old.ss, new.ss),
    )


def resize_window(state: State, seconds: int) -> State:
    """The state with only the last ``seconds`` seconds of buckets. Buckets are absolute, so none moves."""
    return replace(state, buckets=windows.retain(state.buckets, seconds))


def save(state: State, path: str) -> str:
    """Write the state as the newest version under ``path``; returns the version."""
    version = uuid.uuid4().hex
    sections = {
        "counts": state.counts.select("dim", "key", "n"),
        "buckets": state.buckets.select("sec", "n"),
        "cms": state.cms.cells.select("row", "bucket", "n"),
        "mg": state.mg.rows.select(*schema.MG.fieldNames()),
        "ss": state.ss.rows.select(*schema.SS.fieldNames()),
    }
    for name, table in sections.items():
        table.write.parquet(f"{path}/versions/{version}/{name}")
    p = state.cms.params
    row = (
        version,
        time.time_ns(),
        FORMAT,
        list(sections),
        p.width,
        p.depth,
        p.seed,
        state.mg.capacity,
        state.ss.capacity,
    )
    spark = state.counts.sparkSession
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def load(spark: SparkSession, path: str, missing_ok: bool = False) -> State:
    """The newest saved state. It replaces whatever the caller held; nothing is read before the header is checked.

    Summaries that an older version did not have are built from its counts, with default parameters. Endpoints that it did
    not count are in none of them. ``missing_ok`` turns a missing snapshot into the state before any line.
    """
    try:
        commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
        head = commits.orderBy(F.desc("saved_at"), F.desc("version")).first()
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        head = None
    if head is None:
        if missing_ok:
            return empty(spark)
        raise SnapshotError(f"no snapshot under {path}")
    if not 1 <= head["format"] <= FORMAT:
        raise SnapshotError(f"snapshot version {head['format']} is not known; this reads 1 to {FORMAT}")

    def section(name: str, layout: T.StructType) -> DataFrame:
        if name not in head["sections"]:
            return spark.createDataFrame([], layout)
        return spark.read.schema(layout).parquet(f"{path}/versions/{head['version']}/{name}")

    defaults = CmsParams()
    cms_params = CmsParams(
        defaults.width if head["width"] is None else head["width"],
        defaults.depth if head["depth"] is None else head["depth"],
        defaults.seed if head["seed"] is None else head["seed"],
    )
    mg_capacity, ss_capacity = params.capacity(head["mg_capacity"]), params.capacity(head["ss_capacity"])
    exact = section("counts", schema.COUNTS)
    old = not {"cms", "mg", "ss"} <= set(head["sections"])
    from_counts = _summaries(exact, cms_params, mg_capacity, ss_capacity) if old else {}
    stored = {
        "cms": CountMin(section("cms", schema.CMS), cms_params),
        "mg": MisraGries(section("mg", schema.MG), mg_capacity, split=True),
        "ss": SpaceSaving(section("ss", schema.SS), ss_capacity, split=True),
    }
    found = {name: stored[name] if name in head["sections"] else from_counts[name] for name in stored}
    return State(counts=exact, buckets=section("buckets", schema.BUCKETS), **found)
