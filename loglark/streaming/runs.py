"""Continuous versions of the operators.

Each ``run_*`` starts a query that keeps something current and returns the query. Input offsets and state commit together
in the checkpoint folder, so a restart with the same folders neither loses nor repeats a line. ``drain=True`` processes
what is there and stops. A table folder and its checkpoint folder belong together; to start over, give two new ones.

Counts, buckets and cells are Parquet folders with one part for each batch (see ``kept``), which ``compact`` copies into one part
between two runs. Heavy hitters and the latest seconds live in the state store (see ``state``). ``run_top`` and ``run_report`` keep only
the heads of the counts, and go on from those of the batch before: counts only grow, so a key that a batch does not touch
enters no head. A reader beside a running query sees a batch once its files are there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loglark import params, schema
from loglark.operators import cms, counts, misra_gries, space_saving, topk, windows
from loglark.operators.cms import CountMin
from loglark.operators.misra_gries import MisraGries
from loglark.operators.space_saving import SpaceSaving
from loglark.operators.windows import last_second
from loglark.params import CmsParams
from loglark.plans import report, snapshot
from loglark.plans.snapshot import State
from loglark.session import STREAM_CONF, path_is_missing, settings
from loglark.streaming import kept, state
from loglark.streaming.kept import Kept

#: A part of cells says what sketch it is of.
CMS_OF = ("width", "depth", "seed")
_CELLS = T.StructType([*schema.CMS.fields, *(T.StructField(c, T.LongType()) for c in CMS_OF)])


def counts_table(path: str) -> Kept:
    return Kept(f"{path}/counts", schema.COUNTS)


def buckets_table(path: str) -> Kept:
    return Kept(f"{path}/buckets", schema.BUCKETS)


def cms_table(path: str) -> Kept:
    return Kept(f"{path}/cms", _CELLS)


def state_table(path: str) -> Kept:
    return Kept(f"{path}/state", T.StructType([T.StructField("epoch", T.IntegerType()), *schema.COUNTS.fields]))


_RESETS = T.StructType([T.StructField("at", T.TimestampType())])


def heads_table(path: str) -> Kept:
    return Kept(f"{path}/heads", schema.COUNTS)


def report_table(path: str) -> Kept:
    return Kept(f"{path}/report", report.TEXT)


def json_table(path: str) -> Kept:
    return Kept(f"{path}/json", T.StructType([T.StructField("json", T.StringType())]))


def _start(
    df: DataFrame,
    write: Callable[[DataFrame, int], None] | None,
    mode: str,
    checkpoint: str,
    drain: bool,
    every: str,
    state_partitions: int | None,
) -> StreamingQuery:
    values = dict(STREAM_CONF)
    if state_partitions is not None:
        values["spark.sql.shuffle.partitions"] = str(state_partitions)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.format("noop") if write is None else writer.foreachBatch(write)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    # The number of state partitions is fixed by the first run of a checkpoint.
    with settings(df.sparkSession, values):
        return writer.start()


def _retained(seconds: int) -> Callable[[DataFrame], DataFrame]:
    """COUNTS with only the last ``seconds`` of its "second" rows, up to the newest; all of them for 0."""

    def keep(rows: DataFrame) -> DataFrame:
        if not seconds:
            return rows
        second = F.when(F.col("dim") == schema.DIM_SECOND, F.col("key").cast("bigint"))
        newest = rows.agg(F.max(second)).scalar()
        return rows.where((F.col("dim") != schema.DIM_SECOND) | (second > newest - seconds))

    return keep


def run_counts(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
    with_seconds: bool = False,
) -> StreamingQuery:
    """Keep COUNTS of a stream of parsed lines under ``path``; a batch writes only the keys it changed."""
    running = counts.all_counts(parsed, with_seconds)
    return _start(running, counts_table(path).write, "update", checkpoint, drain, every, state_partitions)


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    return kept.newest_of(counts_table(path).rows(spark), "dim", "key")


def compact_counts(spark: SparkSession, path: str, to: str) -> None:
    """Copy the table of ``run_counts`` to a new folder with its batches as one. The next run gets that folder."""
    kept.compact(spark, counts_table(path), counts_table(to).path, lambda rows: kept.newest_of(rows, "dim", "key"))


def current_top(spark: SparkSession, path: str, dim: str, k: int | None = None) -> DataFrame:
    """Top-K of one dimension of the counts kept so far."""
    found = current_counts(spark, path).where(F.col("dim") == dim)
    return topk.top_of(found.select("key", "n"), "key", k)


def next_heads(old: DataFrame, changed: DataFrame, k: int, seconds: int = 0) -> DataFrame:
    """COUNTS of the ``k`` best clients and endpoints, of all other keys, and of the last ``seconds``.

    ``changed`` has the new counts of all keys that changed since ``old``, the heads before. Counts only grow: a key in neither
    stays behind the same ``k`` keys as before. So this reads the old heads and the batch, not the counts that are kept.
    """
    both = old.unionByName(changed.select(*old.columns)).groupBy("dim", "key").agg(F.max("n").alias("n"))
    many = F.col("dim").isin(schema.DIM_IP, schema.DIM_ENDPOINT)
    best = topk.top_per_dim(both.where(many), k).drop("rank")
    return best.unionByName(_retained(seconds)(both.where(~many)))


def _keep_heads(path: str, k: int, seconds: int, and_then: Callable[[SparkSession, int], None] | None = None):
    table = heads_table(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch.persist()  # else the state would be read once for each use
        heads = next_heads(table.newest(spark, before=batch_id), changed, k, seconds)
        table.write(heads.coalesce(1), batch_id)  # a few rows of each dim
        changed.unpersist()
        if and_then is not None:
            and_then(spark, batch_id)

    return write


def run_top(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    k: int | None = None,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep the ``k`` most frequent clients and endpoints, and the counts of all statuses, under ``path``."""
    write = _keep_heads(path, params.top_k(k), 0)
    return _start(counts.all_counts(parsed), write, "update", checkpoint, drain, every, state_partitions)


def current_heads(spark: SparkSession, path: str) -> DataFrame:
    """COUNTS of the heads after the newest batch."""
    return heads_table(path).newest(spark)


def run_buckets(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "ts_received",
    window: int | None = None,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep lines per second. A second older than (newest second of earlier batches) - (window - 1) is dropped as late.

    Rates come from the bucket table when it is read; spreading each line over a sliding window would multiply the
    stream by the window length.
    """
    delay = params.retention(window) - 1
    seconds = (
        parsed.select(F.date_trunc("second", F.col(ts)).alias("_ts"))
        .where("_ts IS NOT NULL")
        .withWatermark("_ts", f"{delay} seconds")
        .groupBy(F.window("_ts", "1 second").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("sec"), "n")
    )
    return _start(seconds, buckets_table(path).write, "update", checkpoint, drain, every, state_partitions)


def current_buckets(spark: SparkSession, path: str) -> DataFrame:
    return kept.newest_of(buckets_table(path).rows(spark), "sec")


def run_seconds(
    parsed: DataFrame,
    checkpoint: str,
    ts: str = "ts_received",
    window: int | None = None,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep the lines of the last ``window`` seconds, up to the newest, in the state store alone."""
    own = state.seconds(parsed, ts, params.retention(window))
    return _start(own, None, "update", checkpoint, drain, every, state_partitions)


def current_seconds(spark: SparkSession, checkpoint: str, window: int | None = None) -> DataFrame:
    """The bucket table of the last ``window`` seconds up to the newest."""
    return windows.retain(state.kept_seconds(spark, checkpoint), params.retention(window))


def run_late(
    events: DataFrame,
    path: str,
    checkpoint: str,
    source: str,
    arrival: str,
    tie: str,
    ts: str,
    window: int,
    keep: list[str],
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep the columns ``keep`` of every event and whether it was ``late`` for its source, event by event (see ``state.late_marks``)."""
    marked = state.late_marks(events, source, arrival, tie, ts, params.positive("window", window), keep)
    return _start(marked, Kept(f"{path}/late", marked.schema).write, "append", checkpoint, drain, every, state_partitions)


def current_late(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The marked events, of the given columns."""
    return Kept(f"{path}/late", T.StructType.fromDDL(layout)).rows(spark).drop("batch_id")  # a session is there


RATES = T.StructType(
    [T.StructField("series", T.StringType()), T.StructField("sec", T.TimestampType()), T.StructField("rate", T.DoubleType())]
)


def run_rate(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "ts_received",
    n: int | None = None,
    delay: int = 0,
    by: str | None = None,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep the trailing rate of every closed second, for each value of ``by``, under ``path``: each is worked out once."""
    rates = state.running_rate(parsed, ts, params.positive("n", params.rate_seconds(n)), delay, by)
    return _start(rates, Kept(f"{path}/rates", RATES).write, "append", checkpoint, drain, every, state_partitions)


def current_rates(spark: SparkSession, path: str, checkpoint: str, n: int | None = None) -> DataFrame:
    """(series, sec, rate): the rates given out, and those of the seconds that are still open."""
    closed = Kept(f"{path}/rates", RATES).rows(spark).drop("batch_id")
    return closed.unionByName(state.open_rates(spark, checkpoint, params.rate_seconds(n)))


def run_cms(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    cms_params: CmsParams | None = None,
    key: str = "ip",
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep a count-min sketch; its state is at most width x depth cells."""
    p = cms_params or CmsParams()
    found = _cms_params(cms_table(path).rows(parsed.sparkSession))
    if found not in (None, p):
        raise ValueError(f"the sketch under {path} was started with {found}, not with {p}")
    cells = cms.build(parsed.where("ok"), key, p).cells
    cells = cells.select("*", *(F.lit(getattr(p, c)).cast("long").alias(c) for c in CMS_OF))
    return _start(cells, cms_table(path).write, "update", checkpoint, drain, every, state_partitions)


def _cms_params(cells: DataFrame) -> CmsParams | None:
    one = cells.select(*CMS_OF).first()
    return None if one is None else CmsParams(**one.asDict())


def current_cms(spark: SparkSession, path: str) -> CountMin:
    """The sketch, with the parameters that it was started with."""
    rows = cms_table(path).rows(spark)
    p = _cms_params(rows) or CmsParams()
    return CountMin(kept.newest_of(rows.drop(*CMS_OF), "row", "bucket"), p)


def run_heavy_hitters(
    parsed: DataFrame,
    checkpoint: str,
    capacity: int | None = None,
    salts: int = state.SALTS,
    drain: bool = False,
    every: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Keep Misra-Gries and Space-Saving summaries of clients and endpoints in the state store, in ``salts`` parts for each.

    A part has ``capacity`` counters, so the state has at most salts x capacity of either kind for each dimension.
    """
    pairs = counts.fan_out(parsed).where(F.col("dim").isin(schema.DIM_IP, schema.DIM_ENDPOINT))
    pairs = pairs.where(F.col("key").isNotNull()).select("dim", "key", F.lit(1).cast("long").alias("w"))
    own = state.heavy_hitters(pairs, params.capacity(capacity), salts)
    return _start(own, None, "update", checkpoint, drain, every, state_partitions)


def current_mg(spark: SparkSession, checkpoint: str) -> MisraGries:
    """The summary of all parts, with the capacity that it was started with."""
    found = state.summaries(spark, checkpoint)
    if found is None:
        return MisraGries(spark.createDataFrame([], schema.MG), params.capacity(None), split=True)
    rows = found.select("dim", F.inline(F.arrays_zip(F.col("mg_keys").alias("key"), F.col("mg_n").alias("n"))))
    return misra_gries.from_partials(rows, _capacity(found), split=True)


def current_ss(spark: SparkSession, checkpoint: str) -> SpaceSaving:
    """The summary of all parts, with the capacity that it was started with.

    A part's keys are in no other part, so the floors of the others do not concern them: its rows stand for themselves.
    """
    found = state.summaries(spark, checkpoint)
    if found is None:
        return SpaceSaving(spark.createDataFrame([], schema.SS), params.capacity(None), split=True)
    listed = F.arrays_zip(F.col("ss_keys").alias("key"), F.col("ss_over").alias("over"), F.col("ss_err").alias("err_over"))
    rows = found.select("dim", "salt", "floor", F.inline(listed))
    return space_saving.from_parts(
        rows.select("dim", "key", (F.col("over") + F.col("floor")).alias("n"), (F.col("err_over") + F.col("floor")).alias("err"), "floor"),
        _capacity(found),
    )


def _capacity(found: DataFrame) -> int:
    return found.select("capacity").first()[0]


def reset(spark: SparkSession, path: str, at: datetime | None = None) -> None:
    """Start the state of ``run_state`` under ``path`` anew with the lines that arrive from ``at`` (default: now) on.

    It takes effect at that place of the input, whatever batch a line comes in, also in a batch that is written again. The query
    may run meanwhile. Lines without a time, so all errors, count by the resets that are there when their batch is written.
    """
    when = at or datetime.now(timezone.utc)
    spark.createDataFrame([(when,)], _RESETS).coalesce(1).write.mode("append").parquet(f"{path}/resets")


def _resets(spark: SparkSession, path: str) -> list[datetime]:
    """The times of all resets, a few."""
    try:
        rows = spark.read.schema(_RESETS).parquet(f"{path}/resets").collect()
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return []
    return sorted(r["at"] for r in rows)


def run_state(
    parsed: DataFrame, path: str, checkpoint: str, drain: bool = False, every: str = "10 seconds"
) -> StreamingQuery:
    """Keep what a whole state is made of: the counts of each batch, seconds among them, from one scan and without a state store.

    Counts go by epochs, the number of resets before a line, so a ``reset`` needs no stop.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        times = _resets(batch.sparkSession, path)
        passed = [(F.col("ts_received") >= F.lit(at)).cast("int") for at in times]
        epoch = F.coalesce(sum(passed, F.lit(0)), F.lit(len(times)))
        state_table(path).write(counts.all_counts(batch.withColumn("epoch", epoch), True, ["epoch"]), batch_id)

    needed = parsed.select("ok", "ip", "endpoint", "status", "ts_received")
    return _start(needed, write, "append", checkpoint, drain, every, None)


def _since_reset(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """COUNTS of the last epoch, summed over the batches."""
    last = rows.where(F.col("epoch") == len(_resets(spark, path))).drop("epoch")
    return kept.sum_of(last, "dim", "key")


def current_state(
    spark: SparkSession,
    path: str,
    cms_params: CmsParams | None = None,
    mg_capacity: int | None = None,
    ss_capacity: int | None = None,
    retention: int | None = None,
) -> State:
    """The state kept by ``run_state`` since the last reset: to query, to save as a snapshot, or to add to a loaded one.

    The counts are summed over the batches and written once, and the summaries are built from them, so all parts are those after the
    same batch. With a ``retention`` only so many seconds up to the newest are in it.
    """
    seconds = 0 if retention is None else params.retention(retention)
    rows = state_table(path).rows(spark)
    summed = _retained(seconds)(_since_reset(spark, path, rows))
    found = snapshot.of_counts(summed, cms_params, mg_capacity, ss_capacity)
    return replace(found, fresh=rows.isEmpty())


def compact_state(spark: SparkSession, path: str, to: str, retention: int | None = None) -> None:
    """Copy the table of ``run_state`` to a new folder with its batches as one, without what lies before the last reset and without the
    seconds beyond a ``retention``."""
    seconds = 0 if retention is None else params.retention(retention)
    times = _resets(spark, path)

    def current(rows: DataFrame) -> DataFrame:
        return _retained(seconds)(_since_reset(spark, path, rows)).withColumn("epoch", F.lit(len(times)))

    kept.compact(spark, state_table(path), state_table(to).path, current)
    for at in times:
        reset(spark, to, at)


def counts_and_buckets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """COUNTS and buckets of a ``run_counts(with_seconds=True)`` table."""
    return counts.split_seconds(current_counts(spark, path))


def run_report(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    k: int | None = None,
    n: int | None = None,
    prefix: str = "accesslog",
    drain: bool = False,
    every: str = "1 second",
    state_partitions: int | None = None,
    as_of_newest: bool = False,
    retention: int | None = None,
) -> StreamingQuery:
    """Keep the heads of the counts, and refresh the exposition text and the JSON document from them after every batch.

    The rate ends now, or at the newest second of the log with ``as_of_newest`` (for a back-fill). ``retention`` is the
    number of seconds that are kept, which must cover ``n``.
    """
    kept_seconds = params.retention(retention, params.report_seconds(n))

    def refresh(spark: SparkSession, batch_id: int) -> None:
        heads, buckets = counts.split_seconds(heads_table(path).newest(spark, before=batch_id + 1))
        as_of = last_second(buckets) if as_of_newest else None
        rows = report.metrics_rows(heads, buckets, as_of, k, n)
        report_table(path).write(report.metrics_text(rows, prefix), batch_id)
        json_table(path).write(report.stats_json(heads, buckets, as_of, k, n), batch_id)

    write = _keep_heads(path, params.report_k(k), kept_seconds, refresh)
    return _start(counts.all_counts(parsed, with_seconds=True), write, "update", checkpoint, drain, every, state_partitions)


def current_report(spark: SparkSession, path: str) -> DataFrame:
    """The exposition lines (seq, value) after the newest batch."""
    return report_table(path).newest(spark)


def current_json(spark: SparkSession, path: str) -> DataFrame:
    """The JSON document after the newest batch."""
    return json_table(path).newest(spark)
