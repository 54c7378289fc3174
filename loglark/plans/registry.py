"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglark.functions import line, text
from loglark.operators import cms, counts, heavy_hitters, late, misra_gries, space_saving, topk, windows
from loglark.operators.parse import parse_logs, rejects
from loglark.params import CmsParams
from loglark.plans import report, snapshot
from loglark.plans.logs import logs, parsed, table
from loglark.session import materialize, scratch_path
from loglark.sources import lines_from, read_logs, stream_logs, stream_tail
from loglark.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Where a query works on two parts of the log, they meet here.
SPLIT = "2024-01-16"
# Rates are taken over an hour: events are minutes apart at the small scale.
HOUR = 3_600
DAY = 86_400
PREFIX = "accesslog"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    return windows.per_second(table(spark, sf, "events"), "ts")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    whole = parsed(spark, sf)
    return whole.where(F.col("ts") < SPLIT), whole.where(F.col("ts") >= SPLIT)


def _ok(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).where("ok")


# --- parsing ---------------------------------------------------------------------------------------------------


@query
def parse_log(spark, sf):
    return parsed(spark, sf).select("event_id", "ok", "ip", "method", "endpoint", "status")


@query
def parse_ok_flags(spark, sf):
    return logs(spark, sf).select("event_id", line.is_valid_line(F.col("value")).alias("ok"))


@query
def parse_event_time(spark, sf):
    return _ntz(parsed(spark, sf).select("event_id", "event_ts"), "event_ts")


@query
def parse_arrival(spark, sf):
    return _ntz(parsed(spark, sf).select("event_id", "ts_received"), "ts_received")


@query
def parse_rejects(spark, sf):
    return rejects(parsed(spark, sf), "value", "event_id")


@query
def decode_endpoint(spark, sf):
    """Endpoints, and urls that were percent-encoded before."""
    endpoints = _ok(spark, sf).select("endpoint")
    urls = table(spark, sf, "pages").select(F.url_encode("url").alias("endpoint"))
    both = endpoints.unionByName(urls)
    return counts.count_by(both.select(text.decode(F.col("endpoint")).alias("decoded")), "decoded")


@query
def query_param(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", *(text.query_param(F.col("url"), p).alias(p) for p in ("page", "ref", "utm_source")))


@query
def count_by_query_param(spark, sf):
    return counts.count_by_query_param(_ok(spark, sf), "endpoint", "k")


@query
def count_pages_by_query_param(spark, sf):
    return counts.count_by_query_param(table(spark, sf, "pages"), "url", "ref")


@query
def count_by_path(spark, sf):
    return counts.count_by_path(_ok(spark, sf), "endpoint")


@query
def log_scan(spark, sf):
    """The log written as text files, scanned back and parsed."""
    path = scratch_path(spark, "log-scan")
    logs(spark, sf).select("value").write.text(path)
    return counts.totals(parse_logs(read_logs(spark, path), event_clock=True))


# --- exact counts ----------------------------------------------------------------------------------------------


@query
def totals(spark, sf):
    return counts.totals(parsed(spark, sf))


@query
def observed_totals(spark, sf):
    """The totals as a by-product of writing the counts."""
    lines, found = counts.observed(parsed(spark, sf))
    counts.all_counts(lines).write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame([(found.get["total_lines"], found.get["parse_errors"])], "total_lines long, parse_errors long")


@query
def status_counts(spark, sf):
    return counts.count_by(_ok(spark, sf), "status")


@query
def ip_counts(spark, sf):
    return counts.count_by(_ok(spark, sf), "ip")


@query
def endpoint_counts(spark, sf):
    return counts.count_by(_ok(spark, sf), "endpoint")


@query
def all_counts(spark, sf):
    return counts.all_counts(parsed(spark, sf))


@query
def weighted_counts(spark, sf):
    items = table(spark, sf, "lineitem")
    return counts.count_by(items, "l_returnflag", weight=F.floor("l_quantity").cast("bigint"))


@query
def count_orders_by_priority(spark, sf):
    return counts.count_by(table(spark, sf, "orders"), "o_orderpriority")


# --- top-K -----------------------------------------------------------------------------------------------------


@query
def top_ips(spark, sf):
    return topk.top_k(_ok(spark, sf), "ip", 10)


@query
def top_endpoints(spark, sf):
    return topk.top_k(_ok(spark, sf), "endpoint", 10)


@query
def ranked_top_ips(spark, sf):
    return topk.ranked(topk.top_k(_ok(spark, sf), "ip", 25), "ip")


@query
def ranked_top_endpoints(spark, sf):
    return topk.ranked(topk.top_k(_ok(spark, sf), "endpoint", 25), "endpoint")


@query
def top_per_dim(spark, sf):
    return topk.top_per_dim(counts.all_counts(parsed(spark, sf)), 5)


@query
def top_all_keys(spark, sf):
    """A ``k`` above the number of keys: every key is listed."""
    return topk.top_k(table(spark, sf, "lineitem"), "l_orderkey", 10_000_000)


@query
def top_customers(spark, sf):
    return topk.top_k(table(spark, sf, "orders"), "o_custkey", 20)


@query
def top_parts_by_quantity(spark, sf):
    items = table(spark, sf, "lineitem")
    return topk.top_k(items, "l_partkey", 20, weight=F.floor("l_quantity").cast("bigint"))


# --- count-min -------------------------------------------------------------------------------------------------


@query
def cms_cells(spark, sf):
    """The cells of each row: how many, whether all lie within the width, and what they add up to."""
    cells = cms.build(_ok(spark, sf), "ip", CmsParams(width=8, depth=4)).cells
    inside = F.col("bucket").between(0, 7)
    return cells.groupBy("row").agg(F.bool_and(inside).alias("inside"), F.max("bucket").isNotNull().alias("any"), F.sum("n").alias("n"))


@query
def cms_row_totals(spark, sf):
    return cms.row_totals(cms.build(_ok(spark, sf), "ip"))


@query
def cms_estimate_point(spark, sf):
    """Estimates of the busiest client and of one that never came."""
    clients = _ok(spark, sf)
    probes = topk.top_k(clients, "ip", 1).select("ip").unionByName(spark.range(1).select(F.lit("nobody").alias("ip")))
    return cms.estimate(cms.build(clients, "ip"), probes, "ip")


@query
def cms_estimate_all(spark, sf):
    """The log is parsed and counted once; the sketch is built from the counts and asked for each of them."""
    clients = materialize(counts.count_by(_ok(spark, sf), "ip"), "clients")
    return cms.estimate(cms.build(clients, "ip", weight="n"), clients, "ip")


@query
def cms_estimate_by_shuffle(spark, sf):
    """The same lookup for a sketch that is too large to broadcast."""
    clients = _ok(spark, sf)
    sketch = cms.build(clients, "ip")
    return cms.estimate(sketch, counts.count_by(clients, "ip"), "ip", as_value=False)


@query
def cms_never_under(spark, sf):
    """A sketch far too narrow for its keys: estimates may be high, never low."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    sketch = cms.build(items, "part", CmsParams(width=64, depth=4))
    found = cms.estimate(sketch, counts.count_by(items, "part"), "part")
    return found.select("part", "n", (F.col("est") >= F.col("n")).alias("not_under"))


@query
def cms_merge(spark, sf):
    """Cells of two parts of the log merged, against the cells of the whole: rows of both that differ, per row."""
    old, new = _parts(spark, sf)
    merged = cms.merge(cms.build(old.where("ok"), "ip"), cms.build(new.where("ok"), "ip")).cells
    whole = cms.build(_ok(spark, sf), "ip").cells.withColumnRenamed("n", "n_whole")
    return (
        merged.join(whole, ["row", "bucket"], "full")
        .groupBy("row")
        .agg(
            F.sum("n").alias("n"),
            F.count_if(~F.col("n").eqNullSafe(F.col("n_whole"))).alias("different_cells"),
        )
    )


@query
def cms_weighted(spark, sf):
    items = table(spark, sf, "lineitem").select("l_returnflag", F.floor("l_quantity").cast("bigint").alias("w"))
    sketch = cms.build(items, "l_returnflag", weight="w")
    return cms.estimate(sketch, counts.count_by(items, "l_returnflag"), "l_returnflag")


# --- heavy hitters ---------------------------------------------------------------------------------------------

SMALL = 16
FEW = 3


def _checked(mg: DataFrame, ss: DataFrame, exact: DataFrame, capacity: int) -> DataFrame:
    """(dim, key, n, mg_ok, ss_ok): whether summaries with ``capacity`` counters a dim keep their bounds for every key."""
    whole = exact.groupBy("dim").agg(F.sum("n").alias("whole"))
    rows = (
        exact.join(whole, "dim")
        .join(mg.select("dim", "key", F.col("n").alias("mg_n")), ["dim", "key"], "left")
        .join(ss.select("dim", "key", F.col("n").alias("ss_n"), "err"), ["dim", "key"], "left")
    )
    n, mg_n, ss_n = F.col("n"), F.coalesce("mg_n", F.lit(0)), F.col("ss_n")
    mg_ok = (mg_n <= n) & (mg_n >= n - F.col("whole") / (capacity + 1))
    slack = F.col("whole") / capacity
    ss_ok = F.when(ss_n.isNull(), n <= slack).otherwise((ss_n >= n) & (ss_n - F.col("err") <= n) & (ss_n <= n + slack))
    return rows.select("dim", "key", "n", mg_ok.alias("mg_ok"), ss_ok.alias("ss_ok"))


def _skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a few keys that hold much of the table and a long tail of others."""
    heavy = F.concat("l_returnflag", "l_linestatus")
    tail = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") <= 20, heavy).otherwise(tail).alias("key"),
        F.floor("l_quantity").cast("bigint").alias("w"),
    )


def _total(df: DataFrame) -> Column:
    return df.agg(F.sum("n")).scalar()


def _mg_check(summary, exact: DataFrame) -> DataFrame:
    slack = _total(exact) / F.lit(float(summary.capacity + 1))
    found = misra_gries.estimate(summary, exact, "key")
    return found.select(
        "key",
        "n",
        (F.col("est") <= F.col("n")).alias("not_over"),
        (F.col("est") >= F.col("n") - slack).alias("close"),
        ((F.col("n") <= slack) | (F.col("est") > 0)).alias("heavy_listed"),
    )


def _ss_check(summary, exact: DataFrame) -> DataFrame:
    slack = _total(exact) / F.lit(float(summary.capacity))
    found = space_saving.estimate(summary, exact, "key", err_name="err")
    listed = F.col("est") > 0
    return found.select(
        "key",
        "n",
        (~listed | (F.col("est") >= F.col("n"))).alias("not_under"),
        (F.col("est") <= F.col("n") + slack).alias("close"),
        (F.col("est") - F.col("err") <= F.col("n")).alias("guaranteed_ok"),
        ((F.col("n") <= slack) | listed).alias("heavy_listed"),
    )


def _by_shipdate(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "lineitem")
    keyed = items.select("l_shipdate", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("part"), "l_returnflag")
    keyed = keyed.select("l_shipdate", F.when(F.col("l_returnflag") == "N", F.col("part")).otherwise(F.col("l_returnflag")).alias("key"))
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return keyed.where(F.col("l_shipdate") < cut), keyed.where(F.col("l_shipdate") >= cut)


@query
def mg_top_ips(spark, sf):
    """A summary with fewer counters than clients, so it is held to its bounds."""
    clients = _ok(spark, sf).select(F.col("ip").alias("key"))
    return _mg_check(misra_gries.build(clients, "key", SMALL), counts.count_by(clients, "key"))


@query
def mg_top_endpoints(spark, sf):
    endpoints = _ok(spark, sf).select(F.col("endpoint").alias("key"))
    return _mg_check(misra_gries.build(endpoints, "key", FEW), counts.count_by(endpoints, "key"))


@query
def mg_estimate(spark, sf):
    """Estimates of every client, of those in the summary's list among them."""
    clients = _ok(spark, sf).select(F.col("ip").alias("key"))
    summary = misra_gries.build(clients, "key", SMALL)
    listed = misra_gries.top(summary, SMALL).select("key", F.col("n").alias("top_n"))
    found = misra_gries.estimate(summary, counts.count_by(clients, "key"), "key").join(listed, "key", "left")
    same = F.coalesce("top_n", F.lit(0)) == F.col("est")
    return found.select("key", "n", same.alias("same"), (F.col("est") <= F.col("n")).alias("not_over"))


@query
def mg_bounds(spark, sf):
    rows = _skewed(spark, sf)
    return _mg_check(misra_gries.build(rows, "key", SMALL), counts.count_by(rows, "key"))


@query
def mg_weighted_bounds(spark, sf):
    rows = _skewed(spark, sf)
    return _mg_check(misra_gries.build(rows, "key", SMALL, weight="w"), counts.count_by(rows, "key", weight="w"))


@query
def mg_merge_bounds(spark, sf):
    old, new = _by_shipdate(spark, sf)
    parts = [misra_gries.build(df.repartition(_width(spark)), "key", SMALL, groups=FEW) for df in (old, new)]
    merged = misra_gries.merge(*parts)
    return _mg_check(merged, counts.count_by(old.unionByName(new), "key"))


@query
def ss_top_ips(spark, sf):
    clients = _ok(spark, sf).select(F.col("ip").alias("key"))
    return _ss_check(space_saving.build(clients, "key", SMALL), counts.count_by(clients, "key"))


@query
def ss_top_endpoints(spark, sf):
    endpoints = _ok(spark, sf).select(F.col("endpoint").alias("key"))
    return _ss_check(space_saving.build(endpoints, "key", FEW), counts.count_by(endpoints, "key"))


@query
def ss_estimate(spark, sf):
    clients = _ok(spark, sf).select(F.col("ip").alias("key"))
    summary = space_saving.build(clients, "key", SMALL)
    listed = space_saving.top(summary, SMALL).select("key", F.col("n").alias("top_n"), "guaranteed")
    found = space_saving.estimate(summary, counts.count_by(clients, "key"), "key", err_name="err").join(listed, "key", "left")
    same = F.coalesce("top_n", F.lit(0)) == F.col("est")
    return found.select("key", "n", same.alias("same"), (F.coalesce("guaranteed", F.lit(0)) <= F.col("n")).alias("not_over"))


@query
def ss_bounds(spark, sf):
    rows = _skewed(spark, sf)
    return _ss_check(space_saving.build(rows, "key", SMALL), counts.count_by(rows, "key"))


@query
def ss_weighted_bounds(spark, sf):
    rows = _skewed(spark, sf)
    return _ss_check(space_saving.build(rows, "key", SMALL, weight="w"), counts.count_by(rows, "key", weight="w"))


@query
def ss_merge_bounds(spark, sf):
    old, new = _by_shipdate(spark, sf)
    parts = [space_saving.build(df.repartition(_width(spark)), "key", SMALL, groups=FEW) for df in (old, new)]
    merged = space_saving.merge(*parts)
    return _ss_check(merged, counts.count_by(old.unionByName(new), "key"))


@query
def heavy_hitters_per_dim(spark, sf):
    """Misra-Gries and Space-Saving of clients and endpoints, from one pass."""
    pairs = counts.fan_out(parsed(spark, sf)).where(F.col("dim").isin("ip", "endpoint"))
    mg, ss = heavy_hitters.build(pairs, "key", SMALL, SMALL, by="dim")
    return _checked(mg.rows, ss.rows, pairs.groupBy("dim", "key").agg(F.count("*").alias("n")), SMALL)


@query
def approx_top_k_builtin(spark, sf):
    """Spark's own approximate top-K, for comparison; exact here because there are few statuses."""
    found = _ok(spark, sf).agg(F.expr("approx_top_k(status, 10, 1000)").alias("t"))
    return found.select(F.inline("t")).select(F.col("item").alias("status"), F.col("count").alias("n"))


# --- windows and rates -----------------------------------------------------------------------------------------


@query
def per_second_counts(spark, sf):
    return _ntz(_buckets(spark, sf), "sec")


@query
def per_second_by_status(spark, sf):
    return _ntz(windows.per_second(_ok(spark, sf), "ts_received", by=["status"]), "sec")


@query
def rate_last_n(spark, sf):
    """The bound of the hour reaches the scan; only one column is read to find the newest time."""
    events = table(spark, sf, "events")
    as_of = windows.newest(events, "ts")
    buckets = windows.per_second(windows.recent(events, "ts", HOUR, as_of), "ts")
    return windows.rate_last_n(buckets, HOUR, windows.last_second(buckets))


@query
def rate_last_n_default(spark, sf):
    """No retention given: all of the hour counts."""
    buckets = _buckets(spark, sf)
    return windows.rate_last_n(buckets, HOUR, windows.last_second(buckets))


@query
def rate_text(spark, sf):
    buckets = _buckets(spark, sf)
    return report.rate_text(windows.rate_last_n(buckets, HOUR, windows.last_second(buckets)))


@query
def rate_series(spark, sf):
    return _ntz(windows.rate_series(_buckets(spark, sf), HOUR), "sec")


@query
def rate_series_by_status(spark, sf):
    per_status = windows.per_second(_ok(spark, sf), "ts_received", by=["status"])
    return _ntz(windows.rate_series(per_status, HOUR, by=["status"]), "sec")


@query
def hopping_counts(spark, sf):
    return windows.hopping(table(spark, sf, "events"), "ts", 3_600, 1_800)


@query
def hopping_counts_by_type(spark, sf):
    return windows.hopping(table(spark, sf, "events"), "ts", 5_400, 3_600, by=["event_type"])


@query
def window_retention(spark, sf):
    events = table(spark, sf, "events")
    kept = windows.recent(events, "ts", 7 * DAY, windows.newest(events, "ts"))
    return _ntz(windows.per_second(kept, "ts"), "sec")


def _late(spark: SparkSession, sf: str) -> DataFrame:
    arrival = F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 7).otherwise(0)
    events = table(spark, sf, "events").select("event_id", "ts")
    return late.mark_late(events, arrival, "event_id", "ts", 1_800)


@query
def late_events(spark, sf):
    return _late(spark, sf).where("late").select("event_id")


@query
def per_second_without_late(spark, sf):
    return _ntz(windows.per_second(_late(spark, sf).where("NOT late"), "ts"), "sec")


# --- reports ---------------------------------------------------------------------------------------------------


@query
def stats_summary(spark, sf):
    return report.stats(counts.all_counts(parsed(spark, sf)))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    kept, buckets = counts.counts_and_buckets(parsed(spark, sf))
    return report.metrics_rows(kept, buckets, windows.last_second(buckets), 10, HOUR)


@query
def metrics_rows(spark, sf):
    return _metrics(spark, sf).drop("count")


@query
def metrics_text(spark, sf):
    return report.metrics_text(_metrics(spark, sf), PREFIX)


@query
def stats_json(spark, sf):
    kept, buckets = counts.counts_and_buckets(parsed(spark, sf))
    return report.stats_json(kept, buckets, windows.last_second(buckets), 10, HOUR)


# --- snapshots -------------------------------------------------------------------------------------------------


def _state_rows(state: snapshot.State) -> DataFrame:
    """One table with all exact sections of a state, and the row totals of its sketch."""
    seconds = state.buckets.select(
        F.lit("second").alias("dim"), F.unix_timestamp("sec").cast("string").alias("key"), "n"
    )
    cells = cms.row_totals(state.cms).select(F.lit("cms_row").alias("dim"), F.col("row").cast("string").alias("key"), "n")
    exact = state.counts.where(F.col("dim").isin("ip", "endpoint"))
    checked = _checked(state.mg.rows, state.ss.rows, exact, state.mg.capacity)
    # The count of each key as long as both summaries keep their bounds for it.
    mg = checked.select(F.concat(F.lit("mg_"), "dim").alias("dim"), "key", F.when(F.col("mg_ok"), F.col("n")).alias("n"))
    ss = checked.select(F.concat(F.lit("ss_"), "dim").alias("dim"), "key", F.when(F.col("ss_ok"), F.col("n")).alias("n"))
    return state.counts.select("dim", "key", "n").unionByName(seconds).unionByName(cells).unionByName(mg).unionByName(ss)


def _state(lines: DataFrame) -> snapshot.State:
    return snapshot.build(lines, mg_capacity=SMALL, ss_capacity=SMALL)


@query
def snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "snapshot")
    snapshot.save(_state(parsed(spark, sf)), path)
    return _state_rows(snapshot.load(spark, path))


@query
def snapshot_resume(spark, sf):
    """The older part of the log saved, loaded, and carried on with the newer part."""
    old, new = _parts(spark, sf)
    path = scratch_path(spark, "snapshot")
    snapshot.save(_state(old), path)
    return _state_rows(snapshot.resume(snapshot.load(spark, path), _state(new)))


@query
def snapshot_resume_old_version(spark, sf):
    """A snapshot of the first version, which holds counts without endpoints and no summaries, carried on."""
    old, new = _parts(spark, sf)
    path = scratch_path(spark, "snapshot")
    kept = counts.all_counts(old).where("dim <> 'endpoint'")
    kept.write.parquet(f"{path}/versions/one/counts")
    row = ("one", 1, 1, ["counts"], None, None, None, None, None)
    spark.createDataFrame([row], snapshot.COMMITS).coalesce(1).write.parquet(f"{path}/commits")
    resumed = snapshot.resume(snapshot.load(spark, path), snapshot.build(new))
    clients = resumed.counts.where("dim = 'ip'").select("key", "n")
    found = cms.estimate(resumed.cms, clients, "key")
    return found.select("key", "n", (F.col("est") >= F.col("n")).alias("not_under"))


@query
def snapshot_first_start(spark, sf):
    """Nothing was saved yet: the state goes on with its own parameters."""
    new = snapshot.build(parsed(spark, sf), CmsParams(width=256), SMALL, SMALL)
    started = snapshot.resume(snapshot.load(spark, scratch_path(spark, "snapshot"), missing_ok=True), new)
    return cms.row_totals(started.cms)


@query
def snapshot_resize_window(spark, sf):
    path = scratch_path(spark, "snapshot")
    snapshot.save(_state(parsed(spark, sf)), path)
    return _ntz(snapshot.resize_window(snapshot.load(spark, path), 3 * DAY).buckets, "sec")


# --- streams ---------------------------------------------------------------------------------------------------


def _width(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _add_files(lines: DataFrame, folder: str) -> None:
    lines.select("value").write.mode("append").text(folder)


def _folders(spark: SparkSession, label: str) -> tuple[str, str, str]:
    base = scratch_path(spark, label)
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def _drain(started) -> None:
    started.awaitTermination()


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return parse_logs(stream_logs(spark, folder), event_clock=True)


@query
def stream_all_counts(spark, sf):
    folder, out, checkpoint = _folders(spark, "stream")
    _add_files(logs(spark, sf), folder)
    _drain(runs.run_counts(_stream(spark, folder), out, checkpoint, drain=True, state_partitions=_width(spark)))
    return runs.current_counts(spark, out)


@query
def stream_file_counts(spark, sf):
    """Several micro-batches: a limit of files for each."""
    folder, out, checkpoint = _folders(spark, "stream")
    old, new = _parts(spark, sf)
    _add_files(old, folder)
    _add_files(new, folder)
    lines = parse_logs(stream_logs(spark, folder, max_files=_width(spark)), event_clock=True)
    _drain(runs.run_counts(lines, out, checkpoint, drain=True, state_partitions=_width(spark)))
    return runs.current_counts(spark, out)


@query
def stream_tail_counts(spark, sf):
    """The tail source over the same files, by the URI of their folder."""
    folder, out, checkpoint = _folders(spark, "tail")
    _add_files(logs(spark, sf), folder)
    tail = stream_tail(spark, f"{folder if ':' in folder else f'file:{folder}'}/part-*")
    lines = parse_logs(tail, event_clock=True)
    _drain(runs.run_counts(lines, out, checkpoint, drain=True, state_partitions=_width(spark)))
    return runs.current_counts(spark, out)


@query
def stream_tail_rotated(spark, sf):
    """Each followed file is replaced by another between two runs (the folder must be a mounted one)."""
    folder, out, checkpoint = _folders(spark, "tail")
    live = folder.removeprefix("file:")
    os.makedirs(live)
    for k, part in enumerate(_parts(spark, sf)):
        _add_files(part, f"{folder}-{k}")
        written = sorted(f for f in os.listdir(f"{live}-{k}") if f.startswith("part-"))
        for i, name in enumerate(written):
            os.replace(f"{live}-{k}/{name}", f"{live}/{i}.log")
        lines = parse_logs(stream_tail(spark, f"{live}/*.log"), event_clock=True)
        _drain(runs.run_counts(lines, out, checkpoint, drain=True, state_partitions=_width(spark)))
    return runs.current_counts(spark, out)


@query
def stream_restart(spark, sf):
    """Stopped after the older part and started again with more files: nothing lost, nothing counted twice."""
    folder, out, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        _drain(runs.run_counts(_stream(spark, folder), out, checkpoint, drain=True, state_partitions=_width(spark)))
    runs.compact_counts(spark, out, f"{out}-compact")
    return runs.current_counts(spark, f"{out}-compact")


@query
def stream_top_ips(spark, sf):
    folder, out, checkpoint = _folders(spark, "stream")
    _add_files(logs(spark, sf), folder)
    _drain(runs.run_counts(_stream(spark, folder), out, checkpoint, drain=True, state_partitions=_width(spark)))
    return runs.current_top(spark, out, "ip", 10)


@query
def stream_reset(spark, sf):
    """The state after a reset at a time of the log: what arrived before is left behind, in one batch as in several."""
    folder, out, checkpoint = _folders(spark, "stream")
    old, new = _parts(spark, sf)
    half = old.where(F.col("event_id") % 2 == 0)
    _add_files(half, folder)
    _drain(runs.run_state(_stream(spark, folder), out, checkpoint, drain=True))
    runs.reset(spark, out, dt.datetime.fromisoformat(SPLIT).replace(tzinfo=dt.timezone.utc))
    _add_files(old.where("ok AND event_id % 2 = 1").unionByName(new), folder)
    _drain(runs.run_state(_stream(spark, folder), out, checkpoint, drain=True))
    return runs.current_state(spark, out).counts


@query
def stream_top_incremental(spark, sf):
    """Heads kept from batch to batch, of several batches in two runs: each reads the heads before it and its own rows."""
    folder, out, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        for half in part.randomSplit([0.5, 0.5], 7):
            _add_files(half.coalesce(1), folder)
        lines = parse_logs(stream_logs(spark, folder, max_files=1), event_clock=True)
        _drain(runs.run_top(lines, out, checkpoint, 10, drain=True, state_partitions=_width(spark)))
    return topk.top_per_dim(runs.current_heads(spark, out).where(F.col("dim").isin("ip", "endpoint")), 10)


@query
def stream_window_retention(spark, sf):
    """Lines per second of the last days, kept in the state store alone."""
    folder, _, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        started = runs.run_seconds(
            _stream(spark, folder), checkpoint, window=7 * DAY, drain=True, state_partitions=_width(spark)
        )
        _drain(started)
    return _ntz(runs.current_seconds(spark, checkpoint, 7 * DAY), "sec")


@query
def stream_rate(spark, sf):
    folder, out, checkpoint = _folders(spark, "stream")
    _add_files(logs(spark, sf), folder)
    started = runs.run_buckets(
        _stream(spark, folder), out, checkpoint, window=DAY, drain=True, state_partitions=_width(spark)
    )
    _drain(started)
    return _ntz(windows.rate_series(runs.current_buckets(spark, out), HOUR), "sec")


@query
def stream_rate_running(spark, sf):
    """The rate of each second is given out when the second closes; only the open ones are worked out at the end."""
    folder, out, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        _drain(runs.run_rate(_stream(spark, folder), out, checkpoint, n=HOUR, drain=True, state_partitions=_width(spark)))
    return _ntz(runs.current_rates(spark, out, checkpoint, HOUR).drop("series"), "sec")


@query
def stream_late_per_event(spark, sf):
    """Late events of each type, in three batches of the order of arrival."""
    folder, out, checkpoint = _folders(spark, "stream")
    layout = "event_id long, event_type string, ts timestamp_ntz, arrival long"
    arrival = F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 7).otherwise(0)
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", arrival.alias("arrival"))
    most = events.agg(F.max("arrival")).first()[0]
    for k in range(3):
        part = events.where((F.col("arrival") > most * k // 3 - (k == 0)) & (F.col("arrival") <= most * (k + 1) // 3))
        part.write.mode("append").parquet(folder)
        lines = spark.readStream.schema(layout).parquet(folder)
        started = runs.run_late(
            lines, out, checkpoint, "event_type", "arrival", "event_id", "ts", 1_800, ["event_id"], drain=True,
            state_partitions=_width(spark),
        )
        _drain(started)
    return runs.current_late(spark, out, "event_id long, late boolean").where("late").select("event_id")


@query
def stream_late_drop(spark, sf):
    """The newer part arrives first, so every line of the older part is late."""
    folder, out, checkpoint = _folders(spark, "stream")
    old, new = _parts(spark, sf)
    for part in (new, old):
        _add_files(part, folder)
        started = runs.run_buckets(
            _stream(spark, folder), out, checkpoint, window=1_800, drain=True, state_partitions=_width(spark)
        )
        _drain(started)
    return _ntz(runs.current_buckets(spark, out), "sec")


@query
def stream_cms(spark, sf):
    folder, out, checkpoint = _folders(spark, "stream")
    _add_files(logs(spark, sf), folder)
    _drain(runs.run_cms(_stream(spark, folder), out, checkpoint, drain=True, state_partitions=_width(spark)))
    kept = runs.current_cms(spark, out)
    return cms.estimate(kept, counts.count_by(_ok(spark, sf), "ip"), "ip")


def _stream_heavy(spark: SparkSession, sf: str) -> str:
    folder, _, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        started = runs.run_heavy_hitters(
            _stream(spark, folder), checkpoint, capacity=SMALL, salts=FEW, drain=True, state_partitions=_width(spark)
        )
        _drain(started)
    return checkpoint


def _stream_checked(spark: SparkSession, sf: str, checkpoint: str) -> DataFrame:
    exact = counts.all_counts(parsed(spark, sf)).where(F.col("dim").isin("ip", "endpoint"))
    return _checked(runs.current_mg(spark, checkpoint).rows, runs.current_ss(spark, checkpoint).rows, exact, SMALL)


@query
def stream_mg(spark, sf):
    checkpoint = _stream_heavy(spark, sf)
    return _stream_checked(spark, sf, checkpoint).drop("ss_ok")


@query
def stream_ss(spark, sf):
    checkpoint = _stream_heavy(spark, sf)
    return _stream_checked(spark, sf, checkpoint).drop("mg_ok")


@query
def stream_state(spark, sf):
    """The whole state kept from one pass, in two runs, saved as a snapshot and loaded."""
    folder, out, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        _drain(runs.run_state(_stream(spark, folder), out, checkpoint, drain=True))
    path = scratch_path(spark, "snapshot")
    snapshot.save(runs.current_state(spark, out, mg_capacity=SMALL, ss_capacity=SMALL), path)
    return _state_rows(snapshot.load(spark, path))


def _stream_reported(spark: SparkSession, sf: str) -> str:
    folder, out, checkpoint = _folders(spark, "stream")
    for part in _parts(spark, sf):
        _add_files(part, folder)
        started = runs.run_report(
            _stream(spark, folder),
            out,
            checkpoint,
            k=10,
            n=60,
            prefix=PREFIX,
            drain=True,
            state_partitions=_width(spark),
            as_of_newest=True,
        )
        _drain(started)
    return out


@query
def stream_report(spark, sf):
    """The exposition that is refreshed after every batch, read back at the end."""
    return runs.current_report(spark, _stream_reported(spark, sf))


@query
def stream_stats_json(spark, sf):
    """The JSON document that is refreshed with it."""
    return runs.current_json(spark, _stream_reported(spark, sf))


@query
def lines_from_table(spark, sf):
    """Any text column as a line source: document lines, hardly any of them log lines."""
    documents = table(spark, sf, "documents")
    split = documents.select(F.explode(F.split("text", "\n")).alias("text_line"))
    return counts.totals(parse_logs(lines_from(split, "text_line"), event_clock=True))
