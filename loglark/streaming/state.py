"""Running results in Spark's state store: heavy hitters, the lines of the last seconds, rates, and late events.

Each is an operator on keyed state, so its state is bounded, is committed together with the input offsets, and survives the loss of
any executor. Tasks sum the rows of each Arrow batch first, and keys are dealt to ``salts`` by their hash: a client with a third of all
lines costs one row a batch, and no dimension is in one task. What is kept is read from the checkpoint with the state reader,
as of the last batch that was committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from loglark.functions.weight import column
from loglark.operators import windows
from loglark.operators.task_summaries import MisraGries, SpaceSaving
from loglark.operators.task_summaries import batch_sums as sums_of

SALTS = 16
SUMMARIES, SECONDS, NEWEST, RING = "summaries", "seconds", "newest", "ring"
_STATE = (
    "capacity int, mg_keys array<string>, mg_n array<long>, floor long, ss_keys array<string>, ss_over array<long>, ss_err array<long>"
)


def batch_sums(rows: DataFrame) -> DataFrame:
    """(dim, key, w) summed in each Arrow batch of a task; for batch and streaming rows."""
    sums = sums_of

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sums(batches):
            yield from table.rename_columns(["dim", "key", "w"]).combine_chunks().to_batches()

    return rows.select("dim", "key", "w").mapInArrow(own, "dim string, key string, w long")


class HeavyHitters(StatefulProcessor):
    """A Misra-Gries and a Space-Saving summary of the keys of one (dim, salt), with at most ``capacity`` counters each."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle) -> None:
        self.kept = handle.getValueState(SUMMARIES, _STATE)

    def _restored(self) -> tuple[MisraGries, SpaceSaving]:
        mg, ss = MisraGries(self.capacity), SpaceSaving(self.capacity)
        if self.kept.exists():
            capacity, mg_keys, mg_n, floor, ss_keys, over, err = self.kept.get()
            if capacity != self.capacity:
                raise ValueError(f"the summaries were started with a capacity of {capacity}, not {self.capacity}")
            mg.held = pa.table({"key": pa.array(mg_keys, pa.string()), "w": pa.array(mg_n, pa.int64())})
            ss.floor = floor
            ss.held = pa.table({"key": pa.array(ss_keys, pa.string()), "over": pa.array(over, pa.int64()), "err": pa.array(err, pa.int64())})
        return mg, ss

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mg, ss = self._restored()
        for frame in rows:
            keys, weights = pa.chunked_array([pa.array(frame["key"], pa.string())]), pa.chunked_array([pa.array(frame["w"], pa.int64())])
            sums = pa.table({"key": keys, "w": weights}).group_by("key", use_threads=False).aggregate([("w", "sum")])
            mg.add(sums["key"], sums["w_sum"])
            ss.add(sums["key"], sums["w_sum"])
        m, s = mg.held.to_pydict(), ss.held.to_pydict()
        self.kept.update((self.capacity, m["key"], m["w"], ss.floor, s["key"], s["over"], s["err"]))
        yield pd.DataFrame({"dim": [key[0]], "salt": np.array([key[1]], np.int64), "counters": np.array([len(s["key"])], np.int64)})

    def close(self) -> None:
        pass


def heavy_hitters(pairs: DataFrame, capacity: int, salts: int = SALTS) -> DataFrame:
    """A streaming frame that keeps the summaries of (dim, key) rows with weight ``w``; its rows say how full they are."""
    dealt = batch_sums(pairs).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    return dealt.groupBy("dim", "salt").transformWithStateInPandas(
        HeavyHitters(capacity), "dim string, salt long, counters long", "Update", "None"
    )


class Seconds(StatefulProcessor):
    """Lines of each of the last ``window`` seconds of one salt, up to its newest second.

    Seconds go by the time in the rows. A time to live of the state store goes by the wall clock, which a back-fill does not follow.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle) -> None:
        self.kept = handle.getValueState(SECONDS, "secs array<long>, ns array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        secs, ns = self.kept.get() if self.kept.exists() else ([], [])
        parts = [pd.DataFrame({"sec": secs, "n": ns}, dtype="int64")]
        parts += [pd.DataFrame({"sec": frame["key"].astype("int64"), "n": frame["w"]}) for frame in rows]
        held = pd.concat(parts).groupby("sec", as_index=False)["n"].sum()
        held = held[held["sec"] > held["sec"].max() - self.window]
        self.kept.update((held["sec"].tolist(), held["n"].tolist()))
        yield pd.DataFrame({"salt": np.array([key[0]], np.int64), "seconds": np.array([len(held)], np.int64)})

    def close(self) -> None:
        pass


def seconds(times: DataFrame, ts: str, window: int, salts: int = SALTS) -> DataFrame:
    """A streaming frame that keeps the lines per second of ``ts`` for the last ``window`` seconds; its rows say how many those are."""
    own = times.where(F.col(ts).isNotNull()).select(
        F.lit("").alias("dim"), F.unix_seconds(ts).cast("string").alias("key"), F.lit(1).cast("long").alias("w")
    )
    dealt = batch_sums(own).withColumn("salt", F.pmod(F.col("key").cast("long"), F.lit(salts).cast("long")))
    return dealt.groupBy("salt").transformWithStateInPandas(Seconds(window), "salt long, seconds long", "Update", "None")


class LateMarks(StatefulProcessor):
    """The newest second of one source so far, and for each of its rows whether it came too late for the window that ends there."""

    def __init__(self, window: int, keep: list[str]):
        self.window, self.keep = window, keep

    def init(self, handle) -> None:
        self.newest = handle.getValueState(NEWEST, "sec long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival_key", "tie_key"], kind="stable")
        before = float(self.newest.get()[0]) if self.newest.exists() else -np.inf
        secs = frame["second_key"].to_numpy(dtype=float, na_value=np.nan)
        reached = np.fmax.accumulate(np.concatenate([[before], secs]))
        with np.errstate(invalid="ignore"):
            late = secs < reached[:-1] - (self.window - 1)
        if np.isfinite(reached[-1]):
            self.newest.update((int(reached[-1]),))
        yield frame[self.keep].assign(late=late)

    def close(self) -> None:
        pass


def late_marks(df: DataFrame, source: str, arrival: str | Column, tie: str | Column, ts: str | Column, window: int,
               keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row of a stream, and ``late``: older than the window that ends at the newest second of all
    earlier rows of its source, in the order of arrival and tie.

    Every event counts from the next one on, in whatever batches they come, as long as each batch has the rows that arrived next. The
    state is one number for each source. A task takes the rows of a source in a batch at once; limits of the source bound those.
    """
    rows = df.select(
        *keep, F.col(source).cast("string").alias("source_key"), column(arrival).alias("arrival_key"), column(tie).alias("tie_key"),
        F.unix_seconds(F.date_trunc("second", column(ts)).cast("timestamp")).alias("second_key"),
    )
    layout = T.StructType([*(df.schema[c] for c in keep), T.StructField("late", T.BooleanType())])
    return rows.groupBy("source_key").transformWithStateInPandas(LateMarks(window, keep), layout, "Append", "None")


class RunningRate(StatefulProcessor):
    """The last seconds of one series. A second is closed once one newer by more than ``delay`` was seen; its rate goes out then, once."""

    def __init__(self, n: int, delay: int):
        self.n, self.delay = n, delay

    def init(self, handle) -> None:
        self.kept = handle.getValueState(RING, "closed long, secs array<long>, ns array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, secs, ns = self.kept.get() if self.kept.exists() else (None, [], [])
        parts = [pd.DataFrame({"sec": secs, "n": ns}, dtype="int64")]
        for frame in rows:
            own = pd.DataFrame({"sec": frame["key"].astype("int64"), "n": frame["w"]})
            parts.append(own if closed is None else own[own["sec"] > closed])  # a closed second is closed
        held = pd.concat(parts).groupby("sec", as_index=False)["n"].sum()
        secs, ns = held["sec"].to_numpy(), held["n"].to_numpy()
        if not len(secs):
            return
        until = max(int(secs[-1]) - self.delay - 1, closed if closed is not None else int(secs[0]) - 1)
        so_far = np.concatenate([[0], np.cumsum(ns)])
        rates = (so_far[1:] - so_far[np.searchsorted(secs, secs - self.n, side="right")]) / self.n
        out = (secs <= until) & (secs > (closed if closed is not None else secs[0] - 1))
        stay = secs > until + 1 - self.n
        self.kept.update((until, secs[stay].tolist(), ns[stay].tolist()))
        yield pd.DataFrame({"series": key[0], "sec": pd.to_datetime(secs[out], unit="s"), "rate": rates[out]})

    def close(self) -> None:
        pass


def running_rate(df: DataFrame, ts: str, n: int, delay: int = 0, by: str | Column | None = None) -> DataFrame:
    """(series, sec, rate) of a stream: the trailing ``n``-second rate of each second with events, given out once, when it closes.

    Lines are summed per second in their tasks, so a series sends a row a second and Arrow batch. The state is a ring of n + delay seconds.
    Lines of a closed second are late and left out.
    """
    series = F.lit("") if by is None else F.coalesce(column(by).cast("string"), F.lit(""))
    own = df.where(F.col(ts).isNotNull()).select(
        series.alias("dim"), F.unix_seconds(ts).cast("string").alias("key"), F.lit(1).cast("long").alias("w")
    )
    return batch_sums(own).groupBy("dim").transformWithStateInPandas(
        RunningRate(n, delay), "series string, sec timestamp, rate double", "Append", "None"
    )


def open_rates(spark: SparkSession, checkpoint: str, n: int) -> DataFrame:
    """(series, sec, rate) of the seconds that are not closed yet, from the rings: what they would be if nothing more came."""
    found = _state(spark, checkpoint, RING)
    if found is None:
        return spark.createDataFrame([], "series string, sec timestamp, rate double")
    pairs = F.arrays_zip(F.col("value.secs").alias("sec"), F.col("value.ns").alias("n"))
    ring = found.select(F.col("key.dim").alias("series"), F.col("value.closed").alias("closed"), F.inline(pairs))
    ring = ring.withColumn("sec", F.timestamp_seconds("sec"))
    rates = windows.rate_series(ring.select("series", "sec", "n"), n, by=["series"])
    ends = found.select(F.col("key.dim").alias("series"), F.timestamp_seconds("value.closed").alias("closed"))
    return rates.join(ends, "series").where(F.col("sec") > F.col("closed")).select("series", "sec", "rate")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame | None:
    """The state of a checkpoint; None if no batch was committed yet."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    try:
        return reader.load()
    except (AnalysisException, PySparkException) as error:
        if "STDS_" in (error.getCondition() or "") or "STATE" in (error.getCondition() or ""):
            return None
        raise


def summaries(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """(dim, salt, capacity, mg_keys, ...): the summaries of all salts."""
    found = _state(spark, checkpoint, SUMMARIES)
    return None if found is None else found.select("key.dim", "key.salt", "value.*")


def kept_seconds(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bucket table (sec, n)."""
    found = _state(spark, checkpoint, SECONDS)
    if found is None:
        return spark.createDataFrame([], "sec timestamp, n long")
    pairs = F.arrays_zip(F.col("value.secs").alias("sec"), F.col("value.ns").alias("n"))
    return found.select(F.inline(pairs)).select(F.timestamp_seconds("sec").alias("sec"), "n")
