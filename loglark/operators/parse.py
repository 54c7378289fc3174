"""Lines to typed columns, with rejects kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglark.functions import line
from loglark.functions.once import with_once
from loglark.functions.weight import column
from loglark.schema import PARSED


def parse_logs(
    lines: DataFrame,
    col: str = "value",
    arrival: str | Column | None = None,
    event_clock: bool = False,
) -> DataFrame:
    """Add ``ok`` and the parsed columns to ``lines``; all other columns stay.

    ``ts_received`` is the arrival time (the ``arrival`` column, or now), or with ``event_clock`` the line's own time.

    The regex runs once per line. Invalid lines have NULL in all parsed columns. A malformed time gives a NULL
    ``event_ts`` and leaves the line valid.
    """
    taken = {*PARSED.fieldNames(), "ok", "_f"} & set(lines.columns)
    if taken:
        raise ValueError(f"rename these input columns first: {sorted(taken)}")
    fields = with_once(lines, "_f", line.line_fields(F.col(col)))
    ok = F.coalesce(F.col("_f")[0] != "", F.lit(False))

    def field(i: int) -> Column:
        return F.when(ok, F.col("_f")[i])

    logged = line.event_time(field(4))
    if event_clock:
        received = F.date_trunc("second", logged)
    else:
        received = F.when(ok, line.arrival_second(None if arrival is None else column(arrival)))
    return fields.select(
        *(c for c in lines.columns),
        ok.alias("ok"),
        field(0).alias("ip"),
        field(1).alias("method"),
        field(2).alias("endpoint"),
        field(3).cast("int").alias("status"),
        received.alias("ts_received"),
        logged.alias("event_ts"),
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("ok")


def rejects(parsed: DataFrame, col: str = "value", *keep: str) -> DataFrame:
    """The lines that did not parse, for a quarantine sink."""
    return parsed.where("NOT ok").select(col, *keep)
