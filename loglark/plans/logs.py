"""Log lines derived from the ``events`` table: the input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglark.operators.parse import parse_logs
from loglark.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, value): one Common Log Format line per event; every fiftieth line is malformed."""
    subnet = (F.col("user_id") % 4).cast("string")
    client = F.concat(F.lit("10.0."), subnet, F.lit("."), F.col("user_id").cast("string"))
    method = F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET")
    line = F.concat(
        client,
        F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'),
        method,
        F.lit(" /"),
        F.col("event_type"),
        F.lit("?k="),
        F.get_json_object("props", "$.k"),
        F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "500").otherwise("200"),
        F.lit(" "),
        F.floor(F.col("value") * 100).cast("bigint").cast("string"),
    )
    bad = F.concat(F.lit("bad "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("event_id") % 50 == 0, bad).otherwise(line).alias("value")
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed log, with the event's own time as its arrival time."""
    return parse_logs(logs(spark, sf_dir), arrival="ts")
