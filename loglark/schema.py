"""Row layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

LINES = T.StructType([T.StructField("value", T.StringType())])

PARSED = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("ts_received", T.TimestampType()),
        T.StructField("event_ts", T.TimestampType()),
    ]
)

COUNTS = T.StructType(
    [
        T.StructField("dim", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

BUCKETS = T.StructType(
    [T.StructField("sec", T.TimestampType()), T.StructField("n", T.LongType())]
)

CMS = T.StructType(
    [
        T.StructField("row", T.IntegerType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)

# Heavy-hitter summaries keep one summary per value of ``dim`` (a constant when the summary is not split).
MG = T.StructType(
    [
        T.StructField("dim", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

SS = T.StructType(
    [
        T.StructField("dim", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("err", T.LongType()),
        T.StructField("floor", T.LongType()),
    ]
)

# Dimensions of the one-pass fan-out. "second" is carried only where a state is built.
DIM_TOTAL = "total"
DIM_ERROR = "error"
DIM_IP = "ip"
DIM_ENDPOINT = "endpoint"
DIM_STATUS = "status"
DIM_SECOND = "second"
