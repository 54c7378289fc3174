"""Report tables: summary, metric rows, exposition text, JSON.

They read COUNTS twice, for the ranked keys and for the rest; give them a table that is written rather than a plan that parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglark import params, schema
from loglark.functions.text import label_text
from loglark.operators import topk, windows

# Metric names and help texts of the exposition, and its number of decimals.
TOTAL, ERRORS, RATE = "total_lines", "parse_errors", "lines_per_second"
STATUS, TOP_IP, TOP_ENDPOINT = "status_count", "top_ip", "top_endpoint"
HELP = {
    TOTAL: "Total parsed lines",
    ERRORS: "Parse errors",
    RATE: "Lines/sec",
    STATUS: "Status counts",
}
DECIMALS = 6

TEXT = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("value", T.StringType())])


def stats(counts: DataFrame) -> DataFrame:
    """Rows (item, n): total lines, parse errors, then every status."""
    item = (
        F.when(F.col("dim") == schema.DIM_TOTAL, F.lit("total_lines"))
        .when(F.col("dim") == schema.DIM_ERROR, F.lit("parse_errors"))
        .otherwise(F.concat(F.lit("status "), F.col("key")))
    )
    kept = counts.where(F.col("dim").isin(schema.DIM_TOTAL, schema.DIM_ERROR, schema.DIM_STATUS))
    return kept.select(item.alias("item"), "n")


def rate_text(rate: DataFrame) -> DataFrame:
    """The rate as the summary prints it, with two decimals."""
    return rate.select(F.format_string("%.2f", "rate").alias("rate"))


def _heads(counts: DataFrame, k: int) -> DataFrame:
    """(dim, key, n, rank): all of total, error and status without a rank, the first ``k`` clients and endpoints."""
    many = F.col("dim").isin(schema.DIM_IP, schema.DIM_ENDPOINT)
    few = counts.where(~many & (F.col("dim") != schema.DIM_SECOND))
    ranked = topk.top_per_dim(counts.where(many), k).select("dim", "key", "n", "rank")
    return few.select("dim", "key", "n", F.lit(None).cast("int").alias("rank")).unionByName(ranked)


def _label(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), label_text(value), F.lit('"'))


def metrics_rows(
    counts: DataFrame,
    buckets: DataFrame,
    as_of: Column | None = None,
    k: int | None = None,
    n: int | None = None,
    retention: int | None = None,
) -> DataFrame:
    """Rows (seq, metric, labels, value, count), in the order of the exposition; a rate has no count."""
    heads = _heads(counts, params.report_k(k))
    dim, rank = F.col("dim"), F.col("rank").cast("string")
    ranked_label = F.concat(_label("rank", rank), F.lit(","))
    from_counts = heads.select(
        F.when(dim == schema.DIM_TOTAL, 0)
        .when(dim == schema.DIM_ERROR, 1)
        .when(dim == schema.DIM_STATUS, 3)
        .when(dim == schema.DIM_IP, 4)
        .otherwise(5)
        .alias("part"),
        F.when(dim == schema.DIM_STATUS, F.col("key").cast("int")).otherwise(F.coalesce("rank", F.lit(1))).alias("pos"),
        F.when(dim == schema.DIM_STATUS, _label("code", F.col("key")))
        .when(dim == schema.DIM_IP, F.concat(ranked_label, _label("ip", F.col("key"))))
        .when(dim == schema.DIM_ENDPOINT, F.concat(ranked_label, _label("endpoint", F.col("key"))))
        .otherwise(F.lit(""))
        .alias("labels"),
        F.col("n").alias("count"),
    )
    spark = counts.sparkSession
    # Total and errors are always reported, also when nothing was counted.
    zeros = spark.range(2).select(
        F.col("id").cast("int").alias("part"), F.lit(1).alias("pos"), F.lit("").alias("labels"), F.lit(0).cast("bigint").alias("count")
    )
    rate = windows.rate_last_n(buckets, params.report_seconds(n), as_of, retention).select(
        F.lit(2).alias("part"), F.lit(1).alias("pos"), F.lit("").alias("labels"), F.col("rate").alias("value")
    )
    # Counts stay whole numbers up to here: as a double they would change beyond 2^53.
    rows = from_counts.unionByName(zeros).unionByName(rate, allowMissingColumns=True)
    rows = rows.groupBy("part", "pos", "labels").agg(F.sum("count").alias("count"), F.sum("value").alias("value"))
    names = F.element_at(
        F.array(*(F.lit(m) for m in (TOTAL, ERRORS, RATE, STATUS, TOP_IP, TOP_ENDPOINT))), F.col("part") + 1
    )
    # Three rows, one for each status and 2 k are left to number.
    seq = F.row_number().over(Window.orderBy("part", "pos"))
    value = F.coalesce("value", F.col("count").cast("double"))
    return rows.select(seq.alias("seq"), names.alias("metric"), "labels", value.alias("value"), "count")


def metrics_text(rows: DataFrame, prefix: str = "accesslog") -> DataFrame:
    """The exposition lines (seq, value) of ``metrics_rows``, with the help lines before each first metric."""
    metric = F.col("metric")
    name = F.concat(F.lit(f"{prefix}_"), metric)
    labels = F.when(F.col("labels") == "", F.lit("")).otherwise(F.concat(F.lit("{"), F.col("labels"), F.lit("}")))
    number = F.when(metric == RATE, F.format_string(f"%.{DECIMALS}f", "value")).otherwise(
        F.col("count").cast("string")
    )
    sample = F.concat(name, labels, F.lit(" "), number)
    lines = F.array(sample)
    first = F.row_number().over(Window.partitionBy("metric").orderBy("seq")) == 1
    for item, text in HELP.items():
        head = [F.lit(f"# HELP {prefix}_{item} {text}")]
        if item == STATUS:
            head.append(F.lit(f"# TYPE {prefix}_{item} gauge"))
        lines = F.when((metric == item) & F.col("_first"), F.array(*head, sample)).otherwise(lines)
    spread = rows.withColumn("_first", first).select("seq", F.posexplode(lines).alias("_i", "value"))
    seq = F.row_number().over(Window.orderBy("seq", "_i"))
    return spread.select(seq.alias("seq"), "value")


def write_metrics(text: DataFrame, path: str) -> None:
    """Write the exposition as one small text file, lines in order."""
    text.orderBy("seq").select("value").coalesce(1).write.mode("overwrite").text(path)


def stats_json(
    counts: DataFrame,
    buckets: DataFrame,
    as_of: Column | None = None,
    k: int | None = None,
    n: int | None = None,
    retention: int | None = None,
) -> DataFrame:
    """One row with one JSON document of all statuses and ``k`` ranked keys of either kind."""
    heads = _heads(counts, params.report_k(k))

    def amount(dim: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("dim") == dim, F.col("n"))), F.lit(0).cast("bigint"))

    def ranked(dim: str, name: str) -> Column:
        entry = F.struct("rank", F.col("key").alias(name), F.col("n").alias("count"))
        pairs = F.array_sort(F.collect_list(F.when(F.col("dim") == dim, entry)))
        return F.transform(pairs, lambda e: F.struct(e[name].alias(name), e["count"].alias("count")))

    status = F.struct(F.col("key").cast("int").alias("code"), "key", "n")
    statuses = F.array_sort(F.collect_list(F.when(F.col("dim") == schema.DIM_STATUS, status)))
    body = heads.agg(
        amount(schema.DIM_TOTAL).alias("total_lines"),
        amount(schema.DIM_ERROR).alias("parse_errors"),
        F.map_from_entries(F.transform(statuses, lambda e: F.struct(e["key"], e["n"]))).alias("status_counts"),
        ranked(schema.DIM_IP, "ip").alias("top_ips"),
        ranked(schema.DIM_ENDPOINT, "endpoint").alias("top_endpoints"),
    )
    rate = windows.rate_last_n(buckets, params.report_seconds(n), as_of, retention)
    rate_lps = rate.scalar().cast(f"decimal(20,{DECIMALS})").alias("rate_lps")
    document = body.select(
        "total_lines", "parse_errors", rate_lps, "status_counts", "top_ips", "top_endpoints"
    )
    return document.select(F.to_json(F.struct("*")).alias("json"))
