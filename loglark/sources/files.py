"""Text logs as line DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglark.functions.weight import column
from loglark.schema import LINES
from loglark.session import path_is_missing


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_logs(
    spark: SparkSession,
    paths: str | Iterable[str],
    missing_ok: bool = False,
    with_source: bool = False,
) -> DataFrame:
    """One row per line. Lines end at ``\\n`` only, so a lone or trailing ``\\r`` stays in the line.

    With ``missing_ok`` a path that does not exist gives no rows. ``with_source`` adds the file of each line.
    """

    def scan(some: list[str]) -> DataFrame:
        lines = spark.read.option("lineSep", "\n").text(some)
        if with_source:
            return lines.select("value", F.col("_metadata.file_path").alias("source"))
        return lines

    if not missing_ok:
        return scan(_paths(paths))
    found = []
    for path in _paths(paths):
        try:
            scan([path])
        except AnalysisException as error:
            if not path_is_missing(error):
                raise
        else:
            found.append(path)
    if found:
        return scan(found)  # one scan, so small files are packed into tasks together
    empty = spark.createDataFrame([], LINES)
    return empty.withColumn("source", F.lit(None).cast("string")) if with_source else empty


def stream_logs(
    spark: SparkSession,
    folder: str,
    max_files: int | None = None,
    max_bytes: int | str | None = None,
    missing_ok: bool = False,
) -> DataFrame:
    """Stream of the files rolled into ``folder``; each is read once. The limits bound one micro-batch.

    With ``missing_ok`` the folder need not exist yet.
    """
    if max_files is not None and max_bytes is not None:
        raise ValueError("give max_files or max_bytes, not both")
    reader = spark.readStream.option("lineSep", "\n")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    # A pattern may match nothing, a plain path must exist.
    return reader.text(f"{folder.rstrip('/')}/*" if missing_ok else folder)


def lines_from(df: DataFrame, text: str | Column, *keep: str) -> DataFrame:
    """Lines out of any batch or streaming DataFrame with a text column (Kafka, a table, a socket)."""
    return df.select(column(text).cast("string").alias("value"), *keep)
