import gzip

import pytest
from pyspark.sql import functions as F

from helpers import GOOD, row_set, rows
from loglark.operators.parse import parse_logs
from loglark.sources import lines_from, read_logs, stream_logs


def test_lines_end_at_newline_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\rthree\nlast")
    assert [v for (v,) in rows(read_logs(spark, str(tmp_path / "a.log")))] == ["one\r", "", "two\rthree", "last"]
    (tmp_path / "empty.log").write_bytes(b"")
    assert rows(read_logs(spark, str(tmp_path / "empty.log"))) == []


def test_globs_gzip_and_source(spark, tmp_path):
    (tmp_path / "a.log").write_text("a1\na2\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("b1\n")
    assert {v for (v,) in rows(read_logs(spark, str(tmp_path / "*.log*")))} == {"a1", "a2", "b1"}
    named = read_logs(spark, str(tmp_path / "*.log*"), with_source=True)
    assert {(v, s.rsplit("/", 1)[1]) for v, s in rows(named)} == {("a1", "a.log"), ("a2", "a.log"), ("b1", "b.log.gz")}


def test_missing_paths(spark, tmp_path):
    (tmp_path / "a.log").write_text("a1\n")
    here, gone = str(tmp_path / "a.log"), str(tmp_path / "gone.log")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_logs(spark, [here, gone])
    assert rows(read_logs(spark, [here, gone], missing_ok=True)) == [("a1",)]
    assert rows(read_logs(spark, gone, missing_ok=True)) == []
    assert read_logs(spark, gone, missing_ok=True, with_source=True).columns == ["value", "source"]


def test_any_text_column(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "x")], "id long, body string")
    lines = lines_from(df, "body", "id")
    assert row_set(parse_logs(lines).select("id", "ok")) == {(1, True), (2, False)}
    assert rows(lines_from(df.where("id = 2"), F.upper("body"))) == [("X",)]


def test_stream_limits(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_logs(spark, str(tmp_path), max_files=1, max_bytes=1)
