import json

from pyspark.sql import functions as F

from helpers import lines, plan, rows
from loglark.operators import counts, windows
from loglark.operators.parse import parse_logs
from loglark.plans import report


def log(client, endpoint, status, second):
    return f'{client} - - [24/Sep/2025:10:00:{second:02d} +0000] "GET {endpoint} H" {status}'


LINES = [log("1.1.1.1", "/a", 200, 0), log("1.1.1.1", "/b", 200, 1), log("2.2.2.2", "/a", 404, 2), "bad"]


def inputs(spark, values):
    parsed = parse_logs(lines(spark, *values), event_clock=True)
    buckets = windows.per_second(parsed)
    return counts.all_counts(parsed), buckets, windows.last_second(buckets)


def test_text(spark):
    text = report.metrics_text(report.metrics_rows(*inputs(spark, LINES), k=1, n=10), "web")
    got = [v for _, v in sorted(rows(text))]
    assert got == [
        "# HELP web_total_lines Total parsed lines",
        "web_total_lines 3",
        "# HELP web_parse_errors Parse errors",
        "web_parse_errors 1",
        "# HELP web_lines_per_second Lines/sec",
        "web_lines_per_second 0.300000",
        "# HELP web_status_count Status counts",
        "# TYPE web_status_count gauge",
        'web_status_count{code="200"} 2',
        'web_status_count{code="404"} 1',
        'web_top_ip{rank="1",ip="1.1.1.1"} 2',
        'web_top_endpoint{rank="1",endpoint="/a"} 2',
    ]


def test_text_file_keeps_the_order(spark, tmp_path):
    text = report.metrics_text(report.metrics_rows(*inputs(spark, LINES)))
    for _ in range(2):
        report.write_metrics(text, str(tmp_path / "m"))
    got = [v for (v,) in rows(spark.read.text(str(tmp_path / "m")))]
    assert got == [v for _, v in sorted(rows(text))]


def test_labels_are_escaped(spark):
    client = 'a"b\\c - - [24/Sep/2025:10:00:00 +0000] "GET /q H" 200'
    text = report.metrics_text(report.metrics_rows(*inputs(spark, [client])))
    assert 'accesslog_top_ip{rank="1",ip="a\\"b\\\\c"} 1' in [v for _, v in rows(text)]


def test_nothing_counted(spark):
    text = report.metrics_text(report.metrics_rows(*inputs(spark, [])))
    got = [v for _, v in sorted(rows(text)) if not v.startswith("#")]
    assert got == ["accesslog_total_lines 0", "accesslog_parse_errors 0", "accesslog_lines_per_second 0.000000"]
    ((doc,),) = rows(report.stats_json(*inputs(spark, [])))
    assert json.loads(doc) == {
        "total_lines": 0,
        "parse_errors": 0,
        "rate_lps": 0.0,
        "status_counts": {},
        "top_ips": [],
        "top_endpoints": [],
    }


def test_json(spark):
    odd = 'a"b\\c - - [24/Sep/2025:10:00:00 +0000] "GET /q H" 200'
    ((doc,),) = rows(report.stats_json(*inputs(spark, [*LINES, odd]), k=2, n=10))
    assert json.loads(doc) == {
        "total_lines": 4,
        "parse_errors": 1,
        "rate_lps": 0.4,
        "status_counts": {"200": 3, "404": 1},
        "top_ips": [{"ip": "1.1.1.1", "count": 2}, {"ip": "2.2.2.2", "count": 1}],
        "top_endpoints": [{"endpoint": "/a", "count": 2}, {"endpoint": "/b", "count": 1}],
    }


def test_stats(spark):
    table, _, _ = inputs(spark, LINES)
    assert sorted(rows(report.stats(table))) == [
        ("parse_errors", 1),
        ("status 200", 2),
        ("status 404", 1),
        ("total_lines", 3),
    ]


def test_every_status_is_reported_whatever_k(spark):
    values = [log("c", "/", s, 0) for s in range(100, 160)]
    got = report.metrics_rows(*inputs(spark, values), k=1).where("metric = 'status_count'")
    assert got.count() == 60


def test_counts_are_scanned_for_heads_and_the_rest(spark, tmp_path):
    lines(spark, *LINES).write.text(str(tmp_path / "in"))
    parsed = parse_logs(spark.read.text(str(tmp_path / "in")), event_clock=True)
    buckets = spark.createDataFrame([], "sec timestamp, n long")
    as_of = F.current_timestamp()
    for df in (
        report.metrics_rows(counts.all_counts(parsed), buckets, as_of),
        report.stats_json(counts.all_counts(parsed), buckets, as_of),
    ):
        text = plan(df)
        # Ranked keys are cut in parts before they are shuffled, and again before the dim is ranked; the rest is not ranked.
        assert text.count("FileScan") == 2 and text.count("WindowGroupLimit") == 4
