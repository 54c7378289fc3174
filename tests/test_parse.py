import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import GOOD, lines, plan, row_set, rows
from loglark.functions import line, text
from loglark.operators.parse import parse_logs, rejects, valid

# (line, fields or None)
EDGES = [
    (GOOD + " ", ("203.0.113.9", "GET", "/atlas/maps.html", 200)),
    ("", None),
    ("x", None),
    (' a b c [x] "G /e H" 200', None),
    ('a b c [x] "G /e H" 2000', ("a", "G", "/e", 200)),
    ('a b c [x] "G /e" 200', None),
    ('a b c [x] "-" 200', None),
    ('a b c d [x] "G /e H" 200', None),
    ('h.example - - [x y] "G /e?a=1&b=%20 H" 404', ("h.example", "G", "/e?a=1&b=%20", 404)),
    ('::1 - - [x]\t"G  /e   H"   200 5', ("::1", "G", "/e", 200)),
    ('a b c [] "G /e H" 200', None),
    ('a b c [x] "G /e H" 20', None),
    ('a b c [x] "G /e H" 200\r', ("a", "G", "/e", 200)),
    ('a b c [x] "G"q /e H" 200', ("a", 'G"q', "/e", 200)),
    ('a b c [x] "G /e H"z" 301 9 "ref" "agent"', ("a", "G", "/e", 301)),
    ('é - - [x] "GET /ü HTTP/1.1" 200', ("é", "GET", "/ü", 200)),
    ('a b c [x]"G /e H" 200', None),
    ('a b c [x] "G /e H"200', None),
    ('a - - [x] "G /e H" 200 trailing "Z /z H" 500', ("a", "G", "/e", 200)),
    ('a b c [x] "G /e H" 007', ("a", "G", "/e", 7)),
    ("p\nq\nr\ns", None),
    ("p\nq\nr\ns\nt", None),
    ("\n\n\n\n", None),
    ('a b c [x\ny] "G /e H" 200 z\nq', ("a", "G", "/e", 200)),
    ('a\x0bb\x0bc\x0b[x]\x0b"G\x0b/e\x0bH"\x0b200', ("a", "G", "/e", 200)),
    (None, None),
]


def test_edge_lines(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(EDGES)], "i int, value string")
    parsed = parse_logs(df).orderBy("i")
    got = rows(parsed.select("i", "ok", "ip", "method", "endpoint", "status"))
    want = [(i, f is not None, *(f or (None,) * 4)) for i, (_, f) in enumerate(EDGES)]
    assert got == want
    flags = rows(df.select(line.is_valid_line(F.col("value"))))
    assert [f for (f,) in flags] == [f is not None for _, f in EDGES]


def test_the_spelled_out_pattern_agrees_with_the_plain_one(spark):
    df = lines(spark, *(v for v, _ in EDGES if v is not None))
    differ = df.where(F.col("value").rlike(line.LINE_PATTERN) != line.is_valid_line(F.col("value")))
    assert differ.count() == 0


def test_parser_scenario(spark):
    parsed = parse_logs(lines(spark, GOOD, "an entry without fields"))
    assert row_set(valid(parsed).select("ip", "method", "endpoint", "status")) == {
        ("203.0.113.9", "GET", "/atlas/maps.html", 200)
    }
    assert row_set(rejects(parsed)) == {("an entry without fields",)}


def test_event_time(spark):
    values = [
        'a - - [24/Sep/2025:10:00:00 +0530] "G /e H" 200',
        'a [b] c [24/Sep/2025:10:00:00 +0530] "G /e H" 200',
        'a - - [99/Foo/2025:10:00:00 +0530] "G /e H" 200',
        "no line",
    ]
    parsed = parse_logs(lines(spark, *values))
    got = {r.value: (r.ok, r.event_ts) for r in parsed.select("value", "ok", F.col("event_ts").cast("string")).collect()}
    assert [got[v] for v in values] == [
        (True, "2025-09-24 04:30:00"),
        (True, "2025-09-24 04:30:00"),
        (True, None),
        (False, None),
    ]


def test_arrival_time(spark):
    stamped = lines(spark, GOOD, "bad").withColumn("at", F.lit("2025-01-02 03:04:05.678").cast("timestamp"))
    got = rows(parse_logs(stamped, arrival="at").select("ok", F.col("ts_received").cast("string")))
    assert sorted(got, key=str) == [(False, None), (True, "2025-01-02 03:04:05")]
    # No stamp, or a NULL one: the time of the query.
    unstamped = lines(spark, GOOD).withColumn("at", F.lit(None).cast("timestamp"))
    for df in (parse_logs(unstamped, arrival="at"), parse_logs(lines(spark, GOOD))):
        (got,) = rows(df.select("ts_received"))
        assert abs(got[0].astimezone(dt.timezone.utc) - dt.datetime.now(dt.timezone.utc)) < dt.timedelta(minutes=2)
        assert got[0].microsecond == 0


def test_input_columns_stay_and_clashes_are_named(spark):
    df = lines(spark, GOOD).withColumn("host", F.lit("h1"))
    assert parse_logs(df).columns[:2] == ["value", "host"]
    with pytest.raises(ValueError, match="status"):
        parse_logs(df.withColumn("status", F.lit(1)))


def test_regex_runs_once(spark):
    parsed = valid(parse_logs(lines(spark, GOOD))).where("status < 500").groupBy("ip", "endpoint").count()
    assert plan(parsed).split("== Initial Plan ==")[0].count("regexp_replace") == 1


def test_long_line(spark):
    value = 'a - - [x] "GET /' + "y" * 200_000 + ' HTTP/1.1" 200 ' + "z" * 300_000
    (got,) = rows(parse_logs(lines(spark, value)).select("ok", F.length("endpoint")))
    assert got == (True, 200_001)


def test_decode(spark):
    cases = {"a%20b+c": "a b c", "100%": "100%", "%zz": "%zz", "": "", "%C3%BC": "ü", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert dict(rows(df.select("s", text.decode(F.col("s"))))) == cases


def test_query_param(spark):
    cases = {
        "/p?a=1&b=2": "1",
        "/p?b=2": None,
        "/p": None,
        "/p?": None,
        "/p?a": "",
        "/p?a=": "",
        "/p?a=x%20y+z": "x y z",
        "/p?%61=enc": "enc",
        "/p?a=first&a=second": "first",
        "/p?a&a=second": "",
        "/p?a=b=c": "b=c",
        "/p?x=?a=9&a=3": "3",
        "/p?aa=1&a=2": "2",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert dict(rows(df.select("s", text.query_param(F.col("s"), "a")))) == cases


def test_path_clamp_and_labels(spark):
    df = spark.createDataFrame([("/p?x?y", 7, 'a"b\\c\nd')], "s string, v int, t string")
    got = rows(
        df.select(
            text.path_of(F.col("s")),
            text.query_of(F.col("s")),
            text.clamp(F.col("v"), 1, 5),
            text.clamp(F.col("v"), 10, 20),
            text.clamp(F.col("v"), 1, 9),
            text.label_text(F.col("t")),
        )
    )
    assert got == [("/p", "x?y", 5, 10, 7, 'a\\"b\\\\c\\nd')]
