import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loglark.llm import warc


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")


def row(key, html, url="http://a.example/"):
    return (key, url, html, "mine", "mine")


LONG = "é<p>\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\n" * 400  # several segments, and text that looks like records
SAME = "the same page " * 10


@pytest.mark.parametrize("size", [1, 3, 8192])
def test_chunked_framing(size):
    for body in (b"", b"a", b"0\r\n\r\n", b"x" * 100):
        assert warc.dechunked(warc.chunked(body, size)) == body
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\n"):
        assert warc.dechunked(broken) is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi") == b"hi"
    assert warc.payload_of(b"no end of the head") is None


def test_round_trip(spark, tmp_path):
    rows = [row(1, LONG), row(2, None, None), row(3, SAME), row(4, SAME), row(5, "short"), row(6, "short"), row(7, ""),
            row(None, "no key\n"), row(9, SAME, "http://b/\r\nX-Key: 77"), row(3, SAME), row(10, "x" * 99), row(11, "x" * 99)]
    path = str(tmp_path / "archive")
    warc.write(pages(spark, *rows).repartition(4), path, segment_bytes=1000)
    found = warc.read_records(spark, path)
    kinds = {r.type: r["count"] for r in found.groupBy("type").count().collect()}
    assert kinds["revisit"] == 2 and kinds["response"] == 10 and kinds["continuation"] > 10
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    for r in got:
        html = [(x[2] or "") for x in rows if x[0] == r.key][0].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert r.record_type == ("revisit" if r.key in (4, 9) else "response")
        assert r.refers_to == (3 if r.key in (4, 9) else None)
        assert (bytes(r.payload) if r.payload is not None else None) == (None if r.key in (4, 9) else html)
    assert {r.uri for r in got if r.key in (2, 9)} == {None, "http://b/%0D%0AX-Key: 77"}
    light = warc.read(spark, path, payloads=False)
    assert sorted(map(str, light.collect())) == sorted(str(r) for r in warc.read(spark, path).drop("payload").collect())


def archive(tmp_path, *files):
    for k, records in enumerate(files):
        with gzip.open(tmp_path / f"{k}.gz", "wb") as out:
            for r in records:
                out.write(r + b"\r\n\r\n")
    return str(tmp_path)


def test_segments_in_any_order_over_files_repeated_and_missing(spark, tmp_path):
    make = lambda key, body: list(
        warc.records(key, "u", body, hashlib.sha256(body).hexdigest(), False, f"urn:uuid:{key}", "2020-01-01T00:00:00Z", 64)
    )
    whole, hole, cut = make(1, b"abc" * 90), make(2, b"def" * 90), make(3, b"ghi" * 90)
    assert len(whole) > 4
    path = archive(tmp_path, [whole[3], *whole[4:], hole[0], cut[0], whole[1]], [whole[2], whole[0], whole[3], *hole[2:], *cut[1:-1]])
    got = {r.key: r for r in warc.read(spark, path).collect()}
    assert bytes(got[1].payload) == b"abc" * 90 and got[1].complete
    for k in (2, 3):  # a segment in the middle, and the last one with the total, are missing
        assert got[k].payload is None and not got[k].complete


def test_damaged_archives(spark, tmp_path):
    good = next(warc.records(1, "u", b"fine", hashlib.sha256(b"fine").hexdigest(), False, "urn:uuid:1", "d"))
    wrong = next(warc.records(2, "u", b"other", "00", False, "urn:uuid:2", "d"))
    path = archive(tmp_path, [b"garbage", good, wrong, good[:-9]], [])
    got = sorted((r.key, r.complete, r.payload is None) for r in warc.read(spark, path).collect())
    assert got == [(1, False, True), (1, True, False), (2, False, False)]


def test_revisit_of_nothing(spark, tmp_path):
    lone = next(warc.records(5, "u", b"", "ab", True, "urn:uuid:5", "d"))
    (r,) = warc.read(spark, archive(tmp_path, [lone])).collect()
    assert (r.record_type, r.refers_to, r.payload_bytes, r.complete) == ("revisit", None, None, False)


def test_empty_table(spark, tmp_path):
    path = os.path.join(tmp_path, "none")
    warc.write(pages(spark, row(1, "a")).where(F.col("page_id") == 2), path)
    assert warc.read(spark, path).count() == 0


def test_chunk_framing_is_strict():
    for length in (b"0x5", b"+5", b"1_0", b"", b" 5", b"-5"):
        assert warc.dechunked(length + b"\r\nabcde\r\n0\r\n\r\n") is None
    for body in (b"5\r\nabcde\r\n0\r\n\r\n", b"5;x=1\r\nabcde\r\n0\r\nTrailer: y\r\n\r\n", b"5 \r\nabcde\r\n00\r\n\r\n"):
        assert warc.dechunked(body) == b"abcde"
    for body in (b"5\r\nabcde\r\n0\r\n", b"5\r\nabcde\r\n0", b"5\r\nabcde\r\n", b"5\r\nabcde"):
        assert warc.dechunked(body) is None


def test_archives_that_spark_would_split_are_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\n\r\n")
    with pytest.raises(ValueError, match="not compressed"):
        warc.read_records(spark, str(tmp_path))
