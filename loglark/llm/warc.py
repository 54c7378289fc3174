r"""Web archives: writing pages as WARC records, and reading records back whole.

Writing: a payload becomes an HTTP response with chunked transfer framing; a block longer than a segment goes on in
``continuation`` records. Of records with equal payloads the first is the response, the others are ``revisit`` records that
name its payload digest. Spark's text sink writes bytes as they are, so records are rows, the separator of rows is the
separator of records, and archives are compressed files in any store that Spark writes to.

Reading: an archive is streamed as lines, from which records are cut by their declared length, so memory holds one record.
Segments are grouped by the record they continue, put in order of their number (repeated ones once), and kept only if all
numbers are there and the length is the declared total. Then the transfer framing is taken off. Segments of one record meet
in one task by nature; a record must fit in a Spark value, and groups of more than ``MOST_BYTES`` are reported incomplete
instead of being gathered. Revisits are resolved by a join on the payload digest; one digest with very many revisits is a
large side against one row, which adaptive execution splits.

A null payload is empty; a null address or key is left out of the record and read as null; repeated rows are records each; an
empty table gives an empty archive. A damaged record (cut off, wrong length, broken framing) is read with ``complete`` false and
a null payload. Only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from loglark.llm.text import utf8
from loglark.session import materialize

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Payloads shorter than this are written out each time.
REVISIT_BYTES = 100
#: A segmented record of more bytes than this is not gathered.
MOST_BYTES = 1 << 30

_GAP = b"\r\n\r\n"
#: Endings of files that Spark reads as a whole.
WHOLE_FILES = (".gz", ".deflate", ".zst", ".snappy", ".lz4")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunks, each behind its length in hexadecimal, and the empty chunk that ends it."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The body without its chunk framing; None if the framing is broken or not ended. Extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        length = body[at:end].split(b";")[0].rstrip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]+", length):
            return None
        size = int(length, 16)
        at = end + 2
        if size == 0:
            ended = body[at:] == b"\r\n" or body.endswith(b"\r\n\r\n")
            return b"".join(parts) if ended else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP response, without transfer framing."""
    head, gap, body = block.partition(_GAP)
    if not gap:
        return None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked":
            return dechunked(body)
    return body


def _header(fields: list[tuple[str, object]]) -> bytes:
    """Fields without a value are left out. Line ends within a value would end the field, so they are percent-encoded."""
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.0", *lines]).encode("utf-8", "surrogateescape") + _GAP


def records(key: int | None, uri: str | None, payload: bytes, digest: str, revisit: bool, record: str, date: str,
            segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, each without the gap behind it."""
    fields = [("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("X-Key", key),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        yield _header([("WARC-Type", "revisit"), *fields, ("WARC-Profile", profile), ("Content-Length", 0)])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block += chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        yield _header([("WARC-Type", "response"), *fields, kind, ("Content-Length", len(block))]) + block
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at : at + segment_bytes]
        if n == 1:
            own = [("WARC-Type", "response"), *fields, kind]
            total = None
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record}.{n}>"), ("WARC-Date", date),
                   ("WARC-Segment-Origin-ID", f"<{record}>")]
            total = len(block) if at + segment_bytes >= len(block) else None
        yield _header([*own, ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total),
                       ("Content-Length", len(part))]) + part


def write(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
          segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each row to compressed archives in the new folder ``path``."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), utf8(F.col(payload)).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
    firsts = firsts.agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so the join knows its size: few repeated payloads are broadcast, many are not.
    firsts = materialize(firsts.select(F.col("digest").alias("of"), "first"), "warc-firsts")
    rows = rows.join(firsts, F.col("digest") == F.col("of"), "left").select(
        "key", "uri", "payload", "digest",
        F.coalesce(~F.col("key").eqNullSafe(F.col("first")) & F.col("of").isNotNull(), F.lit(False)).alias("revisit"),
        F.monotonically_increasing_id().alias("row"),
    )
    run, date = uuid.uuid4(), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, u, body, digest, revisit, row in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"urn:uuid:{uuid.uuid5(run, str(row))}"
                out += records(k, u, body, digest, revisit, name, date, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _GAP.decode()).option("compression", "gzip").text(path)


_RECORD = (
    "type string, id string, key long, uri string, digest string, origin string, segment long, total long, "
    "complete boolean, block binary"
)
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(),
          pa.binary()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the lines of whole files (file, line), each line without its line feed."""
    names = [f.split()[0] for f in _RECORD.split(", ")]
    file, fields, body, have, need = None, None, [], 0, -1
    out: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal fields, body, have, need, size
        if fields is not None:
            text = b"".join(body)
            whole = need >= 0 and text[need:] == _GAP
            get = fields.get
            number = {k: int(v) if (v := get(k, b"")).isdigit() else None for k in (b"warc-segment-number", b"warc-segment-total-length")}
            key = get(b"x-key", b"")
            word = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
            digest = word.get(b"warc-payload-digest")
            out.append(
                (
                    word.get(b"warc-type"), word.get(b"warc-record-id"),
                    int(key) if key.removeprefix(b"-").isdigit() else None, word.get(b"warc-target-uri"),
                    digest.removeprefix("sha256:") if digest else None, word.get(b"warc-segment-origin-id"),
                    number[b"warc-segment-number"], number[b"warc-segment-total-length"], whole,
                    text[:need] if whole else None,
                )
            )
            size += len(text)
        fields, body, have, need = None, [], 0, -1

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=names)

    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                close()
                file = name
            if fields is None:
                if line.startswith(b"WARC/"):
                    fields = {}
            elif need < 0:
                if line in (b"\r", b""):
                    length = fields.get(b"content-length", b"")
                    need = int(length) if length.isdigit() else 0
                else:
                    k, _, v = line.partition(b":")
                    fields[k.strip().lower()] = v.strip()
            else:
                body.append(line + b"\n")
                have += len(line) + 1
                if have >= need + len(_GAP):
                    close()
            if size > 8 << 20:
                yield batch_of()
                out, size = [], 0
    close()
    if out:
        yield batch_of()


@F.arrow_udf(BinaryType())
def _payload(blocks: pa.Array) -> pa.Array:
    return pa.array([payload_of(b) if b is not None else None for b in blocks.to_pylist()], pa.binary())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records as they are in the archives. Files must be compressed, so that each is read by one task from its start.

    Spark would split any other file inside a record, so one is an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    split = next((f for f in lines.inputFiles() if not f.endswith(WHOLE_FILES)), None)
    if split is not None:
        raise ValueError(f"{split} is not compressed as a whole ({', '.join(WHOLE_FILES)}): its records could be cut")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_parse, _RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """(id, key, uri, digest, complete, block): one row for each response, its segments joined."""
    plain = found.where("type = 'response' AND segment IS NULL").select("id", "key", "uri", "digest", "complete", "block")
    parts = found.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "id"))
    sizes = F.sum(F.octet_length("block"))
    head = F.max(F.when(F.col("segment") == 1, F.struct("key", "uri", "digest")))
    fits = parts.groupBy("origin").agg(sizes.alias("bytes"), head.alias("head"), F.max("total").alias("declared"),
                                       F.min("complete").alias("whole"))
    gathered = parts.join(fits.where(F.col("bytes") <= MOST_BYTES).select("origin"), "origin", "left_semi")
    gathered = gathered.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("all"))
    once = F.filter("all", lambda p, i: (i == 0) | (F.get("all", i - 1).getField("segment") != p.getField("segment")))
    joined = fits.join(gathered.select("origin", once.alias("all")), "origin", "left")
    # Bytes travel as text values, which Spark joins without looking into them.
    text = F.array_join(F.transform("all", lambda p: p.getField("block").cast("string")), "")
    whole = (
        F.col("whole") & (F.element_at("all", -1).getField("segment") == F.size("all"))
        & (F.octet_length("text") == F.col("declared"))
    )
    out = joined.select("origin", "head", "declared", "whole", "all", text.alias("text"))
    ok = F.coalesce(whole, F.lit(False))
    out = out.select(
        F.col("origin").alias("id"), "head.key", "head.uri", "head.digest", ok.alias("complete"),
        F.when(ok, F.col("text").cast("binary")).alias("block"),
    )
    return plain.union(out)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(key, uri, record_type, refers_to, payload_bytes, payload_digest, complete) for every page, and its payload if asked for.

    Of a revisit the length and digest are those of the response that it names; its payload is null, as it is not stored twice.
    A response is complete if its payload has the digest that its record states.
    """
    found = materialize(read_records(spark, path), "warc-records")
    none = F.lit(None)
    responses = reassembled(found).select("key", "uri", "digest", "complete", _payload(F.col("block")).alias("payload"))
    responses = responses.withColumn("own", F.sha2("payload", 256))
    good = F.coalesce(F.col("complete") & (F.col("own") == F.coalesce("digest", "own")), F.lit(False))
    read_back = responses.select(
        "key", "uri", F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("own").alias("payload_digest"),
        good.alias("complete"), "payload",
    )
    lengths = materialize(read_back.drop("payload"), "warc-responses")
    named = lengths.where("complete").groupBy("payload_digest").agg(
        F.min("key").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes")
    )
    revisits = found.where("type = 'revisit'").select("key", "uri", "digest")
    resolved = revisits.join(named, F.col("digest") == F.col("payload_digest"), "left").select(
        "key", "uri", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", "payload_digest",
        F.col("payload_digest").isNotNull().alias("complete"),
    )
    if payloads:
        return read_back.union(resolved.withColumn("payload", none.cast("binary")))
    return lengths.union(resolved)
