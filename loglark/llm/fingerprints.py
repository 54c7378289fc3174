"""Context-triggered piecewise hashes of texts, and their likeness.

A hash rolls over the last ``CONTEXT`` bytes. Where its low bits are zero a chunk ends, so boundaries depend on nearby bytes
only and move with them. The number of low bits is the smallest that leaves at most ``CHUNKS`` chunks; their average length
is the block size. Each chunk becomes a symbol of 12 bits (two characters). A fingerprint holds the symbols at its block size
and at twice that, so texts whose block sizes are equal or differ by a factor of two can be compared: by the edit distance
of their symbols (insertions and deletions), 1 for equal sequences and 0 for nothing in common.

To meet its successor, texts are cut into ranges of (id, hash of the text); each range also gets the first row of the range behind
it. Ranges follow a sample of these pairs, so no range holds more than its share, a much-repeated id is cut as well, and rows stream
through a task one after the other. Only rows alike in both stay together.

A null text is empty, and the fingerprint of an empty text has no symbols; ids are in descending order with nulls last,
repeated ids by a hash of their text; a single row is its own successor. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loglark.llm.text import utf8

CONTEXT = 7
CHUNKS = 64
LEAST_BITS = 2
_PIECE = 1 << 20
_BASE = 0x01000193


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A hash of the last CONTEXT bytes at each byte (of fewer at the start)."""
    padded = np.concatenate([np.zeros(CONTEXT - 1, np.uint32), codes.astype(np.uint32)])
    power = [np.uint32(pow(_BASE, k, 1 << 32)) for k in range(CONTEXT)]
    n = len(codes)
    two = padded[1:] + padded[:-1] * power[1]  # two[i]: bytes i, i + 1
    four = two[2:] + two[:-2] * power[2]
    rolled = four[3 : 3 + n] + two[1 : 1 + n] * power[4] + padded[:n] * power[6]
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    return rolled


def _cuts(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the block size, and the ends of chunks at that and at the next block size."""
    bits, ends, values = LEAST_BITS, np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def coarser() -> None:
        nonlocal bits, ends, values
        bits += 1
        keep = (values >> np.uint32(bits - 1)) & np.uint32(1) == 0
        ends, values = ends[keep], values[keep]

    for at in range(0, len(text), _PIECE):
        start = max(0, at - CONTEXT + 1)
        codes = np.frombuffer(text, np.uint8, min(len(text), at + _PIECE) - start, start)
        rolled = _rolled(codes)[at - start :]
        found = np.flatnonzero(rolled & np.uint32((1 << bits) - 1) == 0)
        ends, values = np.concatenate([ends, found + at + 1]), np.concatenate([values, rolled[found]])
        while len(ends) > _PIECE:  # far too many already, so the block size is larger
            coarser()
    while len(ends) >= CHUNKS and bits < 31:
        coarser()
    if len(ends) >= CHUNKS:  # one value all along; no boundary says anything
        ends, values = ends[:0], values[:0]
    wide = ends[(values >> np.uint32(bits)) & np.uint32(1) == 0]
    return bits, ends, wide


def _symbols(text: bytes, ends: np.ndarray) -> str:
    stops = ends.tolist()
    if text and (not stops or stops[-1] < len(text)):
        stops.append(len(text))
    out, start = [], 0
    digest = xxhash.xxh32_intdigest
    for stop in stops:
        out.append(digest(text[start:stop]) & 0xFFF)
        start = stop
    packed = np.array(out, np.uint32)
    six = np.stack([packed >> 6, packed & 63], axis=1).astype(np.uint8).ravel() if out else np.zeros(0, np.uint8)
    return _ALPHABET[six].tobytes().decode()


_ALPHABET = np.frombuffer(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8
)


def fingerprint(text: bytes) -> str:
    """``block size:symbols:symbols at twice the block size``."""
    bits, ends, wide = _cuts(text)
    return f"{1 << bits}:{_symbols(text, ends)}:{_symbols(text, wide)}"


def _alike(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths: one less the share of symbols to insert or delete."""
    first, second = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    if not first or not second:
        return float(first == second)
    masks: dict[str, int] = {}
    for i, symbol in enumerate(first):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    every = (1 << len(first)) - 1
    rows = every
    for symbol in second:
        if symbol in masks:
            both = rows & masks[symbol]
            rows = ((rows + both) | (rows - both)) & every
    return 2 * (len(first) - rows.bit_count()) / (len(first) + len(second))


def likeness(a: str, b: str) -> float:
    """From 0 to 1. Block sizes that differ by more than a factor of two have nothing to compare."""
    if a == b:
        return 1.0
    size_a, fine_a, wide_a = a.split(":")
    size_b, fine_b, wide_b = b.split(":")
    if size_a == size_b:
        return max(_alike(fine_a, fine_b), _alike(wide_a, wide_b))
    if int(size_a) == 2 * int(size_b):
        return _alike(fine_a, wide_b)
    if int(size_b) == 2 * int(size_a):
        return _alike(wide_a, fine_b)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points of ``text`` replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tail, id, text) in order; a tail row is the successor of the last row of its bucket only."""
    bucket = held = None  # held: (id, text, fingerprint)
    out: list[tuple] = []
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for number, tail, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if number != bucket:
                bucket, held = number, None
            if tail and held is None:
                continue  # the first row of the next range, once more
            mark = fingerprint(text)
            if held is not None:
                own = held[1].decode("utf-8", "surrogateescape")
                changed = edited(own, text.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
                other = fingerprint(changed)
                out.append(
                    (
                        held[0], len(own), hashlib.sha256(changed).hexdigest(), held[2], other,
                        likeness(held[2], other), likeness(held[2], mark),
                    )
                )
            held = None if tail else (key, text, mark)
        if len(out) >= 2000:
            yield batch_of()
            out.clear()
    if out:
        yield batch_of()


#: Rows that are looked at for each range of the order.
SAMPLED = 20


def _place(row_id: int | None, tie: int) -> tuple:
    """Places grow in the order of the rows: falling ids, then falling ties, rows without an id last."""
    return (row_id is None, -(row_id or 0), -tie)


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Places that cut the rows into ``parts`` ranges of about equal size. A much-repeated id is cut by its ties.

    They come from a sample of ids and hashes, so only the sizes of the ranges depend on it, never what is compared.
    """
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    some = sorted(_place(r["id"], r["tie"]) for r in rows.select("id", "tie").sample(share, seed=1).collect())
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and the likeness to both that and the row behind it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"), F.xxhash64(text_col).alias("tie")
    )
    bounds = _bounds(rows, parts)

    @F.arrow_udf(IntegerType())
    def range_of(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, _place(i, t)) for i, t in zip(ids.to_pylist(), ties.to_pylist())], pa.int32())

    rows = rows.select(range_of(F.col("id"), F.col("tie")).alias("bucket"), "id", "tie", "text")
    # The first row of each range goes to the range before it as well, that of the first range to the last.
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("head")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], _RESULT)
    moves = [(h.bucket, h["head"].id, h["head"].tie, heads[k - 1].bucket) for k, h in enumerate(heads)]
    moved = F.broadcast(spark.createDataFrame(moves, "bucket int, m_id long, m_tie long, goes int"))  # a row per range
    is_head = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("tie") == F.col("m_tie"))
    tails = rows.join(moved, "bucket").where(is_head).groupBy("goes").agg(
        F.first("id").alias("id"), F.first("tie").alias("tie"), F.first("text").alias("text")
    )
    both = rows.select("bucket", F.lit(False).alias("tail"), "id", "tie", "text").union(
        tails.select("goes", F.lit(True), "id", "tie", "text")
    )
    dealt = both.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("id").desc_nulls_last(), F.col("tie").desc()
    )
    return dealt.select("bucket", "tail", "id", "text").mapInArrow(_compare, _RESULT)
