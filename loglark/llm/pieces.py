"""SentencePiece encoding by a table of distinct marked words, and decoding.

The library turns every space into a marker and puts one marker before the text. Where no piece of the model has a marker after
another character, no piece can lie across the start of a marked word (markers, then all up to the next marker), so the ids of a
text are those of its marked words one after the other. Hence

1. texts are cut into marked words in blocks of ``BLOCK_BYTES`` (a longer text is a block of its own): a block has its distinct
   words and, for each text, the places of its words among them. Both are written once, bucketed by block;
2. the distinct words of all blocks meet by a hash of the word, where each word is segmented once, whatever number of blocks it is
   in. Only the words of blocks travel, packed, never the texts, so a frequent word costs one entry a block;
3. the ids go back to their block and take their places in its texts. The texts' side is bucketed already and is not shuffled.

A model whose pieces can cross a marker, or that changes white space, has no such words: then each distinct text is one word of
the table. The model file travels with the query (its size is that of a vocabulary), the texts and words never meet in the driver.

A null or empty text has no ids. Bytes that are not UTF-8 are read as replacement characters. Repeated rows, and rows with equal or
null ids, are rows each: nothing is joined by id. An empty table gives an empty result. Only the named columns are kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglark.session import scratch_path

MARK = "▁"
#: Text that shares one list of distinct words; it bounds the memory of a task.
BLOCK_BYTES = 16 << 20
#: Ids that leave a task in one batch.
BATCH_IDS = 1 << 20
#: Texts taken out of an Arrow batch at once.
ROWS = 256


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver."""
    return Path(path).read_bytes()


def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_markers(model: bytes) -> bool:
    """Whether the ids of a text are those of its marked words: no piece has a marker behind another character, and white space
    is only marked, not changed."""
    sp = _processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    crossing = any(b == MARK != a for p in pieces for a, b in pairwise(p))
    return not crossing and sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, the first bytes of all before the second ones and so on, compressed: most high bytes are zero."""
    planes = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.int32).ravel()


class _Words:
    """The marked words of a list of texts: the distinct ones, by bucket, and which of them each text has.

    The k-th word of bucket b has the number ``k * buckets + b``.
    """

    def __init__(self, texts: list[bytes], buckets: int, split: bool):
        mark, space = MARK.encode(), b" "
        marked = [space + t.replace(mark, space) if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked], dtype=np.int64)])
        data = b"".join(marked)
        del marked
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        if split:
            spaces = np.frombuffer(data, np.uint8) == 32
            first = spaces.copy()
            first[1:] &= ~spaces[:-1]
            first[starts] = True
            starts = np.flatnonzero(first)
        ends = np.concatenate([starts, [len(data)]])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = pa.array([w.replace(space, mark) for w in words.dictionary.to_pylist()], pa.binary())
        bucket = np.fromiter((zlib.crc32(w) for w in distinct.to_pylist()), np.int64, len(distinct)) % buckets
        codes = words.indices.to_numpy()
        del words, ends
        # In a bucket, words by the order of magnitude of their count: frequent words get small numbers, which pack well.
        often = np.frexp(np.bincount(codes, minlength=len(distinct)).astype(float))[1]
        keys = pa.table({"bucket": bucket, "often": often, "word": distinct})
        order = pc.sort_indices(keys, sort_keys=[("bucket", "ascending"), ("often", "descending"), ("word", "ascending")]).to_numpy()
        of_bucket = np.bincount(bucket, minlength=buckets)
        in_bucket = np.arange(len(order)) - np.repeat(np.cumsum(of_bucket) - of_bucket, of_bucket)
        place = np.empty(len(order), np.int32)
        place[order] = in_bucket * buckets + bucket[order]
        self.places = place[codes]
        self.cuts = np.searchsorted(starts, offsets)  # the first word of each text
        self.distinct = distinct.take(order)
        self.bucket = bucket[order]

    def of_text(self, i: int) -> bytes:
        return _packed(self.places[self.cuts[i] : self.cuts[i + 1]])

    def of_buckets(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, bytes, words): a marked word has no space, so a space parts them."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(self.bucket) else []
        for a, b in pairwise(edges):
            words = b" ".join(self.distinct.slice(a, b - a).to_pylist())
            yield int(self.bucket[a]), len(words), pa.compress(words, codec="zstd", asbytes=True)


def _texts(column: pa.Array) -> list[bytes]:
    try:
        column.cast(pa.string()).validate(full=True)
    except pa.ArrowInvalid:
        return [(t or b"").decode("utf-8", "replace").encode() for t in column.to_pylist()]
    return [t or b"" for t in column.to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch], buckets: int, split: bool) -> Iterator[pa.RecordBatch]:
    """Rows of texts (doc, n, packed places) and rows of words (bucket, n, packed words) of the blocks of one task."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.Array] = []
    texts: list[bytes] = []

    def block() -> pa.RecordBatch:
        words = _Words(texts, buckets, split)
        texts.clear()
        docs = pa.concat_arrays(held)
        held.clear()
        lists = list(words.of_buckets())
        n, m = len(docs), len(lists)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number] * (n + m), pa.int64()),
            "doc": pa.concat_arrays([docs, pa.nulls(m, docs.type)]),
            "bucket": pa.array([*[None] * n, *(x[0] for x in lists)], pa.int32()),
            "n": pa.array([*np.diff(words.cuts).tolist(), *(x[1] for x in lists)], pa.int32()),
            "packed": pa.array([*(words.of_text(i) for i in range(n)), *(x[2] for x in lists)], pa.binary()),
        })

    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            own, docs = _texts(batch.column("text").slice(at, ROWS)), batch.column("doc").slice(at, ROWS)
            begin = 0
            for i, text in enumerate(own):
                if size and size + len(text) > BLOCK_BYTES:
                    held.append(docs.slice(begin, i - begin))
                    texts.extend(own[begin:i])
                    yield block()
                    number, size, begin = number + 1, 0, i
                size += len(text) + 1
            held.append(docs.slice(begin))
            texts.extend(own[begin:])
    if texts:
        yield block()


def _segment(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """The ids of all words of a bucket; each distinct word of it is segmented once."""
    sp = _processor(model)
    known: dict[str, list[int]] = {}
    bucket = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket, known = row["bucket"], {}
            words = pa.decompress(row["packed"], decompressed_size=row["n"], codec="zstd", asbytes=True).decode().split(" ")
            new = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(new, sp.encode([w[1:] for w in new], num_threads=1)))
            if MARK in new:  # a marker alone: nothing is left without it
                known[MARK] = [sp.piece_to_id(MARK)]
            found = [known[w] for w in words]
            lens = np.fromiter(map(len, found), np.int32, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32)
            made = {"block": row["block"], "bucket": bucket, "n_words": len(lens), "lens": _packed(lens)}
            yield pa.RecordBatch.from_pylist([made | {"n_ids": len(ids), "ids": _packed(ids)}], schema=_FOUND)


_FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n_words", pa.int32()), ("lens", pa.binary()),
                    ("n_ids", pa.int32()), ("ids", pa.binary())])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _assemble(docs: pa.Table, words: pa.Table, buckets: int, model: bytes | None) -> pa.Table:
    """The ids of the texts of one block, and with a ``model`` what it decodes them to."""
    found = words.sort_by("bucket").to_pylist()
    lens = np.concatenate([np.empty(0, np.int32), *(_unpacked(r["lens"], r["n_words"]) for r in found)])
    ids = np.concatenate([np.empty(0, np.int32), *(_unpacked(r["ids"], r["n_ids"]) for r in found)])
    starts = np.cumsum(lens) - lens
    first = np.zeros(buckets, np.int64)
    for r, at in zip(found, np.cumsum([0, *(r["n_words"] for r in found)])):
        first[r["bucket"]] = at
    sp = None if model is None else _processor(model)
    made, out, size, begin = [], [], 0, 0
    doc = docs["doc"].combine_chunks()
    for i, (n, packed) in enumerate(zip(docs["n"].to_pylist(), docs["packed"].to_pylist())):
        place = _unpacked(packed, n)
        at = first[place % buckets] + place // buckets
        own = lens[at]
        ends = np.cumsum(own)
        shift = np.repeat(starts[at] - (ends - own), own)
        out.append(ids[shift + np.arange(len(shift))])
        size += len(shift)
        if size > BATCH_IDS or i + 1 == len(doc):
            columns = {"doc": doc.slice(begin, i + 1 - begin), "ids": _lists(out)}
            if sp is not None:
                columns["decoded"] = pa.array([sp.decode(x.tolist()) for x in out], pa.string())
            made.append(pa.RecordBatch.from_pydict(columns))
            out, size, begin = [], 0, i + 1
    return pa.Table.from_batches(made)


def _bucketed(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``column``, so that a grouping by it needs no shuffle."""
    spark = df.sparkSession
    name = f"loglark_{uuid.uuid4().hex}"
    df.write.option("path", scratch_path(spark, "words")).bucketBy(parts, column).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
    return written


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row and its ids, without begin and end; and what they decode to, where ``decoded`` names it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = splits_at_markers(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    layout = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType),
        T.StructField("bucket", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType()),
    ])
    cut, segment, assemble = _cut, _segment, _assemble

    written = _bucketed(rows.mapInArrow(lambda batches: cut(batches, parts, split), layout), "block", parts)
    words = written.where(F.col("bucket").isNotNull()).select("bucket", "block", "n", "packed")
    found = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: segment(batches, model), "block long, bucket int, n_words int, lens binary, n_ids int, ids binary"
    )
    texts = written.where(F.col("bucket").isNull()).select("block", "doc", "n", "packed")
    fields = [written.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        fields.append(T.StructField("decoded", T.StringType()))
    back = None if decoded is None else model
    done = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        lambda left, right: assemble(left, right, parts, back), T.StructType(fields)
    )
    return done.select("doc.*", F.col("ids").alias(to), *([] if decoded is None else [F.col("decoded").alias(decoded)]))


def decode(ids: Column, model: bytes) -> Column:
    """The text of each list of ids. Null is null."""

    @F.pandas_udf(T.StringType())
    def texts(lists: pd.Series) -> pd.Series:
        sp = _processor(model)
        return pd.Series([None if x is None else sp.decode(x.tolist()) for x in lists], dtype=object)

    return texts(ids)
