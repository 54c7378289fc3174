"""Near-duplicate texts by SimHash, found with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * HALF`` bits have a common variant within ``HALF`` bits of each. Every distinct
fingerprint therefore stands for all its variants within ``HALF`` bits (2 081 of them), variants are brought together by a
shuffle, and fingerprints that meet at a variant are linked. Variants with the same leading bits travel as one row (leading
bits, fingerprint) and are spelled out behind the shuffle, which makes it 25 times smaller and loses none: leading bits
within ``HALF`` flips are enumerated before, the rest of the flips after.

Skew: exact copies are one fingerprint. A cluster of near copies has at most as many distinct fingerprints as its Hamming
ball, and at most 2 081 of them meet at one variant. A large bucket is cut by further bits, so a task holds a bounded number
of variants. Each bucket sends on a spanning forest of its links, never all pairs.

Nulls and empty texts have the fingerprint zero and link like any other; repeated rows stay; a null id is ignored when the
smallest id of a component is taken; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loglark.llm.components import components
from loglark.llm.text import columns, fresh, utf8
from loglark.session import materialize

WORDS = 4
SEED = 42
HALF = 2
#: Variants spelled out at once in a task (8 bytes each, some copies of them while they are sorted).
VARIANTS_AT_ONCE = 1 << 22
#: Links a task gathers before it sends a spanning forest of them on.
LINKS_AT_ONCE = 1 << 20


def text_fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the XXH64 values of the word shingles."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # 64 bytes a hash while bits are counted
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    values = np.fromiter((text_fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a BIGINT with the same 64 bits."""
    return _fingerprint(utf8(text))


def fingerprint_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` set bits among the lowest ``bits``."""
    masks = [0]
    for k in range(1, most + 1):
        masks += [sum(1 << i for i in at) for at in combinations(range(bits), k)]
    return np.array(masks, np.uint64)


def prefix_bits(distinct: int) -> int:
    """Leading bits to shuffle on: about 64 fingerprints for each value of them, at any number of fingerprints."""
    return min(32, max(8, math.ceil(math.log2(max(1, distinct) / 64))))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the graph of the links a-b; roots are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _meet(
    head: int, fps: np.ndarray, spent: np.ndarray, low: int, half: int, at_once: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the fingerprints that share a variant in the bucket of the leading bits ``head``.

    ``spent`` counts the flips that a fingerprint needed to reach the bucket; ``low`` bits are left below its leading bits.
    """
    budget = half - spent
    sizes = np.array([sum(math.comb(low, k) for k in range(f + 1)) for f in range(half + 1)])
    total = int(sizes[budget].sum())
    if len(fps) < 2:
        return
    if total > at_once and low > 0:
        step = min(4, low)
        shift = np.uint64(low - step)
        digit = (fps >> shift) & np.uint64((1 << step) - 1)
        for child in range(1 << step):
            more = spent + np.bitwise_count(digit ^ np.uint64(child)).astype(np.int64)
            inside = more <= half
            yield from _meet((head << step) | child, fps[inside], more[inside], low - step, half, at_once)
        return
    own = fps & np.uint64((1 << low) - 1)
    variants, index = [], []
    for left in range(half + 1):
        rows = np.flatnonzero(budget == left)
        masks = flips(low, left)
        variants.append((own[rows][:, None] ^ masks[None, :]).ravel())
        index.append(np.repeat(rows, len(masks)))
    variant = np.concatenate(variants)
    ordered = np.sort(variant)
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(shared):
        return
    shared = np.unique(shared)
    place = np.minimum(np.searchsorted(shared, variant), len(shared) - 1)
    hit = np.flatnonzero(shared[place] == variant)
    group, who = place[hit], np.concatenate(index)[hit]
    value = fps[who]
    by = np.lexsort((value, group))
    group, value, meeting = group[by], value[by], variant[hit][by]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = np.repeat(value[starts], np.diff(np.r_[starts, len(group)]))
    # A pair meets at each midpoint of its differing bits. It counts at one of them only, the one that takes the lower half
    # of those bits from the smaller fingerprint. Where a link to the smallest of a group is left out, both ends are linked
    # to the smallest of the other group, so no component is torn.
    differ = first ^ value
    count = np.bitwise_count(differ).astype(np.int64)
    lower, rest = np.zeros_like(differ), differ.copy()
    for k in range(half):
        bit = rest & (~rest + np.uint64(1))
        take = k < (count + 1) // 2
        lower[take] |= bit[take]
        rest ^= bit
    keep = (count > 0) & (count <= 2 * half) & ((first ^ lower) == (meeting | np.uint64(head << low)))
    yield first[keep], value[keep]


def links(distinct: DataFrame, half: int = HALF, bits: int | None = None) -> DataFrame:
    """(a, b): links that join the same components as all pairs within ``2 * half`` bits. ``distinct`` holds (fp), no row twice."""
    bits = prefix_bits(distinct.count()) if bits is None else bits
    low = 64 - bits
    near = F.array(*[F.lit(int(m)).cast("long") for m in flips(bits, half)])
    head = F.shiftrightunsigned(F.col("fp"), low)
    rows = distinct.select("fp", F.explode(near).alias("flip")).select(head.bitwiseXOR(F.col("flip")).alias("head"), "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a: list[np.ndarray] = []
        found_b: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            child, root = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a.clear()
            found_b.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(root.view(np.int64)), pa.array(child.view(np.int64))], names=["a", "b"]
            )

        def buckets() -> Iterator[tuple[int, np.ndarray]]:
            """Rows come sorted by their leading bits; a bucket may span several batches."""
            head, parts = None, []
            for batch in batches:
                heads = batch.column(0).to_numpy()
                fps = batch.column(1).to_numpy().view(np.uint64)
                cuts = np.flatnonzero(np.diff(heads)) + 1
                for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(heads)]):
                    if start == stop:
                        continue
                    if heads[start] != head and parts:
                        yield head, np.concatenate(parts)
                        parts = []
                    head = heads[start]
                    parts.append(fps[start:stop])
            if parts:
                yield head, np.concatenate(parts)

        for head, fps in buckets():
            spent = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(head)).astype(np.int64)
            for a, b in _meet(int(head), fps, spent, low, half, VARIANTS_AT_ONCE):
                if len(a):
                    found_a.append(a)
                    found_b.append(b)
                    held += len(a)
            if held > LINKS_AT_ONCE:
                yield flush()
                held = 0
        if found_a:
            yield flush()

    dealt = rows.repartition("head").sortWithinPartitions("head")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", half: int = HALF) -> DataFrame:
    """(id, text_hash, fp, component_id, root) for every row: fingerprints within ``2 * half`` bits are linked.

    ``component_id`` is the smallest id that can be reached, ``root`` the smallest fingerprint, which tells components apart
    that share that id. ``text_hash`` (XXH64 of the text) tells rows of one id apart.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("text_hash"),
            fingerprint(F.col(text_col)).alias("fp"),
        ),
        "simhash-rows",
    )
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), half))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    labelled = materialize(labelled, "simhash-labels")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "root").select("fp", "component_id", "root")
    return rows.join(of_fp, "fp", "left").select("id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", half: int = HALF) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (a component of null ids keeps one of them)."""
    marked = near_duplicates(docs, id_col, text_col, half)
    kept = marked.where(F.col("id").eqNullSafe(F.col("component_id")))
    # Rows of one component can share the smallest id: rows of one id with other texts, or repeated rows.
    one = kept.groupBy("root").agg(
        F.min_by(F.struct("id", "text_hash"), F.struct("text_hash")).alias("_one"), F.count("*").alias("_n")
    )
    id_name, hash_name, n_name = (fresh(docs, c) for c in ("_id", "_hash", "_n"))
    one = one.select(F.col("_one.id").alias(id_name), F.col("_one.text_hash").alias(hash_name), F.col("_n").alias(n_name))
    one = materialize(one, "simhash-kept")
    same = F.col(id_col).eqNullSafe(F.col(id_name)) & (F.xxhash64(text_col) == F.col(hash_name))
    single = docs.join(one.where(F.col(n_name) == 1), same, "left_semi")
    tied = docs.join(one.where(F.col(n_name) > 1), same, "left_semi")
    first = tied.groupBy(F.col(id_col).alias("_a"), F.xxhash64(text_col).alias("_b")).agg(
        F.first(F.struct(*columns(docs))).alias("_row")
    )
    return single.union(first.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
