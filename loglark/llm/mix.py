"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A text is to be taken ``target / source_size`` times on average: the whole part of
that for certain, the rest with a probability. Texts of a source meet in pairs, in a fixed order, and move expected words
from one to the other in a random direction until one of them is taken or left for certain; the other meets the next text.
Expected words are moved, so the words of a source stay the same at every step, and each text keeps its probability.

The pairing is a tree. A chunk of about ``CHUNK`` texts of one source is worked off in a task and leaves one undecided text;
the undecided of ``FAN`` chunks meet in the next level, up to one text of each source, which is drawn. A large source has
many chunks, so it is spread, and a chunk is streamed, so memory does not grow with it. Random numbers are hashes of the pair
and the seed, chunks are hashes of the row, so a second run decides alike.

A null text has no words and is never taken more than its zero words; a null source is a source, after all others; repeated
rows count as rows each. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglark.llm.text import columns, fresh
from loglark.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CHUNK = 2_000
FAN = 1_000
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``rank`` from 0 in the order of the column ``key``, null last.

    Rows are sorted over range partitions; only the number of rows of each partition is summed up in one place.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).isNull(), F.col(key)]
    dealt = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(dealt, "ranks").withColumn("_part", F.shiftright("_at", 33))
    sums = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "_part").withColumn("rank", F.col("_before") + within).drop("_at", "_part", "_before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n).

    Weights repeat along the sources in order. A target stops at ``most`` times the size of its source; what is over is
    shared again by weight among the others, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked(sizes, "source").select("source", "source_size", "n", weight.alias("w"))
    table = materialize(table, "weights")
    limit = most * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, -1  # words for a weight of one; those whose limit is reached by it are full
    while True:
        full = limit <= share * F.col("w")
        row = table.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w")))
        ).first()
        if row[0] == before:
            break
        before = row[0]
        share = (total - (row[1] or 0)) / row[2] if row[2] else share
    target = F.when(limit <= share * F.col("w"), limit.cast("double")).otherwise(share * F.col("w"))
    return table.select("source", "source_size", "n", target.alias("target"))


def _chance(*parts: object) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)), SEED) / 2.0**64


def _rounding(last: bool):
    """Work off the rows (source, chunk, id, tie, size, mass) of each chunk in order: adds ``up``, null if undecided."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None  # held: a row and its words so far, as yet undecided
        step = 0
        names = ["source", "chunk", "id", "tie", "size", "mass"]
        out: list[tuple] = []

        def close() -> None:
            nonlocal held
            if held is not None:
                row, mass = held
                out.append((*row, mass, (_chance("last", *row[:4]) * row[4] < mass) if last else None))
                held = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*names, "up"])

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                *row, mass = row
                row = tuple(row)
                if row[:2] != group:
                    close()
                    group, step = row[:2], 0
                if held is None:
                    held = (row, mass)
                    continue
                first, moved = held
                step += 1
                a, b = first[4], row[4]
                gain = min(a - moved, mass)  # what the first can take over, or give
                loss = min(moved, b - mass)
                if _chance(step, *first[:4], *row[2:4]) * (gain + loss) < loss:
                    first_done, second_done = gain == a - moved, gain == mass
                    moved, mass = (float(a) if first_done else moved + gain), (0.0 if second_done else mass - gain)
                else:
                    first_done, second_done = loss == moved, loss == b - mass
                    moved, mass = (0.0 if first_done else moved - loss), (float(b) if second_done else mass + loss)
                held = None
                for done, (r, m) in ((first_done, (first, moved)), (second_done, (row, mass))):
                    if done:
                        out.append((*r, m, m > 0))
                    else:
                        held = (r, m)
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    return work


_ROUNDED = "source string, chunk long, id long, tie long, size long, mass double, up boolean"


def _round(rows: DataFrame, last: bool, label: str) -> DataFrame:
    """One level of the tree. Each row leaves its chunk decided, but for one row of each chunk unless it is the last level."""
    dealt = rows.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "id", "tie", "size")
    return materialize(dealt.mapInArrow(_rounding(last), _ROUNDED), label)


def decide(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, copies) for every row: how often the mix takes it."""
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(text_col).alias("tie"),
            size_of(F.col(text_col)).alias("size"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = materialize(targets(sizes, weights, most), "mix-targets").withColumnRenamed("source", "_source")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(factor + 1e-12)
    part = F.when(factor - base > 1e-12, factor - base).otherwise(0.0)
    # The first level of the tree: chunks of a source by a hash of the row.
    chunks = F.ceil(F.col("n") / CHUNK)
    rows = rows.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "tie", "size", "source_size", "target", base.alias("base"),
        (part * F.col("size")).alias("mass"),
        F.pmod(F.xxhash64("id", "tie"), chunks).alias("chunk"),
    )
    open_ = rows.where("mass > 0")
    most_chunks = wanted.agg(F.max(F.ceil(F.col("n") / CHUNK))).first()[0] or 1
    level = _round(open_.select("source", "chunk", "id", "tie", "size", "mass"), most_chunks == 1, "mix-level")
    first, upper = level, None
    while most_chunks > 1:
        most_chunks = -(-most_chunks // FAN)
        left = level.where("up IS NULL").drop("up").withColumn("chunk", F.floor(F.col("chunk") / FAN))
        level = _round(left, most_chunks == 1, "mix-level")
        settled = level.where("up IS NOT NULL")
        upper = settled if upper is None else upper.union(settled)
    up = first.where("up IS NOT NULL").select("id", "source", "tie", "size", "up")
    if upper is not None:
        up = up.union(upper.select("id", "source", "tie", "size", "up"))
    # Rows alike in all of this are interchangeable: they share the number of those that are taken once more.
    key = ["id", "source", "tie", "size"]
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}")) for c in key]
    up = up.groupBy(*key).agg(F.sum(F.col("up").cast("long")).alias("more"), F.count("*").alias("alike"))
    joined = rows.alias("r").join(up.alias("u"), same[0] & same[1] & same[2] & same[3], "left")
    single = joined.where("alike IS NULL OR alike = 1")
    nth = F.row_number().over(Window.partitionBy(*[F.col(f"r.{c}") for c in key]).orderBy(F.lit(1)))
    repeated = joined.where("alike > 1").withColumn("more", (nth <= F.col("more")).cast("long"))
    found = ["r.id", "r.source", F.col("r.tie").alias("text_hash"), "r.size", "source_size", "target",
             (F.col("base") + F.coalesce("more", F.lit(0))).alias("copies")]
    return single.select(*found).union(repeated.select(*found))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy`` from 1 on beside its columns.

    Rows alike in id, source and text are told apart by a hash of all their columns (but for maps), so each stays itself.
    """
    taken = decide(docs, id_col, source_col, text_col, **options)
    # Rows alike are taken equally often, some of them once more.
    least, alike = F.min("copies"), F.count("*")
    taken = taken.groupBy("id", "source", "text_hash").agg(
        least.alias("least"), alike.alias("alike"), (F.sum("copies") - least * alike).alias("more")
    )
    names = [fresh(docs, c) for c in ("_id", "_source", "_hash", "_least", "_alike", "_more", "_nth")]
    id_name, source_name, hash_name, least_name, alike_name, more_name, nth_name = names
    found = [F.col(c).alias(n) for c, n in zip(("id", "source", "text_hash", "least", "alike", "more"), names)]
    taken = materialize(taken.select(*found), "mix-taken").where((F.col(least_name) > 0) | (F.col(more_name) > 0))
    same = (
        F.col(id_col).cast("long").eqNullSafe(F.col(id_name))
        & F.col(source_col).cast("string").eqNullSafe(F.col(source_name))
        & (F.xxhash64(text_col) == F.col(hash_name))
    )
    joined = docs.join(taken, same)
    own = columns(docs)
    single = joined.where(F.col(alike_name) == 1).select(*own, F.col(least_name).alias(nth_name))
    hashed = [c for c, f in zip(own, docs.schema) if "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy(id_name, source_name, hash_name).orderBy(F.xxhash64(*hashed)))
    each = joined.where(F.col(alike_name) > 1).withColumn(nth_name, nth)
    copies = F.col(least_name) + (F.col(nth_name) <= F.col(more_name)).cast("long")
    both = single.union(each.select(*own, copies.alias(nth_name)).where(F.col(nth_name) > 0))
    return both.select(*own, F.explode(F.sequence(F.lit(1), F.col(nth_name).cast("int"))).alias(fresh(docs, "copy")))
