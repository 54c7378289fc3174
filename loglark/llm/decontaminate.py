"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Words of a text stream through the automaton, which yields at each word the longest run ending there that occurs in some
item. A run of at least ``WINDOW`` words (or a whole item, if the item is shorter) is a hit, and its words are marked.

Items are cut into blocks of about ``BLOCK_WORDS`` words by a hash. A task builds the automaton of a block, and only one
block at a time passes the driver and is broadcast, so its size is bounded; texts then pass one block after the other in the
same task. Texts are not shuffled, so no key can be hot, and each text is processed on its own, whole.

Null texts have no words. Items without words are ignored, repeated items count once, an item with a null id marks words but
is not listed. Empty tables give empty marks. Only the text column is read, so other columns may have any names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loglark.llm.text import columns, fresh, utf8, with_value
from loglark.session import materialize

WINDOW = 13
#: Words of items in one automaton. It holds at most twice as many states and three times as many transitions.
BLOCK_WORDS = 200_000
#: A text is contaminated if at least one word in so many is hit.
ONE_IN = 20

_LETTERS = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_WORD_BYTES = bytes((c if c in _LETTERS else 0x20) for c in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
MARKS = StructType(
    [StructField("n_words", IntegerType()), StructField("spans", SPANS), StructField("items", ArrayType(StringType()))]
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: letters and digits of ASCII, and everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        step: list[dict[int, int]] = [{}]
        read = []
        for item, tokens in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]
            if ids:
                read.append((item, ids))
                last = 0
                for token in ids:
                    last = self._extend(step, last, token)
        self.size = max(1, len(self.vocabulary))
        self.step = {s * self.size + t: to for s, out in enumerate(step) for t, to in out.items()}
        # In the order of length a link comes before the states that have it.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.at_window = [-1] * len(order)  # the state of the last ``window`` words, for states as long as that
        for s in order:
            if self.length[s] >= window:
                above = self.link[s]
                self.at_window[s] = s if self.length[above] < window else self.at_window[above]
        self.items: dict[int, set[str | None]] = {}  # by the state of a window
        whole = [False] * len(order)  # states of whole items that are shorter than a window
        for item, ids in read:
            state = 0
            for i, token in enumerate(ids):
                state = self.step[state * self.size + token]
                if i + 1 >= window:
                    self.items.setdefault(self.at_window[state], set()).add(item)
            if len(ids) < window:
                whole[state] = True
                self.items.setdefault(state, set()).add(item)
        self.whole = whole
        self.above = [-1] * len(order)  # the nearest whole item among the links
        for s in order[1:]:
            link = self.link[s]
            self.above[s] = link if whole[link] else self.above[link]
        self.shortest = min([min(window, len(ids)) for _, ids in read], default=window)

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        found = cls.__new__(cls)
        vars(found).update(pickle.loads(data))
        return found

    def _extend(self, step: list[dict[int, int]], last: int, token: int) -> int:
        def split(parent: int, state: int) -> int:
            clone = len(self.length)
            self.length.append(self.length[parent] + 1)
            self.link.append(self.link[state])
            step.append(dict(step[state]))
            self.link[state] = clone
            while parent >= 0 and step[parent].get(token) == state:
                step[parent][token] = clone
                parent = self.link[parent]
            return clone

        if token in step[last]:  # another item has this run already
            state = step[last][token]
            return state if self.length[state] == self.length[last] + 1 else split(last, state)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        step.append({})
        parent = last
        while parent >= 0 and token not in step[parent]:
            step[parent][token] = new
            parent = self.link[parent]
        if parent >= 0:
            state = step[parent][token]
            self.link[new] = state if self.length[state] == self.length[parent] + 1 else split(parent, state)
        return new

    def marks(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Number of words, spans [start, stop) of hit words in order, and the items whose windows occur."""
        tokens = words(text)
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        if len(tokens) >= self.shortest:
            ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
            edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if stop - start >= self.shortest:  # a word that no item has ends every run
                    self._stream(start, ids[start:stop].tolist(), spans, states)
        merged: list[tuple[int, int]] = []
        for start, stop in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((start, stop))
        return len(tokens), merged, set().union(*(self.items[s] for s in states)) if states else set()

    def _stream(self, at: int, ids: list[int], spans: list[tuple[int, int]], states: set[int]) -> None:
        step, size, length, link, window = self.step, self.size, self.length, self.link, self.window
        state = run = 0
        for i, token in enumerate(ids, at + 1):
            to = step.get(state * size + token)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = step.get(state * size + token)
            if to is None:
                continue
            state, run = to, run + 1
            widest = 0
            if run >= window:
                states.add(self.at_window[state])
                widest = window
            short = state if self.whole[state] and run == length[state] else self.above[state]
            while short > 0:
                states.add(short)
                widest = max(widest, length[short])
                short = self.above[short]
            if widest:
                spans.append((i - widest, i))


def _automata(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[bytes]:
    """One pickled automaton for each block of items; none for a table without items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(F.col(text_col)).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0  # a word and its gap take two bytes at least
    blocks = max(1, -(-int(total) // block_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for b, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block and held:
                    yield pa.RecordBatch.from_pydict({"automaton": [Automaton(held).packed()]})
                    held = []
                block = b
                held.append((item, words(text)))
        if held:
            yield pa.RecordBatch.from_pydict({"automaton": [Automaton(held).packed()]})

    dealt = items.select(F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block"), "item", "text")
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block")
    built = materialize(dealt.mapInArrow(build, "automaton binary"), "automata")
    return [row.automaton for row in built.toLocalIterator()]


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> Column:
    """A column (n_words, spans, items) for ``docs``: word spans [start, stop) that are hit, and the items they are from."""
    spark = docs.sparkSession
    found = []
    for pickled in _automata(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(pickled)

        @F.arrow_udf(MARKS)
        def mark(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = Automaton.unpacked(shared.value)
            for texts in parts:
                rows = [automaton.marks(t.as_py()) for t in texts]
                yield pa.array(
                    [
                        {
                            "n_words": n,
                            "spans": [{"start": a, "stop": b} for a, b in spans],
                            "items": sorted(i for i in items if i is not None),
                        }
                        for n, spans, items in rows
                    ],
                    pa.struct(
                        [
                            ("n_words", pa.int32()),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                            ("items", pa.list_(pa.string())),
                        ]
                    ),
                )

        found.append(mark(utf8(F.col(text_col))))
    if not found:
        count = F.regexp_count(F.lower(text_col), F.lit(_WORD.pattern))
        return F.struct(
            F.coalesce(count, F.lit(0)).alias("n_words"),
            F.array().cast(SPANS).alias("spans"),
            F.array().cast("array<string>").alias("items"),
        )
    if len(found) == 1:
        return found[0]
    return F.struct(
        found[0].getField("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.array(*[c.getField("spans") for c in found]))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[c.getField("items") for c in found])))).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span.getField("stop") - F.greatest(span.getField("start"), acc.getField("reach")))
        return F.struct(
            F.greatest(acc.getField("reach"), span.getField("stop")).alias("reach"),
            (acc.getField("n") + fresh).alias("n"),
        )

    return F.aggregate(spans, start, add, lambda acc: acc.getField("n"))


def is_contaminated(n_words: Column, n_hit: Column, one_in: int = ONE_IN) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "_marks", **options) -> DataFrame:
    """``docs`` with ``name`` (n_words, n_hit, spans, items, contaminated) beside its columns."""
    found = fresh(docs, "_found")
    marks = with_value(docs, found, marked(docs, benchmark, text_col, **options))
    hit = hit_words(F.col(f"{found}.spans"))
    n = F.col(f"{found}.n_words").cast("long")
    return marks.select(
        *columns(docs),
        F.struct(
            n.alias("n_words"),
            hit.alias("n_hit"),
            F.col(f"{found}.spans").alias("spans"),
            F.col(f"{found}.items").alias("items"),
            is_contaminated(n, hit).alias("contaminated"),
        ).alias(name),
    )


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text and cuts:
            at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
            kept, done = [], 0
            for span in cuts:
                kept.append(text[done : at[span["start"]][0]])
                done = max(done, at[span["stop"] - 1][1])
            text = "".join(kept) + text[done:]
        out.append(text)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", longest: int = WINDOW - 1, one_in: int = ONE_IN,
          **options) -> DataFrame:
    """``docs`` with ``clean_text``: hit spans of more than ``longest`` words are cut out, and all hit spans where together
    they reach the coverage limit of one word in ``one_in``. A null text stays null."""
    name = fresh(docs, "_marks")
    marks = report(docs, benchmark, text_col, name, **options)
    over = is_contaminated(F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"), one_in)
    long_ones = F.filter(f"{name}.spans", lambda s: s.getField("stop") - s.getField("start") > longest)
    spans = F.when(over, F.col(f"{name}.spans")).otherwise(long_ones)
    return marks.select(*columns(docs), _cut(F.col(text_col), spans).alias("clean_text"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that are not contaminated, with their columns unchanged."""
    name = fresh(docs, "_marks")
    marks = report(docs, benchmark, text_col, name, **options)
    return marks.where(~F.col(f"{name}.contaminated")).select(*columns(docs))
