"""Text quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers that do not depend on its language (shares of capitals, symbols and repetitions, lengths). Each
number is cut into bins; cyclic boosting visits the features in turn and adds a shallow tree over the bins of that one
feature, then does the same for the pairs of features that still explain most of the error. The trees of a feature add up to
one lookup table, so a score is the sum of one entry for each feature and pair.

The model is fitted on the numbers of a bounded sample of the training texts (``SAMPLE`` on average, drawn by a hash of the
id; the ids drawn are broadcast) and its tables, of fixed size, travel to the tasks. Texts are not shuffled; memory for one
text is a few times its length.

A null or empty text has all numbers zero and gets the score of those. Rows with a null label or id do not train; labels of
a repeated id are averaged. Repeated rows and extra columns stay. Without training rows every score is 0.5. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from loglark.llm.text import columns, fold_of, fresh, utf8, with_value
from loglark.session import materialize

#: Training rows that the tables are fitted on, on average.
SAMPLE = 40_000
FOLDS = 5
BINS = 48
PAIR_BINS = 12
PAIRS = 8

FEATURES = (
    "words", "bytes_per_word", "capitals", "digits", "symbols", "full_stops", "beyond_ascii", "distinct", "most_common",
    "same_as_last", "lines", "repeated_lines", "words_with_symbol", "bare_symbols", "all_capitals", "longest_word",
)
_CLASS = np.zeros(256, np.int8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = 3
_CLASS[[ord(c) for c in ".?;:"]] = 4
_CLASS[128:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def numbers(text: bytes) -> list[float]:
    """The values of FEATURES."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n = len(tokens)
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    kind = np.bincount(kinds, minlength=7)
    size = max(1, len(text) - kind[6])
    gap = kinds == 6
    ends = (kinds == 3) & np.append(gap[1:], True)
    counts = Counter(tokens)
    lines = [line for line in text.split(b"\n") if line]
    return [
        float(np.log(n)),
        size / n,
        kind[1] / size,
        kind[2] / size,
        kind[3] / size,
        kind[4] / n,
        kind[5] / size,
        len(counts) / n**0.85,
        max(counts.values()) / n,
        sum(map(eq, tokens, tokens[1:])) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        int(ends.sum()) / n,
        int((ends & np.append(True, gap[:-1])).sum()) / n,
        sum(map(bytes.isupper, tokens)) / n,
        float(np.log(max(map(len, tokens)))),
    ]


@dataclass
class Model:
    """Bin edges of each feature, its table, and for each pair (i, j): coarser edges of both and a table."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, i], "right")]
        for i, j, left, right, table in self.pairs:
            z += table[np.searchsorted(left, x[:, i], "right"), np.searchsorted(right, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Newton steps for each bin from a tree of ``depth`` splits along the bins, given sums of gradients and curvatures."""
    out = np.full(len(g), -g.sum() / (h.sum() + l2))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h, l2) + _gain(g.sum() - left_g, h.sum() - left_h, l2) - _gain(g.sum(), h.sum(), l2)
        at = int(np.argmax(gain))
        if gain[at] > 1e-9:
            out[: at + 1] = _tree(g[: at + 1], h[: at + 1], depth - 1, l2)
            out[at + 1 :] = _tree(g[at + 1 :], h[at + 1 :], depth - 1, l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Like _tree for a grid: one split along the first feature, then one along the second on either side."""
    best, out = -1.0, np.full(g.shape, -g.sum() / (h.sum() + l2))
    for cut in range(1, len(g)):
        step, total = np.empty_like(g), 0.0
        for side in (slice(0, cut), slice(cut, None)):
            row_g, row_h = g[side].sum(0), h[side].sum(0)
            values = _tree(row_g, row_h, 1, l2)
            step[side] = values
            total += -(row_g * values).sum() - 0.5 * ((row_h + l2 / len(row_h)) * values**2).sum()
        if total > best:
            best, out = total, step
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, pair_rounds: int = 40, l2: float = 2.0) -> Model:
    """Cyclic boosting of one table for each feature, then of tables for the PAIRS pairs that reduce the error most."""
    edges = [_edges(x[:, i], BINS) for i in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return Model(edges, tables, [], 0.0)
    intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    bins = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    z = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(bins):
            g, h = slopes()
            n = len(tables[i])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), 2, l2)
            tables[i] += step
            z += step[b]
    coarse = [_edges(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    places = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(coarse)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = places[i] * shape[1] + places[j]
        g, h = slopes()
        n = shape[0] * shape[1]
        return cell, np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)

    def worth(pair: tuple[int, int]) -> float:
        _, g, h = grids(*pair)
        step = _pair_tree(g, h, l2)
        return float((g * step).sum() + 0.5 * (h * step**2).sum())

    every = [(i, j) for i in range(x.shape[1]) for j in range(i) if len(coarse[i]) and len(coarse[j])]
    chosen = sorted(every, key=worth)[:PAIRS]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            cell, g, h = grids(*p)
            step = rate * _pair_tree(g, h, l2)
            pair_tables[p] += step
            z += step.ravel()[cell]
    return Model(edges, tables, [(i, j, coarse[i], coarse[j], pair_tables[i, j]) for i, j in chosen], intercept)


@F.arrow_udf(ArrayType(FloatType()))
def _numbers(texts: pa.Array) -> pa.Array:
    flat = np.array([v for t in texts for v in numbers(t.as_py())], np.float32)
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()))


def measured(text: Column) -> Column:
    """The numbers of a text as an array."""
    return _numbers(utf8(text))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """The model from the labelled texts outside fold 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col), folds) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = materialize(known, "quality-labels")
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(fold_of(F.col("_id"), folds) != 0)
    drawn = texts.join(F.broadcast(known), "_id")  # ``sample`` ids, so no text is shuffled
    found = drawn.select("_id", "_label", measured(F.col("_text")).alias("numbers")).orderBy("_id", "numbers")
    found = found.select("numbers", "_label").collect()  # ``sample`` rows of a few numbers
    x = np.array([r[0] for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability of the label 1 as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # tables of fixed size

    @F.arrow_udf(DoubleType())
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for texts in parts:
            x = np.array([numbers(t.as_py()) for t in texts], np.float32).astype(np.float64)
            yield pa.array(own.score(x.reshape(-1, len(FEATURES))), pa.float64())

    return scores(utf8(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3,
              model: Model | None = None) -> DataFrame:
    """The rows whose score is ``least`` or more, with their columns unchanged."""
    model = train(docs, labels, id_col, text_col) if model is None else model
    name = fresh(docs, "_score")
    scored = with_value(docs, name, score(docs, model, text_col))
    return scored.where(F.col(name) >= least).select(*columns(docs))
