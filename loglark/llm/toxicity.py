"""Toxic texts by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of bytes in the text, lower-cased and with white space as one blank. How many
toxic and other training texts have each feature is counted; the log of the ratio of the two smoothed shares scales the
feature. Of the hashed features, those whose counts differ most beyond chance get a weight by logistic regression.

The model is fitted on bounded samples of the labelled training texts, drawn by a hash of the id: the ratios on ``SAMPLE`` on
average, the weights on ``WEIGHED`` of these. The ids drawn are broadcast, so no text is shuffled. Texts are read whole, in
pieces, so memory does not grow with their length. Counts are packed in each task and added up block by block, so a task holds
one block at a time; at the driver arrive the ``BUCKETS`` counts and the chosen features of the smaller sample.

A null or empty text has no features and gets the score of the intercept. Rows with a null label or id do not train; labels
of a repeated id are averaged. Repeated rows and extra columns stay. Without training rows of both classes every score is
the share of toxic training rows (0 if there are none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loglark.llm.text import columns, fold_of, fresh, utf8, with_value
from loglark.session import materialize

#: Lengths of n-grams in bytes; up to eight fit in one word.
ORDERS = (4, 5, 6, 7, 8)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Features that get a weight, at most.
FEATURES = 1 << 11
#: Labelled texts that the ratios are counted on, on average.
SAMPLE = 40_000
#: Those among them that the weights are fitted on, on average.
WEIGHED = 12_000
FOLDS = 5
_BLOCKS = 256
_PIECE = 1 << 18


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in pieces, as often as they occur."""
    line = b" " + b" ".join(text.lower().split()) + b" "
    for at in range(0, len(line), _PIECE):
        codes = np.frombuffer(line, np.uint8, min(len(line) - at, _PIECE + max(ORDERS) - 1), at).astype(np.uint64)
        key = codes
        for n in range(2, min(max(ORDERS), len(codes)) + 1):
            key = key[: len(codes) - n + 1] | codes[n - 1 :] << np.uint64(8 * (n - 1))
            if n in ORDERS:
                mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                mixed *= np.uint64(0xBF58476D1CE4E5B9)
                yield mixed >> np.uint64(64 - BUCKET_BITS)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The buckets that occur, in order. ``seen`` is BUCKETS flags, all off before and after."""
    for found in ngrams(text):
        seen[found] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """Weights of the buckets (0 for most), and the intercept."""

    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.used = self.weights != 0

    def score(self, text: bytes) -> float:
        parts = [found[self.used[found]] for found in ngrams(text)]
        found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(), -500, 500))))


def log_count_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, alpha: float = 1.0) -> np.ndarray:
    """Log of the ratio of the smoothed shares of toxic and other texts that have a feature."""
    return np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))


def select(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, most: int = FEATURES) -> np.ndarray:
    """The ``most`` buckets whose shares differ most in units of their standard error."""
    p, q = (pos + 1) / (n_pos + 2), (neg + 1) / (n_neg + 2)
    both = (pos + neg + 1) / (n_pos + n_neg + 2)
    z = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    z[(pos + neg) < 3] = 0
    return np.sort(np.argsort(-z, kind="stable")[:most])


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, chosen: np.ndarray, l2: float = 10.0,
        steps: int = 120) -> Model:
    """Logistic regression on the chosen buckets, scaled by their ratios. ``rows`` holds the buckets of each text."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    columns = [place[r] for r in rows]
    columns = [c[c >= 0] for c in columns]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    column = np.concatenate(columns) if columns else np.zeros(0, int)
    scale = ratio[chosen]
    if not len(rows):
        return Model(np.zeros(BUCKETS), 0.0)
    w, b = np.zeros(len(chosen)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    value = scale[column]
    # Adam on the full sample; the steps shrink, so the end does not depend on where it stops.
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[column] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.append(
            np.bincount(column, error[owner] * value, len(chosen)) / len(rows) + l2 * w / len(rows), error.mean()
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(BUCKETS)
    weights[chosen] = w * scale
    return Model(weights, b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, label, sampled): the sampled texts (block -1), how many texts there are of each label (block -2), and the
    counts of this task in blocks of buckets."""
    counts = np.zeros((2, BUCKETS), np.int64)
    number = np.zeros(2, np.int64)
    seen = np.zeros(BUCKETS, bool)
    for batch in batches:
        texts = []
        for text, label, sampled in zip(*(c.to_pylist() for c in batch.columns)):
            counts[label, features(text, seen)] += 1
            number[label] += 1
            if sampled:
                texts.append((text, label))
        if texts:
            text, label = zip(*texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(text), pa.int32()), pa.array(text, pa.binary()), pa.array(label, pa.int32())],
                names=["block", "data", "label"],
            )
    if number.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2] * 2, pa.int32()), pa.array([n.tobytes() for n in number], pa.binary()), pa.array([0, 1], pa.int32())],
            names=["block", "data", "label"],
        )
        parts = counts.reshape(2, _BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(_BLOCKS), 2), pa.int32()),
                pa.array([parts[k, b].tobytes() for b in range(_BLOCKS) for k in (0, 1)], pa.binary()),
                pa.array([0, 1] * _BLOCKS, pa.int32()),
            ],
            names=["block", "data", "label"],
        )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each (block, label), which come sorted."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([key[1]], pa.int32())],
            names=["block", "data", "label"],
        )

    for batch in batches:
        for block, data, label in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, label) != key:
                if key is not None:
                    yield row()
                key, total = (block, label), np.zeros(len(data) // 8, np.int64)
            total += np.frombuffer(data, np.int64)
    if key is not None:
        yield row()


_PACKED = "block int, data binary, label int"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = FOLDS, sample: int = SAMPLE, weighed: int = WEIGHED) -> Model:
    """The model from the labelled texts outside fold 0. Labels without a text are neither drawn nor counted."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col), folds) != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    known = materialize(known, "toxic-labels")
    every = max(1, known.count())
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = known.where(draw < int(min(1.0, sample / every) * (1 << 30)))
    drawn = draw < int(min(1.0, weighed / every) * (1 << 30))
    texts = docs.select(F.col(id_col).alias("_id"), utf8(F.col(text_col)).alias("_text"))
    texts = texts.where(fold_of(F.col("_id"), folds) != 0).join(F.broadcast(known), "_id")  # ``sample`` ids
    counted = texts.select("_text", "_label", drawn.alias("_drawn")).mapInArrow(_count, _PACKED)
    counted = materialize(counted, "toxic-counts")
    added = counted.where("block <> -1").repartition("block").sortWithinPartitions("block", "label").mapInArrow(_add, _PACKED)
    counts = np.zeros((2, BUCKETS), np.int64)
    width = BUCKETS // _BLOCKS
    number = [0, 0]
    for row in added.collect():  # BUCKETS counts of each label, and how many texts it has
        if row.block < 0:
            number[row.label] = int(np.frombuffer(row.data, np.int64)[0])
            continue
        counts[row.label, row.block * width : (row.block + 1) * width] = np.frombuffer(row.data, np.int64)
    n_neg, n_pos = number
    if not n_neg or not n_pos:  # nothing to tell apart
        return Model(np.zeros(BUCKETS), 500.0 if n_pos else -500.0)
    chosen = select(counts[1], counts[0], n_pos, n_neg)
    used = np.zeros(BUCKETS, bool)
    used[chosen] = True

    def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            found = [features(t, seen) for t in batch.column("data").to_pylist()]
            packed = [f[used[f]].astype(np.int32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("label")], names=["data", "label"])

    rows = counted.where("block = -1").mapInArrow(chosen_only, "data binary, label int").collect()
    rows.sort(key=lambda r: (r.label, r.data))  # the same order in every run, so the same sums
    found = [np.frombuffer(r.data, np.int32) for r in rows]
    return fit(found, np.array([r.label for r in rows], float), log_count_ratio(counts[1], counts[0], n_pos, n_neg), chosen)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The probability of the label 1 as a column of ``docs``."""
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.intercept))  # FEATURES values

    @F.arrow_udf(DoubleType())
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        used, values, intercept = shared.value
        weights = np.zeros(BUCKETS)
        weights[used] = values
        own = Model(weights, intercept)
        for texts in parts:
            yield pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return scores(utf8(F.col(text_col)))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", below: float = 0.5,
               model: Model | None = None) -> DataFrame:
    """The rows whose score is under ``below``, with their columns unchanged."""
    model = train(docs, labels, id_col, text_col) if model is None else model
    name = fresh(docs, "_score")
    scored = with_value(docs, name, score(docs, model, text_col))
    return scored.where(F.col(name) < below).select(*columns(docs))
