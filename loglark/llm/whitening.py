"""Whitening of embeddings: unit variance along the leading principal components.

Entries are brought to whole numbers, ``floor(64 c) + 1000000``, and every distinct vector is fitted once. The distinct vectors are
written to the shared folder and read twice: for the number of vectors and the exact sums of their entries, and for the products of
entries. Those are centred first, at the whole number next to the mean, so that all sums of a task are exact as long as they are
below 2^53; what the mean differs from that number by is taken off at the end. Each task sends one row for each pair of dimensions,
so what travels and what the driver gets is bounded by the dimensions, not by the rows. The eigenvectors come from spectrum
slicing, see ``spectrum``. A third pass over the fit list measures how far the covariance of the whitened vectors is from one.

A row whose vector is null, empty, or holds null or non-finite entries is left out, and so is one that has not the most frequent
length (ties: the longest). Repeated rows, and rows with null ids, are rows each and get equal values. Components whose eigenvalue is
zero at double precision cannot be whitened and are not given, so a table with one distinct vector, or none, gives no rows. Entries
beyond 2^32 are an error. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglark.llm import spectrum
from loglark.session import materialize

#: Fixed values of the rounding.
STEPS, SHIFT = 64, 1_000_000
LARGEST = float(1 << 32)
COMPONENTS = 16
#: Rows of a batch that are multiplied at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: its size, the sums of its entries, the leading eigenvalues and their vectors as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the rows whose vectors can be used, entries as whole numbers."""
    c = F.col(f"`{vector}`")
    entries = F.transform(c, lambda e: e.cast("double"))
    usable = F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0)).where(usable)
    fits = F.forall(entries, lambda e: F.abs(e) < LARGEST)
    x = F.when(fits, F.transform(entries, lambda e: F.floor(e * STEPS) + SHIFT)).otherwise(
        F.raise_error(F.lit("an entry of a vector is too large for whitening"))
    )
    found = rows.select(F.col(f"`{vec_id}`").alias("id"), x.alias("x"))
    lengths = rows.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("k"))
    usual = lengths.agg(F.max_by("d", F.struct("k", "d"))).first()[0]
    return found.where(F.size("x") == F.lit(usual))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, d)


def _upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """(i, s, n) of one task: the sum of each entry, exact in 64 bits."""
    n, total = 0, np.zeros(d, np.int64)
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        n, total = n + len(x), total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict({"i": np.arange(d), "s": total, "n": np.full(d, n)})


def _products(batches: Iterator[pa.RecordBatch], d: int, centre: np.ndarray, to: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(i, j, g) of one task for i <= j: sums of products of the centred vectors, or of what ``to`` makes of them; i of -1: sums."""
    width = d if to is None else to.shape[1]
    products, sums, any_row = np.zeros((width, width)), np.zeros(width), False
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        for begin in range(0, len(x), ROWS):
            y = (x[begin : begin + ROWS] - centre[0]).astype(float)
            y = y if to is None else (y - centre[1]) @ to
            products += y.T @ y
            sums += y.sum(axis=0)
            any_row = True
    if any_row:
        i, j = _upper(width)
        yield pa.RecordBatch.from_pydict({
            "i": np.concatenate([i, np.full(width, -1)]), "j": np.concatenate([j, np.arange(width)]),
            "g": np.concatenate([products[i, j], sums]),
        })


def _covariance(fit: DataFrame, n: int, d: int, centre: np.ndarray, to: np.ndarray | None) -> np.ndarray:
    """The covariance of the fit list, or of its whitened vectors. The driver gets a row for each pair of dimensions."""
    products = _products
    width = d if to is None else to.shape[1]
    rows = fit.mapInArrow(lambda batches: products(batches, d, centre, to), "i long, j long, g double")
    found = rows.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out, mean = np.zeros((width, width)), np.zeros(width)
    own = found["i"] < 0
    mean[found["j"][own]] = found["g"][own] / n
    pairs = found[~own]
    out[pairs["i"], pairs["j"]] = pairs["g"] / n
    out[pairs["j"], pairs["i"]] = pairs["g"] / n
    return out - np.outer(mean, mean)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``x`` of ``rows``; None if there are none."""
    distinct = materialize(rows.select("x").distinct(), "vectors")
    first = distinct.first()
    if first is None:
        return None
    d, sums = len(first["x"]), _sums
    found = distinct.mapInArrow(lambda batches: sums(batches, d), "i long, s long, n long")
    by_entry = found.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, total = by_entry[0]["n"], np.array([r["s"] for r in by_entry])
    whole = np.array([round(int(s) / n) for s in total])
    part = np.array([int(s) - n * int(c) for s, c in zip(total, whole)]) / n
    centre = (whole, part)
    covariance = _covariance(distinct, n, d, centre, None)
    values, vectors = spectrum.leading(covariance, components)
    error = 0.0
    if len(values):
        made = _covariance(distinct, n, d, centre, vectors / np.sqrt(values))
        error = float(np.abs(made - np.eye(len(values))).max())
    return Whitening(n, total, values, vectors, float(np.trace(covariance)), error)


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = sums // n
    part = (sums - n * whole) / n
    for batch in batches:
        x = _matrix(batch.column("x"), len(sums))
        y = ((x - whole).astype(float) - part) @ to
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * to.shape[1]), pa.array(y.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), lists], names=["id", "x", "whitened"])


def deviation(x: Column, n: int, sums: np.ndarray) -> Column:
    """The sum over dimensions of (n x - sum)², exact: a decimal, as it may be larger than a long."""
    total = F.array(*(F.lit(int(s)).cast("long") for s in sums))

    def add(so_far: Column, off: Column) -> Column:
        one = off.cast("decimal(19,0)")
        return (so_far + one * one).cast("decimal(38,0)")

    offs = F.zip_with(x, total, lambda a, s: F.lit(n).cast("long") * a - s)
    return F.aggregate(offs, F.lit(0).cast("decimal(38,0)"), add)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): for each row its entries along the components."""
    project, n, sums, to = _project, model.n, model.sums, model.vectors / np.sqrt(model.values)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, x array<long>, whitened array<double>"
    made = rows.mapInArrow(lambda batches: project(batches, n, sums, to), schema)
    return made.select("id", deviation(F.col("x"), n, sums).alias("deviation"), "whitened")
