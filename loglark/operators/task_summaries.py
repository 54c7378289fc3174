"""Heavy-hitter summaries of the rows of one task. This module runs in the Python workers, see ``loglark``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SS_ARROW = pa.schema(
    [
        ("dim", pa.string()),
        ("rank", pa.int32()),
        ("key", pa.string()),
        ("n", pa.int64()),
        ("err", pa.int64()),
        ("floor", pa.int64()),
    ]
)


def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Weights of each Arrow batch summed per (dim, key), in order of first appearance."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield table.group_by(["dim", "key"], use_threads=False).aggregate([("w", "sum")])


def _cut(counters: pa.Table, capacity: int) -> pa.Table:
    """Take the (capacity+1)-th largest counter off all counters and keep the positive ones."""
    if counters.num_rows <= capacity:
        return counters
    n = counters["w"].to_numpy()
    left = n - np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1]
    keep = left > 0
    kept = counters.filter(pa.array(keep))
    return kept.set_column(kept.schema.get_field_index("w"), "w", pa.array(left[keep]))


class MisraGries:
    """One summary while its batches arrive."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.held: pa.Table | None = None

    def add(self, keys: pa.ChunkedArray, weights: pa.ChunkedArray) -> None:
        own = pa.table({"key": keys, "w": weights})
        if self.held is not None:
            both = pa.concat_tables([self.held, own]).group_by("key", use_threads=False)
            own = both.aggregate([("w", "sum")]).rename_columns({"w_sum": "w"})
        self.held = _cut(own, self.capacity)

    def rows(self, dim: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim] * self.held.num_rows, pa.string()),
                self.held["key"].combine_chunks(),
                self.held["w"].combine_chunks(),
            ],
            names=["dim", "key", "n"],
        )


class SpaceSaving:
    """One summary while its batches arrive.

    A batch sum is a summary without error, so a batch is merged in like any other: counts above the floor are added up,
    the largest ``capacity`` stay (ties: the smaller key), and the floor rises by the first one cut off.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.floor = 0
        self.held: pa.Table | None = None  # key, over (count less floor), err (error less floor)

    def add(self, keys: pa.ChunkedArray, weights: pa.ChunkedArray) -> None:
        self._merge(pa.table({"key": keys, "over": weights, "err": pa.array(np.zeros(len(keys), np.int64))}))

    def add_summaries(self, rows: pa.Table) -> None:
        """Rows of other summaries. The row of rank 1 of each brings its floor, which all keys that it lacks get."""
        self.floor += pc.sum(rows.filter(pc.equal(rows["rank"], 1))["floor"]).as_py() or 0
        over = {c: pc.subtract(rows[n], rows["floor"]) for c, n in (("over", "n"), ("err", "err"))}
        summed = pa.table({"key": rows["key"], **over}).group_by("key", use_threads=False).aggregate([("over", "sum"), ("err", "sum")])
        self._merge(summed.rename_columns({"over_sum": "over", "err_sum": "err"}))

    def _merge(self, own: pa.Table) -> None:
        if self.held is not None:
            both = pa.concat_tables([self.held, own]).group_by("key", use_threads=False)
            own = both.aggregate([("over", "sum"), ("err", "sum")]).rename_columns({"over_sum": "over", "err_sum": "err"})
        if own.num_rows > self.capacity:
            over = own["over"].to_numpy()
            parted = np.partition(over, [len(over) - self.capacity - 1, len(over) - self.capacity])
            cut, least = parted[len(over) - self.capacity - 1], parted[len(over) - self.capacity]
            keep = np.flatnonzero(over > least)
            ties = np.flatnonzero(over == least)
            if len(keep) + len(ties) > self.capacity:
                by_key = pc.sort_indices(own["key"].take(ties)).to_numpy()
                ties = ties[by_key[: self.capacity - len(keep)]]
            own = own.take(np.sort(np.concatenate([keep, ties])))
            own = pa.table({c: own[c] if c == "key" else pc.subtract(own[c], int(cut)) for c in ("key", "over", "err")})
            self.floor += int(cut)
        self.held = own

    def rows(self, dim: str) -> pa.RecordBatch:
        ordered = self.held.sort_by([("over", "descending"), ("key", "ascending")])
        n = ordered.num_rows
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim] * n, pa.string()),
                pa.array(np.arange(1, n + 1, dtype=np.int32)),
                ordered["key"].combine_chunks(),
                pc.add(ordered["over"], self.floor).combine_chunks(),
                pc.add(ordered["err"], self.floor).combine_chunks(),
                pa.array(np.full(n, self.floor, np.int64)),
            ],
            schema=SS_ARROW,
        )


def _per_dim(batches: Iterator[pa.RecordBatch], make) -> dict[str, list]:
    """The summaries that ``make`` gives for each dim, fed with the sums of each batch."""
    held: dict[str, list] = {}
    for sums in batch_sums(batches):
        for dim in pc.unique(sums["dim"]).to_pylist():
            own = sums.filter(pc.equal(sums["dim"], dim))
            for summary in held.get(dim) or held.setdefault(dim, make()):
                summary.add(own["key"], own["w_sum"])
    return held


def misra_gries(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """The summary of one task, per dim."""
    for dim, (summary,) in _per_dim(batches, lambda: [MisraGries(capacity)]).items():
        yield summary.rows(dim)


def space_saving(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """The summary of one task, per dim."""
    for dim, (summary,) in _per_dim(batches, lambda: [SpaceSaving(capacity)]).items():
        yield summary.rows(dim)


def fold_space_saving(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One summary per dim of the rows of many."""
    held: dict[str, SpaceSaving] = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for dim in pc.unique(rows["dim"]).to_pylist():
            held.setdefault(dim, SpaceSaving(capacity)).add_summaries(rows.filter(pc.equal(rows["dim"], dim)))
    for dim, summary in held.items():
        yield summary.rows(dim)


def both(batches: Iterator[pa.RecordBatch], mg_capacity: int, ss_capacity: int) -> Iterator[pa.RecordBatch]:
    """Both summaries of one task, per dim, as rows of the wider one with ``kind`` before them."""
    made = _per_dim(batches, lambda: [MisraGries(mg_capacity), SpaceSaving(ss_capacity)])
    for dim, (mg, ss) in made.items():
        rows = mg.rows(dim)
        none = [pa.nulls(rows.num_rows, SS_ARROW.field(c).type) for c in ("rank", "err", "floor")]
        columns = [rows.column(0), none[0], rows.column(1), rows.column(2), none[1], none[2]]
        for kind, own in (("mg", columns), ("ss", ss.rows(dim).columns)):
            kinds = pa.array([kind] * len(own[0]), pa.string())
            yield pa.RecordBatch.from_arrays([kinds, *own], names=["kind", *SS_ARROW.names])
