"""The trie of all prefixes of conversations, with counts for each node.

A conversation travels as its key, one 16-byte digest for each turn (of role and text, SHA-256 cut to 128 bits), and the lengths of
its texts; the texts themselves stop where the turns are put in order. Conversations are range partitioned by (key, id), so that
neighbours share the longest prefixes and a group of equal conversations of any size is cut by id. Then

1. a task takes its sorted conversations in runs of ``RUN_BYTES``. In a run, neighbours are joined by edges as deep as their
   common prefix. A union-find takes the edges from the deepest on: components are intervals, each with the node at its
   top; a component climbs to the depth of an edge and gives out the nodes it passes, and a merge makes the branching node there;
2. the nodes on the path to the first and the last conversation of a run may have more members outside of it. They stay open: a run
   is contracted to these two spines, with what hangs off them summed at each depth. All others are final;
3. spines are sorted like conversations, so the same union-find merges them: those of a task's runs in the task, then those of ``FOLD``
   neighbouring partitions, and so on until one forest is left. A spine is as long as one conversation, so a task holds
   ``FOLD`` pairs of conversations, however many members they stand for;
4. a final node below an open one learns its parent's smallest member by a join with the open nodes, in which each partition asks
   once for each of its spines' nodes, so a parent with many children is not a hot key;
5. the ids of the conversations that end at a node are hashed in order as they pass. Only those of the first and last
   conversation of a run go on in the next; their ids are written as text pieces, which are hashed as a stream, one key in order.

A conversation must fit in a Spark value as 20 bytes a turn. Turns go by (turn, role, text), a null turn first; null roles and texts
are empty; rows without a conversation id are left out; repeated rows are turns each. An empty table gives no nodes. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglark.session import materialize

#: Bytes of a turn in a key.
TURN = 16
RUN_BYTES = 2 << 20
#: Forests merged in one task.
FOLD = 64
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): for each conversation its turns in order, each as the digest and the length of what was said."""
    said = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("at"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("at"), "role", "text")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text").cast("binary")
    numbered = said.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        F.substring(F.sha2(whole, 256), 1, 2 * TURN).alias("digest"),
        F.char_length("text").alias("chars"),
    )
    own = F.sort_array(F.collect_list(F.struct("k", "digest", "chars")))
    return numbered.groupBy("conv_id").agg(F.transform(own, lambda t: t.dropFields("k")).alias("turns"))


def with_shared_starts(rows: DataFrame, share: Column, base: Column, most: int) -> DataFrame:
    """Sequences with their first ``share`` turns, at most ``most``, replaced by those of the conversation ``base``."""
    heads = rows.where(base == F.col("conv_id")).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head")
    )
    wanted = rows.select("conv_id", "turns", share.cast("int").alias("_share"), base.alias("_base"))
    joined = wanted.join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_share"))
    rest = F.slice("turns", F.col("_share") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


@dataclass
class _Spine:
    """A path from the root: the key of its end, and at each depth what hangs off it, without the path itself."""

    key: bytes
    chars: np.ndarray  # of the text at depths 1, 2, ...
    convs: np.ndarray  # members that are in no node below on the path
    first: np.ndarray  # the smallest of them
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    ends: list  # digest of the members that end here; None: none do, or the group goes on elsewhere

    @property
    def depth(self) -> int:
        return len(self.chars)


NONE = np.iinfo(np.int64).max


@dataclass
class _Top:
    """The node at the top of a component, and what is known below it."""

    depth: int
    item: int  # the leftmost item, whose key and lengths hold for the path
    last: int  # the rightmost item
    convs: int
    first: int
    children: int
    leaves: int
    saved: int
    ends: object  # ids that end here, or a digest, or None
    waiting: list = field(default_factory=list)  # rows of children, which wait for their parent's member


@dataclass
class _Out:
    """Rows of nodes: final ones, and those whose parent is still open (``up``) or that were open before (``own``)."""

    rows: list = field(default_factory=list)

    def add(self, top: _Top, chars: int, own: bytes | None) -> list:
        leaves = top.leaves if top.children else 1
        saved = top.saved + (top.convs - 1) * chars
        ends = top.ends
        if isinstance(ends, list):
            ends = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else None
        row = [top.first, top.depth, None, top.convs, top.children, leaves, saved, ends, own, None]
        self.rows.append(row)
        for child in top.waiting:
            child[2] = top.first
        return row


def _common(a: bytes, b: bytes) -> int:
    """The number of turns that two keys share at their start."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    low, high = 0, n  # the common part is at least low and less than high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * TURN] == b[: middle * TURN] else (low, middle)
    return low


def _names(key: bytes) -> list[bytes]:
    """A name for each prefix of a key, from the empty one to the whole."""
    so_far, names = hashlib.sha256(), []
    for at in range(0, len(key) + 1, TURN):
        names.append(so_far.copy().digest())
        so_far.update(key[at : at + TURN])
    return names


class _Conversations:
    """Items of a run: conversations, which hang off their own end."""

    def __init__(self, keys: list[bytes], chars: list[np.ndarray], ids: list[int]):
        self.keys, self.chars, self.ids = keys, chars, ids

    def top(self, i: int) -> _Top:
        return _Top(len(self.keys[i]) // TURN, i, i, 1, self.ids[i], 0, 0, 0, [self.ids[i]])

    def hang(self, i: int, top: _Top) -> None:
        pass

    def merged(self, i: int, j: int, depth: int) -> None:
        pass

    def name(self, i: int, depth: int) -> bytes | None:
        """Nodes that were never open need no name."""
        return None


class _Spines:
    """Items that stand for forests."""

    def __init__(self, spines: list[_Spine]):
        self.spines = spines
        self.keys, self.chars = [s.key for s in spines], [s.chars for s in spines]
        self.names: dict[int, list[bytes]] = {}

    def top(self, i: int) -> _Top:
        s, d = self.spines[i], self.spines[i].depth
        return _Top(d, i, i, int(s.convs[d]), int(s.first[d]), int(s.children[d]), int(s.leaves[d]), int(s.saved[d]), s.ends[d])

    def hang(self, i: int, top: _Top) -> None:
        s, d = self.spines[i], top.depth
        top.convs += int(s.convs[d])
        top.first = min(top.first, int(s.first[d]))
        top.children += int(s.children[d])
        top.leaves += int(s.leaves[d])
        top.saved += int(s.saved[d])
        top.ends = s.ends[d]

    def merged(self, i: int, j: int, depth: int) -> None:
        """The items j stand behind the items i from now on: what hangs off their common path is summed on the path of i."""
        a, b = self.spines[i], self.spines[j]
        for name in ("convs", "children", "leaves", "saved"):
            getattr(a, name)[:depth] += getattr(b, name)[:depth]
        np.minimum(a.first[:depth], b.first[:depth], out=a.first[:depth])
        for d in range(depth):
            a.ends[d] = a.ends[d] or b.ends[d]

    def name(self, i: int, depth: int) -> bytes | None:
        if i not in self.names:
            self.names[i] = _names(self.keys[i])
        return self.names[i][depth]


def _forest(items: _Conversations | _Spines, out: _Out, closed: bool) -> list[_Spine]:
    """The nodes of the trie of sorted items: final ones to ``out``, and the two spines that are left open unless ``closed``."""
    keys, n = items.keys, len(items.keys)
    common = [_common(a, b) for a, b in zip(keys, keys[1:])]
    tops = [items.top(i) for i in range(n)]
    parent = list(range(n))
    spine_of: dict[int, dict[int, _Top]] = {0: {}, 1: {}}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def climb(top: _Top, depth: int) -> None:
        """Give out the nodes from the top of a component down to below ``depth``; its top is then at ``depth``."""
        chars = items.chars[top.item]
        left, right = not closed and top.item == 0, not closed and top.last == n - 1
        while top.depth > depth:
            below = top.depth
            if left or right:  # the node stays open: keep what hangs off it
                spine_of[0 if left else 1][below] = _Top(**vars(top))
                top.convs, top.first, top.children, top.leaves, top.saved = 0, NONE, 0, 0, 0
                top.waiting = []
            else:
                length = int(chars[below - 1])
                row = out.add(top, length, items.name(top.item, below))
                top.leaves, top.saved, top.children, top.waiting = row[5], row[6], 1, [row]
            top.depth, top.ends = below - 1, None
            items.hang(top.item, top)

    for i in sorted(range(n - 1), key=lambda i: (-common[i], i)):
        a, b, depth = find(i), find(i + 1), common[i]
        left, right = tops[a], tops[b]
        climb(left, depth)
        climb(right, depth)
        parent[b] = a
        left.last = right.last
        left.convs += right.convs
        left.first = min(left.first, right.first)
        left.children += right.children
        left.leaves += right.leaves
        left.saved += right.saved
        left.waiting += right.waiting
        if isinstance(left.ends, list) and isinstance(right.ends, list):
            left.ends += right.ends
        else:
            left.ends = left.ends or right.ends
        items.merged(left.item, right.item, depth)
        tops[b] = None
    root = tops[find(0)]
    climb(root, 0)
    if closed:
        out.add(root, 0, items.name(root.item, 0))
        return []
    spine_of[0][0] = root
    return _spines(items, spine_of)


def _spines(items: _Conversations | _Spines, spine_of: dict[int, dict[int, _Top]]) -> list[_Spine]:
    """The open nodes as one path to the first item and one to the last; nodes on both belong to the first."""
    made = []
    ends_of_run = (items.keys[0], items.keys[-1])
    for side, i in ((0, 0), (1, len(items.keys) - 1)):
        if side and not spine_of[1]:
            continue
        names = _names(items.keys[i])
        key, depth = items.keys[i], len(items.keys[i]) // TURN
        spine = _Spine(key, np.asarray(items.chars[i], np.int64), *(np.zeros(depth + 1, np.int64) for _ in range(5)), [None] * (depth + 1))
        spine.first[:] = NONE
        for d, top in spine_of[side].items():
            ends = top.ends
            if isinstance(ends, list):  # the group of the first and last key may go on outside; others end here
                straddles = key[: d * TURN] in ends_of_run
                ends = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends and not straddles else None
            spine.convs[d], spine.first[d], spine.children[d] = top.convs, top.first, top.children
            spine.leaves[d], spine.saved[d], spine.ends[d] = top.leaves, top.saved, ends
            for child in top.waiting:
                child[9] = names[d]
        made.append(spine)
    return made


#: What the tasks give out: nodes, spines, and pieces of lists of ids, told apart by ``kind``.
_ROWS = (
    "kind string, part long, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_chars long, ends string, own binary, up binary, key binary, chars array<long>, convs array<long>, first array<long>, "
    "children array<long>, leaves array<long>, saved array<long>, spine_ends array<string>, side int, ids string"
)
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_chars", "ends", "own", "up")
_ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_chars")]
    + [("ends", pa.string()), ("own", pa.binary()), ("up", pa.binary()), ("key", pa.binary()), ("chars", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("convs", "first", "children", "leaves", "saved")]
    + [("spine_ends", pa.list_(pa.string())), ("side", pa.int32()), ("ids", pa.string())]
)


def _batch(rows: dict[str, list], n: int) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW
    )


def _nodes(out: _Out, part: int) -> pa.RecordBatch:
    n = len(out.rows)
    columns = dict(zip(_NODE, zip(*out.rows))) if n else {}
    return _batch({"kind": ["node"] * n, "part": [part] * n} | columns, n)


def _spine_rows(spines: list[_Spine], part: int) -> pa.RecordBatch:
    n = len(spines)
    columns = {"kind": ["spine"] * n, "part": [part] * n, "side": list(range(n)), "spine_ends": [s.ends for s in spines]}
    names = ("key", "chars", "convs", "first", "children", "leaves", "saved")
    return _batch(columns | {c: [getattr(s, c) for s in spines] for c in names}, n)


def _id_pieces(keys: list[bytes], ids: list[int]) -> pa.RecordBatch:
    """The ids of the conversations like the first and like the last one of a run."""
    n = len(keys)
    head = next((i for i in range(n) if keys[i] != keys[0]), n)
    tail = next(i for i in range(n - 1, -2, -1) if i < 0 or keys[i] != keys[-1]) + 1
    groups = [(0, head)] if head == n else [(0, head), (tail, n)]
    return _batch(
        {
            "kind": ["ids"] * len(groups), "own": [_names(keys[a])[-1] for a, _ in groups],
            "conv_id": [ids[a] for a, _ in groups], "ids": [",".join(map(str, ids[a:b])) for a, b in groups],
        },
        len(groups),
    )


def _sorted_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one range of conversations, run by run."""
    part = TaskContext.get().partitionId()
    keys: list[bytes] = []
    chars: list[np.ndarray] = []
    ids: list[int] = []
    spines: list[_Spine] = []

    def run() -> Iterator[pa.RecordBatch]:
        out = _Out()
        spines.extend(_forest(_Conversations(keys, chars, ids), out, closed=False))
        yield _nodes(out, part)
        yield _id_pieces(keys, ids)
        for held in (keys, chars, ids):
            held.clear()
        if len(spines) > 2 * FOLD:
            yield from contract()

    def contract() -> Iterator[pa.RecordBatch]:
        out = _Out()
        spines[:] = _forest(_Spines(spines[:]), out, closed=False)
        yield _nodes(out, part)

    size = 0
    for batch in batches:
        lists = batch.column("chars")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, (key, conv) in enumerate(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist())):
            if size > RUN_BYTES:
                yield from run()
                size = 0
            keys.append(key)
            chars.append(values[offsets[i] : offsets[i + 1]].copy())
            ids.append(conv)
            size += len(key) + TURN
    if keys:
        yield from run()
    if len(spines) > 2:
        yield from contract()
    if spines:
        yield _spine_rows(spines, part)


def _merge_task(closed: bool):
    """What makes one forest of those of neighbouring parts."""
    return lambda table: _merge(table, closed)


def _merge(table: pa.Table, closed: bool) -> pa.Table:
    rows = table.sort_by([("part", "ascending"), ("side", "ascending")]).to_pylist()
    whole = rows[0]["fold"]
    spines = [
        _Spine(r["key"], np.array(r["chars"], np.int64), *(np.array(r[c], np.int64) for c in ("convs", "first", "children", "leaves", "saved")), r["spine_ends"])
        for r in rows
    ]
    out = _Out()
    left = _forest(_Spines(spines), out, closed)
    return pa.Table.from_batches([_nodes(out, whole), *([_spine_rows(left, whole)] if left else [])])


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the ids of each name; its pieces come one after the other in order."""
    name, state, first = None, None, True
    for batch in batches:
        for own, ids in zip(batch.column("own").to_pylist(), batch.column("ids").to_pylist()):
            if own != name:
                if name is not None:
                    yield pa.RecordBatch.from_pydict({"own": [name], "digest": [state.hexdigest()]})
                name, state, first = own, hashlib.sha256(), True
            state.update(ids.encode() if first else b"," + ids.encode())
            first = False
    if name is not None:
        yield pa.RecordBatch.from_pydict({"own": [name], "digest": [state.hexdigest()]})


def nodes(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The trie of the sequences ``rows`` (conv_id, turns): a row for each distinct prefix.

    (conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_chars, ends_sha256); with its depth a
    conversation names one node, so ``conv_id`` and ``depth`` are a key. Ids must be distinct.
    """
    spark = rows.sparkSession
    digests = F.transform("turns", lambda t: t.getField("digest"))
    keyed = rows.select(
        F.unhex(F.array_join(digests, "")).alias("key"),
        "conv_id",
        F.transform("turns", lambda t: t.getField("chars")).alias("chars"),
    )
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keyed, "sequences").repartitionByRange(count, "key", "conv_id")
    sort_task, merge_task, hash_task = _sorted_task, _merge_task, _hash_task
    made = materialize(ranged.sortWithinPartitions("key", "conv_id").mapInArrow(lambda b: sort_task(b), _ROWS), "forests")
    levels, level = [], made
    last = level.where("kind = 'spine'").agg(F.max("part")).first()[0]
    while last is not None:
        last //= FOLD
        closed = last == 0
        spines = level.where("kind = 'spine'").withColumn("fold", F.floor(F.col("part") / FOLD))
        merged = spines.groupBy("fold").applyInArrow(merge_task(closed), _ROWS)
        level = materialize(merged, "forests")
        levels.append(level.where("kind = 'node'"))
        if closed:
            break
    own = made.where("kind = 'node'").withColumn("level", F.lit(0))
    if not levels:
        return _finished(own)
    pieces = made.where("kind = 'ids'").select("own", "conv_id", "ids")
    digests_of = pieces.repartition("own").sortWithinPartitions("own", "conv_id").mapInArrow(
        lambda b: hash_task(b), "own binary, digest string"
    )
    # Nodes that were open at some time: they have a name, and their ids may have come in pieces.
    opened = own.where("own IS NOT NULL")
    for k, above in enumerate(levels):
        opened = opened.unionByName(above.withColumn("level", F.lit(k + 1)))
    opened = opened.join(digests_of, "own", "left").withColumn("ends", F.coalesce("ends", "digest")).drop("digest")
    opened = materialize(opened, "opened")
    every = own.where("own IS NULL").unionByName(opened)
    # Each part asks once for the members of the open nodes that its nodes hang below.
    below = every.where("up IS NOT NULL")
    asked = below.select("level", "part", "up").distinct()
    parents = opened.select(F.col("own").alias("up"), F.col("conv_id").alias("_parent"))
    told = asked.join(parents, "up")
    resolved = below.join(told, ["level", "part", "up"]).withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    return _finished(every.where("up IS NULL").unionByName(resolved.select(*every.columns)))


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_chars",
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
