"""Scoring texts with a trigram model that is counted over the whole corpus and kept as sharded Elias-Fano tries.

Words: all training tokens are counted. The ``HEAD`` most frequent words at most have ids that all tasks know (their table is
bounded and is broadcast); they say which contexts are frequent, and save bytes. All others travel as 64-bit hashes and get
ids inside each shard, so each word is told apart in every n-gram, whatever the size of the vocabulary.

Shards: a token meets the counts of its contexts in the shard of the word before it. Words before it that are frequent are
spread over several shards by the word before that; each of those gets all counts of pairs with the frequent word, summed up
in the tasks first. Other words go to shards by their hash. The exact counts of words without a broadcast id are sent by a
join to the shards that predict them. A task packs the tokens of some thousand texts into one compressed row for each shard; a
shard builds its trie, looks all its tokens up, and sends back sums for each text, which are added up. A shard with more
than ``MOST_IDS`` words is worked off in parts by the word before the token; one such word alone with more than that many
words around it raises an error.

Data that travels is in proportion to the tokens, memory in a task to the tokens of a shard, of which there are
``SHARDS_IN_TASK`` times ``spark.sql.shuffle.partitions``. A null text is empty and has the end token only; ids may be null or repeat; without
training texts the base score is 0 for every text. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglark.llm.ngram_trie import IDS, Trie, distinct
from loglark.llm.text import utf8
from loglark.session import materialize

#: Words with ids that all tasks know, at most.
HEAD = 1 << 17
#: Ids in the trie of a shard, so that three make a key, and tokens of a packed row, which have three words each.
MOST_IDS = 1 << 21
TOKENS_IN_ROW = 1 << 19
TAIL, END, BEGIN, FIRST_WORD = 0, 1, 2, 3
#: Tokens and texts packed at once in a task.
TOKENS_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 1 << 15
#: Shards that a task works off one after the other, each in a part of the memory.
SHARDS_IN_TASK = 2
#: Words that a task remembers the ids of.
REMEMBERED = 250_000
ALPHA = 0.1
_END_HASH = xxhash.xxh64_intdigest(b"\n")
_U = np.uint64
_BITS = _U(MOST_IDS.bit_length() - 1)
_LOW = _U(MOST_IDS - 1)
_PAIR_BITS = _U(32)


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word's hash, count) of the texts of this task."""
    counts: dict[bytes, int] = {}
    get = counts.get
    texts = 0

    def flush() -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
        number = np.fromiter(counts.values(), np.int64, len(counts))
        for at in range(0, len(number), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[part]), pa.array(number[part])], names=["word", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column(0):
            for word in tokens(text.as_py()):
                counts[word] = get(word, 0) + 1
            texts += 1
            if len(counts) > REMEMBERED:
                yield from flush()
    if texts:
        yield from flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([_END_HASH], np.uint64).view(np.int64)), pa.array([texts], pa.int64())], names=["word", "n"]
        )


class Vocabulary:
    """What every task knows: the ids of frequent words, and the totals of all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end_count: int, total: int, kinds: int, shards: int):
        order = np.lexsort((words, -counts))
        self.words = words[order]
        self.total, self.kinds, self.shards = total, kinds, shards
        self.counts = np.concatenate([[0, end_count, 0], counts[order]]).astype(np.float64)
        head = int(self.counts.sum())
        self.norm = total + ALPHA * (kinds + 1)
        self.tail_norm = (total - head) + ALPHA * (kinds - len(words) - (end_count > 0) + 1)
        p = (self.counts + ALPHA) / self.norm
        p[TAIL] = self.tail_norm / self.norm
        self.unigram = p
        # A context with a large share of all tokens is spread over shards, so that none gets much more than its share.
        before = self.counts.copy()
        before[BEGIN] = end_count
        share = before / max(1, total)
        self.spread = np.maximum(1, np.ceil(2 * shards * share)).astype(np.int64)
        self.spread = np.minimum(self.spread, shards)
        self.first_shard = (_mixed(np.arange(len(p), dtype=np.uint64)) % _U(shards)).astype(np.int64)

    def shard_of(self, v: np.ndarray, u: np.ndarray, v_hash: np.ndarray | None = None, u_hash: np.ndarray | None = None) -> np.ndarray:
        """By ids, and by the hashes of words without one."""
        name = u.astype(np.uint64)
        first = self.first_shard[v]
        if v_hash is not None:
            name = np.where(u == TAIL, u_hash, name)
            first = np.where(v == TAIL, (_mixed(v_hash) % _U(self.shards)).astype(np.int64), first)
        step = (_mixed(name + _U(IDS)) % self.spread[v].astype(np.uint64)).astype(np.int64)
        return (first + step) % self.shards


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + _U(1)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(31)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their values, compressed."""
    n = len(arrays[0])
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _from_planes(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    flat = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=n * sum(np.dtype(k).itemsize for k in kinds) + 1)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(flat, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


# What rows carry, in the order in which a shard or a text group wants them.
_TEXTS, _PAIRS, _TRIPLES, _RARE, _COUNTS = 0, 1, 2, 3, 4
_ROW = "shard int, kind int, texts long, data binary"


def _row(shard: int, kind: int, texts: int, data: bytes) -> tuple:
    return shard, kind, texts, data


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["shard", "kind", "texts", "data"]
    )


def _earlier(ids: np.ndarray, lengths: np.ndarray, begin: int = BEGIN) -> tuple[np.ndarray, np.ndarray]:
    """(the one before, the one before that) of the tokens of texts one after the other."""
    first = np.cumsum(lengths) - lengths
    v, u = np.empty_like(ids), np.empty_like(ids)
    v[1:] = ids[:-1]
    v[first] = begin
    u[1:] = v[:-1]
    u[first] = begin
    return v, u


def _contexts(vocabulary: Vocabulary, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> tuple:
    """(v, u, shard) of each token; v and u are TAIL for words without an id."""
    v, u = _earlier(ids, lengths)
    return v, u, vocabulary.shard_of(v, u, *_earlier(hashes, lengths, 0))


def _renumbered(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns with the ids from ``base`` on made dense, and which of those (less ``base``) there were, in order."""
    flat = np.concatenate(columns)
    high = flat >= base
    own, at = np.unique(flat[high], return_inverse=True)
    flat[high] = base + at
    return np.split(flat.astype(np.uint64), len(columns)), own - base


def _with_words(words: np.ndarray, data: bytes) -> bytes:
    packed = _planes(np.diff(words, prepend=_U(0))) if len(words) else b""
    return len(packed).to_bytes(8, "little") + packed + data


def _words_and(data: bytes) -> tuple[np.ndarray, bytes]:
    n = 8 + int.from_bytes(data[:8], "little")
    if n == 8:
        return np.zeros(0, np.uint64), data[n:]
    return np.cumsum(_from_planes(data[8:n], np.uint64)[0], dtype=np.uint64), data[n:]


def _pack(vocabulary: Vocabulary, ids: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, trains: np.ndarray,
          keys: list, texts: int) -> Iterator[tuple]:
    """Rows for one group of texts: ``ids`` and ``hashes`` of their tokens one after the other."""
    shards = vocabulary.shards
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    head = np.where(ids != TAIL, np.log10(vocabulary.counts[ids] + ALPHA), 0.0)
    known = (ids != TAIL) & (vocabulary.counts[ids] > 0)
    table = pa.table(
        {
            "id": pa.array(keys, pa.int64()),
            "trains": pa.array(trains),
            "n_tokens": lengths.astype(np.int64),
            "n_known": np.bincount(owner, known, len(lengths)).astype(np.int64),
            "head": np.bincount(owner, head, len(lengths)),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    yield _row(texts % shards, _TEXTS, texts, sink.getvalue().to_pybytes())

    v, u, shard = _contexts(vocabulary, ids, hashes, lengths)
    mark = (owner | np.where(trains, TEXTS_AT_ONCE, 0)[owner]).astype(np.uint16)
    base = len(vocabulary.counts)
    tail = ids == TAIL
    rare_words, at = np.unique(hashes[tail], return_inverse=True)
    local = ids.astype(np.int64)
    local[tail] = base + at
    before, before_that = _earlier(local, lengths)
    order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable").astype(np.int32)
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        for start in range(cuts[s], cuts[s + 1], TOKENS_IN_ROW):
            at = order[start : min(start + TOKENS_IN_ROW, cuts[s + 1])]
            (first, second, third), own = _renumbered([before[at], before_that[at], local[at]], base)
            key = (first << _BITS | second) << _BITS | third
            by = np.argsort(key)
            data = _with_words(rare_words[own], _planes(np.diff(key[by], prepend=_U(0)), mark[at][by]))
            yield _row(s, _TRIPLES, texts, data)
    del before_that

    counted = (vocabulary.spread[v] > 1) & trains[owner]
    pairs, times = np.unique(before[counted].astype(np.uint64) << _PAIR_BITS | local[counted].astype(np.uint64), return_counts=True)
    spread = (pairs >> _PAIR_BITS).astype(np.int64)
    for s in range(shards):
        inside = (s - vocabulary.first_shard[spread]) % shards < vocabulary.spread[spread]
        if inside.any():
            (third,), own = _renumbered([(pairs[inside] & _U(0xFFFFFFFF)).astype(np.int64)], base)
            key = pairs[inside] >> _PAIR_BITS << _PAIR_BITS | third
            data = _with_words(rare_words[own], _planes(np.diff(key, prepend=_U(0)), times[inside].astype(np.uint32)))
            yield _row(s, _PAIRS, texts, data)

    rare = np.flatnonzero(ids == TAIL)
    rare = rare[np.argsort(hashes[rare])]
    # The leading bits choose the shard, so each shard takes one stretch of the sorted hashes.
    cuts = np.searchsorted((hashes[rare] >> _U(32)) * _U(shards) >> _U(32), np.arange(shards + 1))
    for s in range(shards):
        at = rare[cuts[s] : cuts[s + 1]]
        if len(at):
            yield _row(s, _RARE, texts, _planes(np.diff(hashes[at], prepend=_U(0)), mark[at]))


def _asker(shared):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word's hash, shard) of the words without an id that the shards have to predict."""
        vocabulary: Vocabulary = Vocabulary(*shared.value)
        head = {h: k + FIRST_WORD for k, h in enumerate(vocabulary.words.tolist())}

        class Words(dict):
            """Word to its place in ``hashes`` and ``ids``."""

            def __missing__(self, word: bytes) -> int:
                place = self[word] = len(hashes)
                h = xxhash.xxh64_intdigest(word)
                hashes.append(h)
                ids.append(head.get(h, TAIL))
                return place

        hashes, ids = [_END_HASH], [END]
        words = Words()
        places: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal places, held, hashes, ids, words
            place = np.concatenate(places)
            own, h = np.array(ids, np.int32)[place], np.array(hashes, np.uint64)[place]
            shard = _contexts(vocabulary, own, h, np.array([len(p) for p in places]))[2]
            tail = own == TAIL
            h, shard = h[tail], shard[tail].astype(np.int32)
            order = np.lexsort((h, shard))
            h, shard = h[order], shard[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
            h, shard = h[new].view(np.int64), shard[new]
            for at in range(0, len(h), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(shard[part])], names=["word", "shard"])
            places, held = [], 0
            if len(words) > REMEMBERED:
                hashes, ids = [_END_HASH], [END]
                words = Words()

        for batch in batches:
            for text in batch.column(0):
                found = tokens(text.as_py())
                places.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                if not len(found):
                    places.pop()
                held += len(found)
                if held >= TOKENS_AT_ONCE:
                    yield from flush()
        if places:
            yield from flush()

    return ask


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shard, word, n) to rows for the shards."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        shard, word, n = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((word, shard))
        shard, word, n = shard[order], word[order], n[order]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        return _rows([
            _row(int(shard[a]), _COUNTS, 0, _planes(np.diff(word[a:b], prepend=_U(0)), n[a:b])) for a, b in zip(cuts, cuts[1:])
        ])

    for batch in batches:
        shard, word, n = (c.to_numpy() for c in batch.columns)
        if len(shard):
            held.append((shard, word.view(np.uint64), n))
        if sum(len(h[0]) for h in held) >= TOKENS_AT_ONCE:
            yield flush()
    if held:
        yield flush()


def _shard_parts(parts: list, pairs: list, base: int, depth: int = 0) -> Iterator[tuple]:
    """(words without an id, triples, pairs) of a shard, cut by the word before the token until MOST_IDS are enough.

    Triples are (texts, words, keys, mark) and pairs (words, keys, times), each with ids from ``base`` on for its own words.
    """
    words = np.unique(np.concatenate([p[1] for p in parts] + [p[0] for p in pairs]))
    if base + len(words) <= MOST_IDS:
        yield words, parts, pairs
        return
    if depth == 48:
        raise ValueError("a word has too many words around it for one shard: raise spark.sql.shuffle.partitions")

    def side(words: np.ndarray, v: np.ndarray) -> np.ndarray:
        name = v.copy()
        name[v >= base] = words[(v[v >= base] - _U(base)).astype(np.int64)]
        return _mixed(name) >> _U(depth) & _U(1)

    sides = [side(p[1], p[2] >> (_BITS * _U(2))) for p in parts]
    pair_sides = [side(p[0], p[1] >> _PAIR_BITS) for p in pairs]
    for k in (0, 1):
        some, some_pairs = [], []
        for (texts, own, key, mark), at in zip(parts, sides):
            key, mark = key[at == k], mark[at == k]
            if len(key):
                (v, u, w), used = _renumbered([x.astype(np.int64) for x in (key >> (_BITS * _U(2)), key >> _BITS & _LOW, key & _LOW)], base)
                some.append((texts, own[used], (v << _BITS | u) << _BITS | w, mark))
        for (own, key, times), at in zip(pairs, pair_sides):
            key, times = key[at == k], times[at == k]
            if len(key):
                (w,), used = _renumbered([(key & _U(0xFFFFFFFF)).astype(np.int64)], base)
                some_pairs.append((own[used], key >> _PAIR_BITS << _PAIR_BITS | w, times))
        if some:
            yield from _shard_parts(some, some_pairs, base, depth + 1)


def _router(shared):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (id, trains, text) to rows for the shards."""
        vocabulary: Vocabulary = Vocabulary(*shared.value)
        head = {h: k + FIRST_WORD for k, h in enumerate(vocabulary.words.tolist())}
        group = TaskContext.get().partitionId() << 24

        class Words(dict):
            """Word to its place in ``hashes`` and ``ids``."""

            def __missing__(self, word: bytes) -> int:
                place = self[word] = len(hashes)
                h = xxhash.xxh64_intdigest(word)
                hashes.append(h)
                ids.append(head.get(h, TAIL))
                return place

        hashes, ids = [_END_HASH], [END]
        words = Words()
        places: list[np.ndarray] = []
        lengths: list[int] = []
        keys, trains = [], []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal places, lengths, keys, trains, held, group, hashes, ids, words
            place = np.concatenate(places)
            rows = _pack(
                vocabulary, np.array(ids, np.int32)[place], np.array(hashes, np.uint64)[place], np.array(lengths),
                np.array(trains, bool), keys, group,
            )
            size, out = 0, []
            for row in rows:
                out.append(row)
                size += len(row[3])
                if size > 4 << 20:
                    yield _rows(out)
                    size, out = 0, []
            if out:
                yield _rows(out)
            group += 1
            places, lengths, keys, trains, held = [], [], [], [], 0
            if len(words) > REMEMBERED:
                hashes, ids = [_END_HASH], [END]
                words = Words()

        for batch in batches:
            for key, train, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = tokens(text)
                own = np.zeros(len(found) + 1, np.int32)  # the last place is the end token
                own[:-1] = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                places.append(own)
                lengths.append(len(own))
                keys.append(key)
                trains.append(train)
                held += len(own)
                if held >= TOKENS_AT_ONCE or len(keys) == TEXTS_AT_ONCE:
                    yield from flush()
        if keys:
            yield from flush()

    return route


def _looker(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums for each text from the rows of each shard, which come sorted by shard and kind."""
        vocabulary: Vocabulary = Vocabulary(*shared.value)
        base = len(vocabulary.counts)
        shard = None
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        triples: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[tuple[int, np.ndarray, np.ndarray]] = []

        def sums(kind: int, parts: list, value: np.ndarray, more: np.ndarray | None = None) -> Iterator[tuple]:
            at = 0
            for texts, _, mark in parts:
                own = slice(at, at + len(mark))
                at += len(mark)
                owner = (mark & np.uint16(TEXTS_AT_ONCE - 1)).astype(np.int64)
                there = np.flatnonzero(np.bincount(owner))
                total = np.bincount(owner, value[own])[there]
                if more is None:
                    data = _planes(there.astype(np.uint16), total.astype(np.float32))
                else:
                    data = _planes(there.astype(np.uint16), total, np.bincount(owner, more[own])[there].astype(np.uint32))
                yield _row(0, kind, texts, data)

        def one(words: np.ndarray, parts: list, some: list, known: np.ndarray, number: np.ndarray) -> Iterator[tuple]:
            """The sums of triples, by a trie with ids for ``words``, whose counts ``known`` has."""
            size = base + len(words)
            bits = _U(size.bit_length())
            low = (_U(1) << bits) - _U(1)
            count = np.zeros(len(words))
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                count = np.where(known[at] == words, number[at], 0)
            # Words that are not predicted here, but follow a spread context, have no count and are not looked up.
            p = np.concatenate([vocabulary.unigram, (count + ALPHA) / vocabulary.norm])

            def ids(x: np.ndarray, own: np.ndarray) -> np.ndarray:
                high = np.flatnonzero(x >= base)
                x[high] = (base + np.searchsorted(words, own)).astype(np.uint64)[x[high].astype(np.int64) - base]
                return x

            keys = []
            for k, (texts, own, key, mark) in enumerate(parts):
                v, u, w = (ids(x, own) for x in (key >> (_BITS * _U(2)), key >> _BITS & _LOW, key & _LOW))
                keys.append((v << bits | u) << bits | w)
                parts[k] = (texts, None, mark)
            asked, back = distinct(np.concatenate(keys))
            del keys
            trains = np.concatenate([m for _, _, m in parts]) >= TEXTS_AT_ONCE
            counts = np.bincount(back[trains], minlength=len(asked))
            seen = np.flatnonzero(counts)
            trigrams, trigram_counts = asked[seen], counts[seen]
            del seen, counts, trains
            v = (trigrams >> (bits * _U(2))).astype(np.int64)
            single = vocabulary.spread[np.where(v < base, v, TAIL)] == 1
            found = [(v.astype(np.uint64) << bits | (trigrams & low))[single]]
            found += [key >> _PAIR_BITS << bits | ids(key & _U(0xFFFFFFFF), own) for own, key, _ in some]
            times = [trigram_counts[single], *(t for _, _, t in some)]
            bigrams, to = distinct(np.concatenate(found))
            bigram_counts = np.bincount(to, np.concatenate(times), len(bigrams))
            del found, times, to, v, single
            trie = Trie.build(bigrams, bigram_counts, trigrams, trigram_counts, p, int(bits)).mapped()
            del bigrams, bigram_counts, trigrams, trigram_counts
            values = trie.log10(asked, np.log10(p)).astype(np.float32)
            del trie, asked
            yield from sums(_TRIPLES, parts, values[back])

        def close() -> Iterator[tuple]:
            if triples:
                known = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.uint64)
                order = np.argsort(known)
                known, number = known[order], np.concatenate([c[1] for c in counted] or [np.zeros(0, np.int64)])[order]
                whole, whole_pairs = triples[:], pairs[:]
                triples.clear()
                pairs.clear()
                for words, parts, some in _shard_parts(whole, whole_pairs, base):
                    whole = whole_pairs = None
                    yield from one(words, parts, some, known, number)
            if rare:
                asked, back = distinct(np.concatenate([h for _, h, _ in rare]))
                trains = np.concatenate([m for _, _, m in rare]) >= TEXTS_AT_ONCE
                counts = np.bincount(back[trains], minlength=len(asked))
                yield from sums(_RARE, rare, np.log10(counts + ALPHA)[back], (counts > 0)[back])
            pairs.clear()
            triples.clear()
            rare.clear()
            counted.clear()

        for batch in batches:
            heads = (batch.column(i).to_pylist() for i in range(3))
            for s, kind, texts, packed in zip(*heads, batch.column(3)):
                data = packed.as_py()  # one row at a time, as rows are long
                if s != shard:
                    for row in close():
                        yield _rows([row])
                    shard = s
                if kind == _TEXTS:
                    yield _rows([_row(0, kind, texts, data)])
                elif kind == _PAIRS:
                    own, data = _words_and(data)
                    gaps, times = _from_planes(data, np.uint64, np.uint32)
                    pairs.append((own, np.cumsum(gaps, dtype=np.uint64), times))
                elif kind == _TRIPLES:
                    own, data = _words_and(data)
                    gaps, mark = _from_planes(data, np.uint64, np.uint16)
                    triples.append((texts, own, np.cumsum(gaps, dtype=np.uint64), mark))
                elif kind == _COUNTS:
                    gaps, times = _from_planes(data, np.uint64, np.int64)
                    counted.append((np.cumsum(gaps, dtype=np.uint64), times))
                else:
                    gaps, mark = _from_planes(data, np.uint64, np.uint16)
                    rare.append((texts, np.cumsum(gaps, dtype=np.uint64), mark))
        for row in close():
            yield _rows([row])

    return look


_RESULT = (
    "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _gatherer(shared):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the texts of each group from its sums, which come sorted by group and kind."""
        vocabulary: Vocabulary = Vocabulary(*shared.value)
        table = None

        def close() -> pa.RecordBatch:
            n = table["n_tokens"].to_numpy()
            norm = np.log10(vocabulary.norm)
            return pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks(), pa.array(~table["trains"].to_numpy()), pa.array(n), pa.array(known),
                    pa.array(np.full(len(n), vocabulary.total, np.int64)), pa.array(base - n * norm),
                    pa.array(score),
                ],
                names=[f.split()[0] for f in _RESULT.split(", ")],
            )

        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if kind == _TEXTS:
                    if table is not None:
                        yield close()
                    table = pa.ipc.open_stream(data).read_all()
                    base, known = table["head"].to_numpy().copy(), table["n_known"].to_numpy().copy()
                    score = np.zeros(len(base))
                elif kind == _TRIPLES:
                    at, total = _from_planes(data, np.uint16, np.float32)
                    score[at] += total
                else:
                    at, total, more = _from_planes(data, np.uint16, np.float64, np.uint32)
                    base[at] += total
                    known[at] += more
        if table is not None:
            yield close()

    return gather


def vocabulary_of(docs: DataFrame, train: Column, text_col: str, shards: int, head: int = HEAD) -> tuple[tuple, DataFrame]:
    """The arguments of Vocabulary, from the counts of all training tokens, and these (word, n)."""
    counted = docs.where(train).select(utf8(F.col(text_col)).alias("text")).mapInArrow(_count_words, "word long, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(np.array([_END_HASH], np.uint64).view(np.int64)[0])
    # How many words are how frequent, in fine steps: a few thousand rows at any size of the corpus.
    step = F.floor(F.log2("n") * 64).alias("step")
    steps = words.where(F.col("word") != end).groupBy(step).count().orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for row in steps:
        if taken + row[1] > head:
            break
        taken, least = taken + row[1], row[0]
    ends = words.where(F.col("word") == end).first()
    frequent = words.where((F.col("word") != end) & (step >= least)).collect() if least is not None else []  # at most ``head``
    return (
        np.array([r[0] for r in frequent], np.int64).view(np.uint64), np.array([r[1] for r in frequent], np.float64),
        int(ends[1]) if ends else 0, int(total), int(kinds), shards,
    ), words


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``base_score`` sums log10((c + ALPHA) / (N + ALPHA * (V + 1))) over the tokens, ``score`` the model's log10 probabilities.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    train = F.coalesce(train, F.lit(False))
    vocabulary, words = vocabulary_of(docs, train, text_col, SHARDS_IN_TASK * parts, head)
    shared = spark.sparkContext.broadcast(vocabulary)  # ``head`` words at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), train.alias("trains"), utf8(F.col(text_col)).alias("text"))
    asked = rows.select("text").mapInArrow(_asker(shared), "word long, shard int").join(words, "word")
    counts = asked.select("shard", "word", "n").mapInArrow(_pack_counts, _ROW)
    routed = rows.mapInArrow(_router(shared), _ROW).unionByName(counts)
    dealt = routed.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "kind", "texts")
    summed = dealt.mapInArrow(_looker(shared), _ROW)
    back = summed.repartition(parts, "texts").sortWithinPartitions("texts", "kind")
    return back.mapInArrow(_gatherer(shared), _RESULT)
