"""A trigram model as a trie: Elias-Fano levels, monotone pointers, and smoothed probabilities from a codebook.

The trie hangs on the word v just before the predicted word w, then on the word u before that:

    v -> w      log10 P(w | v)              v -> u      how much (u, v) leaves to P(w | v)
    v -> u -> w  log10 P(w | u, v)          v           how much v leaves to P(w)

The children of a node are stored behind those of the node before it, as ``place of the parent * IDS + word``. That is
relative to the context (IDS is two to the number of bits that the words of this trie need), and ascends over the whole level, so a level is one Elias-Fano sequence and a child is found by one
search for its successor. Pointers say where the children of each node start.

Smoothing takes ``DISCOUNT`` off each count and gives that, with ``PRIOR`` more, to the next shorter context.
"""

from __future__ import annotations

import mmap

import numpy as np

from loglark.llm.elias_fano import EliasFano

ID_BITS = 18
IDS = 1 << ID_BITS
DISCOUNT = 0.75
PRIOR = 8.0
#: Values in a codebook of log probabilities.
LEVELS = 4096


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): each value as the mean of its quantile, of which there are LEVELS."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(1)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, LEVELS + 1)[1:-1]))
    codes = np.searchsorted(edges, values, "right")
    counts = np.bincount(codes, minlength=len(edges) + 1)
    book = np.bincount(codes, values, len(edges) + 1) / np.maximum(counts, 1)
    return codes.astype(np.uint16), book


def runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the place of each row's value among them) of values that ascend."""
    if not len(ascending):
        return ascending, np.zeros(0, np.int32)
    new = np.append(True, ascending[1:] != ascending[:-1])
    return ascending[new], np.cumsum(new, dtype=np.int32) - np.int32(1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for values in any order, in less memory than np.unique takes."""
    order = np.argsort(values).astype(np.int32)
    found, at = runs(values[order])
    back = np.empty(len(values), np.int32)
    back[order] = at
    return found, back


def smoothed(counts: np.ndarray, group: np.ndarray, groups: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P of each counted word, what each group leaves), given the probability ``lower`` of each word in the shorter context."""
    total = np.bincount(group, counts, groups)
    kinds = np.bincount(group, minlength=groups)
    left = (PRIOR + DISCOUNT * kinds) / (total + PRIOR)
    return (counts - DISCOUNT) / (total[group] + PRIOR) + left[group] * lower, left


class Trie:
    """The levels as arrays over one buffer; see the module."""

    LEVELS = ("contexts", "words", "histories", "words_after", "word_pointers", "history_pointers", "after_pointers")
    TABLES = ("word_codes", "word_book", "left_codes", "left_book", "after_codes", "after_book", "history_codes", "history_book")

    @property
    def _shift(self) -> np.uint64:
        return np.uint64(self.bits)

    @property
    def _low(self) -> np.uint64:
        return np.uint64((1 << self.bits) - 1)

    @classmethod
    def build(cls, bigrams: np.ndarray, bigram_counts: np.ndarray, trigrams: np.ndarray, trigram_counts: np.ndarray,
              unigram: np.ndarray, bits: int = ID_BITS) -> Trie:
        """From sorted distinct keys v * IDS + w and (v * IDS + u) * IDS + w, their counts, and P(w) by word; IDS is 2 ** bits."""
        trie = cls.__new__(cls)
        trie.bits = bits
        shift, low = trie._shift, trie._low
        contexts, of_word = runs(bigrams >> shift)
        p_word, left = smoothed(bigram_counts, of_word, len(contexts), unigram[(bigrams & low).astype(np.int32)])
        pairs, of_after = runs(trigrams >> shift)  # v * IDS + u
        of_pair = np.searchsorted(contexts, pairs >> shift).astype(np.int32)
        shorter = np.searchsorted(bigrams, (trigrams >> (shift * np.uint64(2))) << shift | (trigrams & low))
        p_after, left_pair = smoothed(trigram_counts, of_after, len(pairs), p_word[shorter])
        del shorter
        join = lambda parent, child: parent.astype(np.uint64) << shift | child
        starts = lambda parent, n: np.searchsorted(parent, np.arange(n + 1)).astype(np.uint64)
        sequences = (  # one at a time, as each is as long as the level
            lambda: contexts,
            lambda: join(of_word, bigrams & low),
            lambda: join(of_pair, pairs & low),
            lambda: join(of_after, trigrams & low),
            lambda: starts(of_word, len(contexts)),
            lambda: starts(of_pair, len(contexts)),
            lambda: starts(of_after, len(pairs)),
        )
        for name, values in zip(cls.LEVELS, sequences):
            setattr(trie, name, EliasFano.of(values()))
        for k, values in enumerate((p_word, left, p_after, left_pair)):
            codes, book = quantised(np.log10(values))
            setattr(trie, cls.TABLES[2 * k], codes)
            setattr(trie, cls.TABLES[2 * k + 1], book)
        return trie

    def packed(self) -> bytes:
        """All arrays behind a table of their types and lengths, each aligned to eight bytes."""
        arrays = [a for name in self.LEVELS for a in getattr(self, name).parts] + [getattr(self, t) for t in self.TABLES]
        table = np.array([[len(arrays), self.bits]] + [[ord(a.dtype.char), len(a)] for a in arrays], np.uint64)
        return table.tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @classmethod
    def over(cls, buffer) -> Trie:
        """A trie over a stored one: a mapped file, mapped memory or bytes. Nothing is copied."""
        n, bits = np.frombuffer(buffer, np.uint64, 2).tolist()
        table = np.frombuffer(buffer, np.uint64, 2 * n + 2).reshape(-1, 2)[1:]
        at, arrays = 16 * (n + 1), []
        for kind, length in table.tolist():
            array = np.frombuffer(buffer, chr(kind), length, at)
            arrays.append(array)
            at += array.nbytes + (-array.nbytes % 8)
        trie = cls.__new__(cls)
        trie.bits = bits
        for k, name in enumerate(cls.LEVELS):
            setattr(trie, name, EliasFano.from_parts(arrays[5 * k : 5 * k + 5]))
        for name, array in zip(cls.TABLES, arrays[5 * len(cls.LEVELS) :]):
            setattr(trie, name, array)
        return trie

    def mapped(self) -> Trie:
        """The same trie over mapped memory that no file stands behind."""
        data = self.packed()
        memory = mmap.mmap(-1, len(data))
        memory.write(data)
        return Trie.over(memory)

    def children(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        """The words counted after v, and before it, in order."""
        at = self.contexts.find(np.array([v], np.uint64))[0]
        out = []
        for level, pointers in ((self.words, self.word_pointers), (self.histories, self.history_pointers)):
            start, stop = pointers.values(np.array([at, at + 1])).astype(np.int64) if at >= 0 else (0, 0)
            out.append(level.values(np.arange(start, stop)) & self._low)
        return out[0], out[1]

    def _children(self, level: EliasFano, parents: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Places of the children in ``level``, -1 for none. Rows ascend by (parent, child), rows without a parent aside."""
        found = np.full(len(parents), -1, np.int64)
        known = parents >= 0
        found[known] = level.find(parents[known].astype(np.uint64) << self._shift | child[known])
        return found

    def log10(self, keys: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 P(w | u, v) for ascending distinct keys (v * IDS + u) * IDS + w; ``unigram`` holds log10 P(w)."""
        # In a node's children words ascend for each history anew, so the shorter contexts are looked up once each.
        pairs, of_pair = distinct((keys >> (self._shift * np.uint64(2))) << self._shift | (keys & self._low))
        heads, of_head = runs(pairs >> self._shift)
        pair_context = self.contexts.find(heads)[of_head]
        word = self._children(self.words, pair_context, pairs & self._low)
        shorter = unigram[(pairs & self._low).astype(np.int64)] + np.where(
            pair_context >= 0, self.left_book[self.left_codes[pair_context]] if len(self.left_codes) else 0.0, 0.0
        )
        if len(self.word_codes):
            shorter = np.where(word >= 0, self.word_book[self.word_codes[word]], shorter)
        out = shorter[of_pair]
        del shorter, word, pair_context, pairs, of_pair
        contexts, of_context = runs(keys >> self._shift)  # v * IDS + u
        heads, of_head = runs(contexts >> self._shift)
        history = self._children(self.histories, self.contexts.find(heads)[of_head], contexts & self._low)[of_context]
        after = self._children(self.words_after, history, keys & self._low)
        if len(self.history_codes):
            out = np.where(history >= 0, out + self.history_book[self.history_codes[history]], out)
            out = np.where(after >= 0, self.after_book[self.after_codes[after]], out)
        return out
