"""Monotone sequences of integers in Elias-Fano form: low bits packed side by side, high bits as gaps in unary.

About two bits for each value beyond the logarithm of the mean gap. Values are decoded in blocks of ``BLOCK``; the first bit
and the first value of each block are kept, so a search decodes only the blocks it ends up in. All parts are plain arrays
over one buffer, so a stored sequence can be used where it lies, be it a mapped file or mapped memory.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096


class EliasFano:
    """Built by ``EliasFano.of(values)``; ``parts`` are the arrays to store."""

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray, starts: np.ndarray, firsts: np.ndarray):
        self.size, self.width = size, width
        self.low, self.high, self.starts, self.firsts = low, high, starts, firsts

    @property
    def parts(self) -> list[np.ndarray]:
        return [np.array([self.size, self.width], np.uint64), self.low, self.high, self.starts, self.firsts]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(bits[-1]) + 1 if n else 0, bool)
        flags[bits] = True
        high = np.packbits(flags, bitorder="little")
        low = []
        for at in range(0, n if width else 0, BLOCK):
            own = values[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
            low.append(np.packbits(np.unpackbits(own, axis=1, count=width, bitorder="little"), bitorder="little"))
        return cls(
            n, width, np.concatenate(low) if low else np.zeros(0, np.uint8), high, bits[::BLOCK].astype(np.uint64),
            values[::BLOCK].copy(),
        )

    def block(self, k: int) -> np.ndarray:
        """Values ``k * BLOCK`` and following, BLOCK of them at most."""
        count = min(BLOCK, self.size - k * BLOCK)
        start = int(self.starts[k])
        stop = int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : (stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[start & 7 :])[:count] + start
        out = (ones - np.arange(k * BLOCK, k * BLOCK + count)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = k * BLOCK * self.width // 8
            packed = self.low[at : at + (count * self.width + 7) // 8]
            low = np.zeros((count, 64), np.uint8)
            low[:, : self.width] = np.unpackbits(packed, bitorder="little")[: count * self.width].reshape(count, self.width)
            out |= np.packbits(low, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at the places ``at``, which ascend."""
        out = np.zeros(len(at), np.uint64)
        cuts = np.searchsorted(at, np.arange(len(self.starts) + 1) * BLOCK)
        for k in range(len(self.starts)):
            if cuts[k] < cuts[k + 1]:
                out[cuts[k] : cuts[k + 1]] = self.block(k)[at[cuts[k] : cuts[k + 1]] - k * BLOCK]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each of ``values``, which ascend; -1 where it is not in the sequence. Values must not repeat in it."""
        out = np.full(len(values), -1, np.int64)
        if not self.size:
            return out
        cuts = np.append(np.searchsorted(values, self.firsts), len(values))
        for k in range(len(self.firsts)):
            if cuts[k] < cuts[k + 1]:
                own, asked = self.block(k), values[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(own, asked), len(own) - 1)  # the successor of each within the block
                out[cuts[k] : cuts[k + 1]] = np.where(own[at] == asked, at + k * BLOCK, -1)
        return out
