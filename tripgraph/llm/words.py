"""Words of whole text batches and their hashes.

A word never crosses a text's end. Words of up to ``SHORT`` bytes are hashed in
blocks of eight bytes, each mixed into two 64-bit states before the next one
(no sum over the bytes, whose structure would let different words collide);
longer ones with BLAKE2b. ``hash`` is the first state; ``check``, the second,
tells words apart where hashes are compared between all texts.
"""

from __future__ import annotations

from functools import cached_property
from hashlib import blake2b

import numpy as np

SHORT = 64
# Words hashed at once.
_PIECE = 1 << 20
# First bytes of a block of eight, by their number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_START = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_STEP = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

# Byte classes: white space, and everything but letters, digits and non-ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_WORD = np.zeros(256, bool)
NON_WORD[0x00:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch: ``start`` and ``end`` (byte places) and ``hash`` and
    ``check`` per word, ``first[i]:first[i + 1]`` the words of text i. A-Z and
    a-z are the same letters to the hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self._data = data
        inside = ~separators[LOWER[data]]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        begin = offsets[:-1][offsets[:-1] < len(data)]
        edge[begin] = inside[begin]
        self.start = np.flatnonzero(edge)
        edge[:] = inside
        edge[:-1] &= ~inside[1:]
        stop = offsets[1:][offsets[1:] > 0] - 1
        edge[stop] = inside[stop]
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.start, offsets)

    @cached_property
    def _both(self) -> np.ndarray:
        out = np.empty((2, len(self.start)), np.uint64)
        low = np.concatenate((LOWER[self._data], np.zeros(8, np.uint8)))
        block = np.ndarray((len(self._data) + 1,), "<u8", low, strides=(1,))
        for a in range(0, len(self.start), _PIECE):
            self._hash(out[:, a : a + _PIECE], block, self.start[a : a + _PIECE], self.end[a : a + _PIECE])
        for k in np.flatnonzero(self.end - self.start > SHORT):
            out[:, k] = np.frombuffer(blake2b(low[self.start[k] : self.end[k]], digest_size=16).digest(), np.uint64)
        return out

    @staticmethod
    def _hash(out: np.ndarray, block: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = np.minimum(end - start, SHORT)
        out[:] = _START[:, None] * (size + 1).astype(np.uint64)
        at = np.arange(len(start))
        for done in range(0, SHORT, 8):
            at = at[size[at] > done] if done else at
            if not len(at):
                break
            eight = block[start[at] + done] & _KEEP[np.minimum(size[at] - done, 8)]
            for state, step in zip(out, _STEP):
                state[at] = mix((state[at] ^ eight) * step + np.uint64(done))

    @property
    def hash(self) -> np.ndarray:
        return self._both[0]

    @property
    def check(self) -> np.ndarray:
        return self._both[1]

    def of(self, i: int) -> np.ndarray:
        """``hash`` and ``check`` of the words of text i, one row each."""
        return self._both[:, self.first[i] : self.first[i + 1]]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes of one sequence; with
    fewer words (but some), the whole sequence as one."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n] + np.uint64(k)
    for j in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : j + n]
    return mix(out)
