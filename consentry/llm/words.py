"""Words and word sequences as 64-bit numbers, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose numbers a worker remembers.
REMEMBERED = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Numbers(dict):
    """Word to number; numbers of words beyond the remembered ones are computed each time."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_NUMBERS = _Numbers()


def numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of all texts in a row, and where each text starts (and the end)."""
    get = _NUMBERS.__getitem__
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    out = np.fromiter((get(w) for t in texts for w in t), np.uint64, int(starts[-1]))
    return out, starts


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """The number of every run of ``size`` words, by where it starts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size)) * _ODD2
    for k in range(size):
        out = (out ^ words[k:k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return mix(out)
