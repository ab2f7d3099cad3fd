"""Hashes of the words of many texts at once, in whole arrays of bytes.

A word is a run of anything but ASCII white space.  Its hash is a polynomial in a
fixed odd base over a table of numbers for its bytes, modulo 2 ** 64, scrambled
at the end.  No word becomes a Python object, so the cost is a few array
operations for each byte of text, whatever the number of distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are cut into words at once, a longer text by itself.
CHUNK_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A scrambling of 64-bit numbers, one to one for each salt."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base, as many as the longest word so far needs."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.up):
            self.up = np.full(max(n, 1024), _BASE, np.uint64)
            self.up[0] = 1
            self.up = np.multiply.accumulate(self.up)
        return self.up


_POWERS = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many words each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = ~_WHITE[data]
    turns = np.flatnonzero(np.diff(word, prepend=False))
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    letters = data[word]
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(begins, sizes)
    values = _TABLE[letters] * _POWERS.upto(int(sizes.max()))[place]
    return mixed(np.add.reduceat(values, begins)), counts


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in parts of some bytes, with the number of the first."""
    part, size, first = [], 0, 0
    for k, value in enumerate(texts):
        text = value.as_py() or b""
        if part and size + len(text) > CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, k
        part.append(text)
        size += len(text)
    if part:
        yield first, part
