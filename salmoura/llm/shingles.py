"""Word shingles of texts as 64-bit hashes, computed for many texts at once.

Words are maximal runs of bytes other than blank and the controls 9 to 13, with A-Z lower-cased. A word's
hash is a polynomial in its bytes, a shingle mixes the hashes of its words. A text with fewer words than a shingle needs has one shingle of all its words; a text without
words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[0x41:0x5B] += 32
BATCH_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base, as many as the longest word so far has bytes."""

    table = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            factors = np.full(2 * n, _BASE, np.uint64)
            factors[0] = 1
            cls.table = np.cumprod(factors, dtype=np.uint64)
        return cls.table


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the place of each text's first word (one more at the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, ends)
    if not len(starts):
        return np.empty(0, np.uint64), first
    place = np.zeros(len(data), np.int64)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data)), place, out=place)  # of each byte in its word
    place[blank] = 0
    terms = _CODE[data]
    terms *= _Powers.upto(int(place.max()) + 1)[place]
    terms[blank] = 0
    return mixed(np.add.reduceat(terms, starts)), first


def shingle_sets(texts: Sequence[str | None], words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(encoded):  # groups of texts; a longer text is a group of its own
        end, size = at, 0
        while end < len(encoded) and (end == at or size + len(encoded[end]) <= BATCH_BYTES):
            size += len(encoded[end])
            end += 1
        hashes, first = word_hashes(encoded[at:end])
        weights = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        whole = len(hashes) - words + 1
        if whole > 0:
            joined = sum(hashes[i : i + whole] * weights[i] for i in range(words))
            joined = mixed(joined)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                short = np.sum(hashes[a:b] * weights[: b - a], dtype=np.uint64, keepdims=True)
                yield mixed(short + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
        at = end
