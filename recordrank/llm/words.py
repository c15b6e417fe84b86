"""Vectorised word hashing over Arrow text columns, shared by the text operators.

A whole slice of documents is tokenised as one byte buffer: no Python object is made for a word. Lower-casing
touches A-Z only. A null text has no words. Slices hold about ``SLICE`` bytes, and a longer document forms a slice
of its own, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes that separate words: white space, or all of ASCII but digits and letters (as seen after lower-casing).
SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
PUNCT = (_BYTES < 128) & ~(((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)))
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _BASE, dtype=np.uint64))


class Slice:
    """Words of consecutive documents: ``start`` and ``end`` are byte places in ``data``, ``first[i]:first[i+1]`` the words of document i."""

    __slots__ = ("at", "data", "end", "first", "n_docs", "off", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, at: int, separates: np.ndarray):
        self.data, self.off, self.at, self.n_docs = LOWER[data], off, at, len(off) - 1
        inside = ~separates[self.data]
        n = len(inside)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = off[:-1][off[:-1] < n]
            before[cut] = False
            after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, *lengths: int) -> list[np.ndarray]:
        """A 64-bit hash of each whole word, then for each length of the word's first bytes."""
        if not len(self.start):
            return [np.zeros(0, np.uint64)] * (1 + len(lengths))
        size = self.end - self.start
        where = np.arange(self.start[0], len(self.data))
        place = where - np.repeat(self.start, np.diff(np.append(self.start, len(self.data))))
        value = _RANDOM[self.data[self.start[0] :]] * powers(int(place.max()) + 1)[place]
        value[place >= np.repeat(size, np.diff(np.append(self.start, len(self.data))))] = 0
        cuts = self.start - self.start[0]
        out = [mix(np.add.reduceat(value, cuts) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))]
        for k in lengths:
            short = np.where(place < k, value, np.uint64(0))
            out.append(mix(np.add.reduceat(short, cuts) + np.uint64(k)))
        return out


def slices(texts: pa.Array, separates: np.ndarray = SPACE, bytes_at_once: int = SLICE) -> Iterator[Slice]:
    """Consecutive slices of a string column; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + bytes_at_once, "right")) - 1)
        yield Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], i, separates)
        i = j


_SHINGLE = np.random.default_rng(77).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def shingles(part: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles, sorted within each document, and their bounds by document.

    A document of fewer words than ``width``, but not none, has its whole sequence as its one shingle.
    """
    words, n = part.hashes()[0], part.counts
    have = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(have)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    begin = np.repeat(part.first[:-1] - bounds[:-1], have) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(n, width), have)
    total = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(width):
        ok = k < size
        total[ok] += mix(words[begin[ok] + k] * _SHINGLE[k % 8] + np.uint64(k))
    total = mix(total)
    keep = np.ones(len(total), bool)
    for i in np.flatnonzero(have > 1):
        a, b = bounds[i], bounds[i + 1]
        total[a:b].sort()
    keep[1:] = total[1:] != total[:-1]
    keep[bounds[:-1][have > 0]] = True
    doc = np.repeat(np.arange(part.n_docs), have)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=part.n_docs))])
    return total[keep], bounds
