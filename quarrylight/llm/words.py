"""Vectorised word splitting and hashing of whole Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.  Nulls count as empty texts.  A text column is cut into
row ranges of a few MB, so memory stays bounded however many rows an Arrow batch holds; one text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.arange(256) < 128
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of the rows [first, last) of a column. bounds: word offsets by row."""

    first: int
    last: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    h = np.full(len(start), 0x1234567, dtype=np.uint64)
    live, pos, length = np.arange(len(start)), start.copy(), end - start
    step = 0
    while len(live):
        h[live] = h[live] * _PRIME + _TABLE[buf[pos]]
        step += 1
        keep = length > step
        live, pos, length = live[keep], pos[keep] + 1, length[keep]
        if step == _LONG:
            for i in live:
                h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
            break
    return mix(h)


def words(col: pa.Array, limit: int = SLICE_BYTES, hashed: bool = True, plain: bool = False) -> Iterator[Words]:
    """The words of a text column, a row range at a time.

    plain: all letters are lower-cased and every ASCII character but letters and digits parts words.
    """
    if plain:
        col = pc.utf8_lower(col)
    space = _PUNCTUATION if plain else _SPACE
    data, off = text_buffers(col)
    for i, j in row_slices(off, limit):
        lo, hi = int(off[i]), int(off[j])
        buf = _LOWER[data[lo:hi]]
        own = off[i : j + 1] - lo
        ink = ~space[buf]
        before = np.zeros(len(ink) + 1, dtype=bool)
        before[1:] = ink
        before[own] = False  # a row's first byte has nothing before it
        after = np.zeros(len(ink) + 1, dtype=bool)
        after[:-1] = ink
        after[own] = False  # after a row's last byte comes nothing
        start = np.flatnonzero(ink & ~before[:-1])
        end = np.flatnonzero(ink & ~after[1:]) + 1
        yield Words(i, j, buf, start, end, np.searchsorted(start, own), hash_spans(buf, start, end) if hashed else np.zeros(0, np.uint64))


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every row in order, and their offsets by row.

    A row of fewer than n words, but one at least, has its whole sequence as its only n-gram.
    """
    count = np.diff(bounds)
    has = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate([[0], np.cumsum(has)])
    if not len(h):
        return np.zeros(0, np.uint64), offsets
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    acc = np.zeros(len(h), np.uint64)
    for k in range(n):
        acc = mix(acc + padded[k : k + len(h)] + np.uint64((k + 1) * int(_PRIME) % (1 << 64)))
    first = np.repeat(bounds[:-1], has) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], has))
    out = acc[first]
    for r in np.flatnonzero((count > 0) & (count < n)):
        v = np.uint64(0)
        for x in h[bounds[r] : bounds[r + 1]]:
            v = mix(np.array([v ^ x], np.uint64) * _PRIME)[0]
        out[offsets[r]] = v ^ np.uint64(count[r])
    return out, offsets


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
