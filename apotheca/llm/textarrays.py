"""Whole texts as numpy arrays: words, lines and their hashes, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, and a line is what stands between two \\n.
These separators are single bytes in UTF-8, so all splitting is done on bytes and no Python string is
made. Texts are taken in blocks of about ``BLOCK_BYTES``; a longer text is a block of its own, so memory
is bounded by the longest text and never by the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_DOC = np.uint64(0xA0761D6478BD642F)


def _powers(base: int, n: int, cache: dict[int, np.ndarray]) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; only the usual block length is kept."""
    if n <= BLOCK_BYTES + 1:
        if base not in cache:
            cache[base] = _cumulative(base, BLOCK_BYTES + 1)
        return cache[base][:n]
    return _cumulative(base, n)


def _cumulative(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every input bit reaches every output bit."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling polynomial hash of values[start:end] for many short ranges of hashes: two lookups in one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n, _POWERS), out=total[1:])
    inverse = _powers(pow(base, -1, 2**64), n + 1, _POWERS)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _LENGTH)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order; no polynomial, so which texts collide follows from no structure of them."""
    return mix(left * _NEXT + right)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of bytes: of eight bytes each at first, then of neighbouring hashes two by two, and of the length."""
    sizes = np.asarray(ends - starts, dtype=np.int64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    counts = np.maximum((sizes + 7) >> 3, 1)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    rest = np.minimum(np.repeat(sizes, counts) - 8 * nth, 8)
    mask = np.where(rest > 0, np.uint64(2**64 - 1) >> ((8 - np.maximum(rest, 1)) * 8).astype(np.uint64), np.uint64(0))
    parts = mix(eight[np.repeat(np.asarray(starts, dtype=np.int64), counts) + 8 * nth] & mask)
    out = parts[np.cumsum(counts) - counts]
    long = np.flatnonzero(counts > 1)
    parts, counts = parts[np.repeat(counts > 1, counts)], counts[long]
    while len(counts) and counts.max() > 1:
        halves = (counts + 1) >> 1
        nth = 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
        at = np.repeat(np.cumsum(counts) - counts, halves) + nth
        two = nth + 1 < np.repeat(counts, halves)
        after = parts[at]
        after[two] = _joined(after[two], parts[at[two] + 1])
        parts, counts = after, halves
    out[long] = parts
    return mix(out ^ (sizes.astype(np.uint64) * _LENGTH))


@dataclass
class Texts:
    """Consecutive texts of one block. Offsets, starts and ends are byte positions in ``data``."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        n, self.n = len(self.data), len(self.offsets) - 1
        space = _SPACE[self.data]
        before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
        before[1:], after[: max(n - 1, 0)] = space, space[1:]
        before[self.offsets] = True
        after[self.offsets[self.offsets > 0] - 1] = True
        self.word_start = np.flatnonzero(~space & before[:n])
        self.word_end = np.flatnonzero(~space & after[:n]) + 1
        self.word_doc = np.searchsorted(self.offsets, self.word_start, side="right") - 1
        self.space = space

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights=weights, minlength=self.n)[: self.n]

    def running(self, mask: np.ndarray) -> np.ndarray:
        """Running count with a leading zero: running[end] - running[start] counts mask in a range."""
        out = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def word_hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.word_start, self.word_end)

    def word_chars(self) -> np.ndarray:
        """Code points of every word."""
        chars = self.running(_STARTS_CHAR[self.data])
        return chars[self.word_end] - chars[self.word_start]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all \\n-split lines that have a word."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, breaks, side="right") - 1])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.ones(len(doc), dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        ends[last] = self.offsets[1:][doc[last]]
        ink = self.running(~self.space)
        has_word = ink[ends] > ink[starts]
        return starts[has_word], ends[has_word], doc[has_word]

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return range_hashes(self.data, starts, ends)

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and rolling hash of every window of n words that lies in one document."""
        at = np.arange(max(len(words) - n + 1, 0))
        at = at[self.word_doc[at] == self.word_doc[at + n - 1]] if len(at) else at
        return at, _ranges(words, _WORD_BASE, at, at + n)


def in_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal things of one and the same document."""
    return mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * _DOC)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key: whether it occurs twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice


def seen_before(keys: np.ndarray) -> np.ndarray:
    """For each key: whether it occurs at an earlier position."""
    order = np.argsort(keys, kind="stable")
    earlier = np.zeros(len(keys), dtype=bool)
    earlier[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return earlier


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Positions that lie in any window start ... start + n - 1."""
    steps = np.bincount(starts, minlength=length + 1) - np.bincount(starts + n, minlength=length + 1)
    return np.cumsum(steps[:length]) > 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null is the empty text."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_ranges(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over the column, in blocks of about ``limit`` bytes and whole texts."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over the column, in blocks of about ``limit`` bytes and whole texts."""
    for row, end, data, offsets in byte_ranges(column, limit):
        yield row, end, Texts(data, offsets)


def text_ranges(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts as Python strings) in blocks of about ``limit`` bytes and whole texts."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    row, before = 0, 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield row, end, column.slice(row, end - row).to_pylist()
        row, before = end, int(ends[end - 1])
