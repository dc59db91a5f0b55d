"""Ids of whole texts from a bounded memory of units, with numpy.

The splitting pattern never joins certain neighbouring characters in one piece: a space that a non-space follows
begins a piece; a letter, a digit and a punctuation mark other than the apostrophe stay apart; and white space
never follows another character in its piece. Texts are cut there into units, which repeat a lot. A unit's hash finds its
place in the memory, its bytes are compared with those kept there, so equal hashes never give wrong ids,
and the ids of all units of a block are gathered at once. Units that aren't remembered go to the encoder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from apotheca.llm import textarrays as ta

#: Classes of bytes: letters, digits, marks, white space, a space; others are never cut at.
_OTHER, _LETTER, _DIGIT, _MARK, _BLANK, _SPACE = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[c for c in range(0x21, 0x7F)]] = _MARK
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_CLASS[[ord(c) for c in "0123456789"]] = _DIGIT
_CLASS[0x27] = _OTHER
_CLASS[0x09:0x0E] = _BLANK
_CLASS[0x20] = _SPACE
#: First bytes of two-byte characters that are letters, all but two of those of 0xC3.
_LETTER_LEADS = (0xC3, 0xC4, 0xC5)
#: Whether a unit ends between two classes.
_CUTS = np.zeros((6, 6), dtype=bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_DIGIT, _LETTER), (_DIGIT, _MARK)):
    _CUTS[_a, _b] = True
for _a in (_LETTER, _DIGIT, _MARK):
    _CUTS[_a, _BLANK] = _CUTS[_a, _SPACE] = True
#: Bytes that surely begin a character other than white space; of the other leads some do.
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = _SOLID[0xE4:] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, in texts that lie end to end; every text begins with a unit, if it has any bytes."""
    n = len(data)
    kind = _CLASS[data]
    for lead in _LETTER_LEADS:
        at = np.flatnonzero(data[:-1] == lead) if n else []
        if len(at):
            at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)] if lead == 0xC3 else at
            kind[at] = kind[at + 1] = _LETTER
    start = np.zeros(n + 1, dtype=bool)
    if n:
        start[1:n] = _CUTS[kind[:-1], kind[1:]]
        # A space that ends a text doesn't begin a unit because of what the next text begins with.
        inside = kind == _SPACE
        inside[offsets[1:][offsets[1:] > 0] - 1] = False
        spaces = np.flatnonzero(inside)
        after = data[spaces + 1]
        solid = _SOLID[after]
        odd = np.flatnonzero((after == 0xC2) | (after == 0xE2))
        if len(odd):
            padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
            second, third = padded[spaces[odd] + 2], padded[spaces[odd] + 3]
            solid[odd] = np.where(after[odd] == 0xC2, (second != 0x85) & (second != 0xA0), (second > 0x81) | ((second == 0x80) & (third >= 0x90) & (third <= 0xA7)))
        start[spaces] |= solid
    start[offsets] = True
    return np.flatnonzero(start[:n])


class UnitMemory:
    """encode_units: from units end to end and their sizes to their ids, and how many each has. most, most_bytes: what is remembered; beyond that, units
    that weren't met again, or are longer than ``LONG`` bytes, are forgotten, and if that isn't half, all are.
    """

    LONG = 64

    def __init__(self, encode_units: Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000, most_bytes: int = 32 << 20):
        self.encode_units, self.most, self.most_bytes = encode_units, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self._slots(max(10, int(2 * self.most - 1).bit_length()))
        self.hashes, self.again = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=bool)
        self.text_at, self.ids_at = np.zeros(1025, dtype=np.int64), np.zeros(1025, dtype=np.int64)
        self.text, self.ids = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint32)

    def _slots(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.rows = np.zeros(1 << bits, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        found = np.full(len(hashes), -1, dtype=np.int32)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            key = self.keys[at]
            hit = key == hashes[open_]
            found[open_[hit]] = self.rows[at[hit]]
            on = ~hit & (key != 0)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return found

    def _place(self, hashes: np.ndarray, first: int) -> None:
        """Give distinct new hashes the rows from ``first`` on; a block of very many units widens the table."""
        bits = int(2 * (first + len(hashes)) - 1).bit_length() if first + len(hashes) else 0
        if bits > self.bits:
            self._slots(bits)
            known, rows = np.unique(self.hashes[: self.count], return_index=True)
            self._put(known, rows.astype(np.int32))
        self._put(hashes, np.arange(first, first + len(hashes), dtype=np.int32))

    def _put(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[open_[free]]
            won = free & (self.keys[at] == hashes[open_])
            self.rows[at[won]] = rows[open_[won]]
            open_, at = open_[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
        out[: len(array)] = array
        return out

    def _append(self, texts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        new, end = len(sizes), self.count + len(sizes)
        for name, size in (("hashes", end), ("again", end), ("text_at", end + 1), ("ids_at", end + 1), ("text", self.text_at[self.count] + len(texts)), ("ids", self.ids_at[self.count] + len(ids))):
            setattr(self, name, self._room(getattr(self, name), int(size)))
        self.text[self.text_at[self.count] :][: len(texts)] = texts
        self.ids[self.ids_at[self.count] :][: len(ids)] = ids
        self.text_at[self.count + 1 : end + 1] = self.text_at[self.count] + np.cumsum(sizes)
        self.ids_at[self.count + 1 : end + 1] = self.ids_at[self.count] + np.cumsum(counts)
        self.hashes[self.count : end] = hashes
        self.again[self.count : end] = False
        self.count += new

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        texts = gather(data, starts, sizes)
        self._append(texts, sizes, *self.encode_units(texts.tobytes(), sizes), hashes)

    def _forget(self) -> None:
        n = self.count
        sizes, counts = np.diff(self.text_at[: n + 1]), np.diff(self.ids_at[: n + 1])
        kept = np.flatnonzero(self.again[:n] & (sizes <= self.LONG))
        kept = kept[np.unique(self.hashes[kept], return_index=True)[1]]
        if 2 * len(kept) > self.most or 2 * sizes[kept].sum() > self.most_bytes:
            kept = kept[:0]
        text, ids = (gather_slowly(pool, at[kept], size[kept]) for pool, at, size in ((self.text, self.text_at, sizes), (self.ids, self.ids_at, counts)))
        hashes = self.hashes[kept]
        self._clear()
        self._append(text, sizes[kept], ids, counts[kept], hashes)
        self._place(hashes, 0)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        starts = unit_starts(data, offsets)
        sizes = np.diff(starts, append=len(data))
        hashes = ta.range_hashes(data, starts, starts + sizes) | np.uint64(1) if len(starts) else np.empty(0, dtype=np.uint64)
        rows = self._find(hashes)
        self.again[rows[rows >= 0]] = True
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            distinct, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows[missing] = self.count + back
            self._place(distinct, self.count)
            self._learn(data, starts[missing[first]], sizes[missing[first]], distinct)
        wrong = np.flatnonzero(self.text_at[rows + 1] - self.text_at[rows] != sizes)
        if not len(wrong):
            same = gather(self.text, self.text_at[rows], sizes) == data
            wrong = np.flatnonzero(~np.logical_and.reduceat(same, starts)) if not same.all() else wrong
        else:
            wrong = np.array([k for k in range(len(rows)) if not np.array_equal(self.text[self.text_at[rows[k]] : self.text_at[rows[k] + 1]], data[starts[k] : starts[k] + sizes[k]])])
        if len(wrong):  # another unit has the same hash
            rows[wrong] = self.count + np.arange(len(wrong))
            self._learn(data, starts[wrong], sizes[wrong], hashes[wrong])
        counts = self.ids_at[rows + 1] - self.ids_at[rows]
        ids = gather(self.ids, self.ids_at[rows], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        if self.count > self.most or self.text_at[self.count] > self.most_bytes:
            self._forget()
        return ids, ends


def begin_with_space(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which units are a space and more, so that nothing before them can change their ids."""
    at = np.cumsum(sizes) - sizes
    out = sizes > 1
    out[out] = (texts[at[out]] == 0x20) & _SOLID[texts[at[out] + 1]]
    return out


def gather(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[at : at + size] for every range, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def gather_slowly(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray, ranges: int = 1 << 14) -> np.ndarray:
    """The same as ``gather`` for very many ranges: the positions, 8 bytes for each one gathered, are held for so many ranges at once."""
    out, end = np.empty(int(sizes.sum()), dtype=pool.dtype), 0
    for k in range(0, len(at), ranges):
        part = gather(pool, at[k : k + ranges], sizes[k : k + ranges])
        out[end : end + len(part)] = part
        end += len(part)
    return out
