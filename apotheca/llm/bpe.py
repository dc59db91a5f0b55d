"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one valid encoding, so it is enough to store its last token.
The last token of a prefix is the one token that ends there, whose rest is a shorter prefix, and that is
compatible with that prefix's last token; two tokens are compatible if BPE leaves them apart. Appending a byte
therefore only adds an entry, and an edit only changes the entries after it up to the next piece that stays.

Texts are first cut where the splitting pattern always begins a piece (see ``units``); these units repeat a lot, and
each task keeps the ids of a bounded number of them.

Defined results: a null or empty text has no ids and decodes to no bytes. Texts are never cut short. No special tokens
exist: their spellings are ordinary text. Rows are independent, so repeated rows and null ids are no case apart, and
an empty table gives an empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.units import UnitMemory


class Vocabulary:
    """Tokens of a .tiktoken file, and what the dynamic programming asks about them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.endings: dict[bytes, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                self.endings.setdefault(token[i:], -1)
        self.endings |= self.ranks
        self.pattern = regex.compile(pattern)
        self._apart: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """BPE by its definition: the pair of the lowest rank is merged until none can be."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens as they are when one follows the other."""
        key = left << 32 | right
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            found = self._apart[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Add the last tokens of the prefixes that ``last`` doesn't have yet; last[0] stands for the empty one."""
        endings, apart, known = self.endings, self.apart, self._apart.get
        for end in range(len(last), len(piece) + 1):
            start = end - 1
            while True:
                token = endings[piece[start:end]]
                if token >= 0:
                    if not start:
                        break
                    found = known(last[start] << 32 | token)
                    if found or (found is None and apart(last[start], token)):
                        break
                start -= 1
            last.append(token)

    def read_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = [-1]
        self.extend(piece, last)
        return self.read_back(last)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def encode_units(self, texts: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that lie end to end, and how many each has."""
        ends = np.cumsum(sizes).tolist()
        ids = [self.encode(texts[a:b].decode()) for a, b in pairwise([0, *ends])]
        return np.array(list(chain.from_iterable(ids)), dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class LiveEncoding:
    """A text with the prefix tables of its pieces, kept exact under appends and edits."""

    #: How many characters beyond its end the pattern may have looked at to settle a piece.
    LOOK = 3

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.tables: list[tuple[str, list[int]]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; only pieces near it are split and encoded again."""
        shift = len(new) - (end - start)
        keep = max(0, bisect_left([s + len(p) + self.LOOK for s, (p, _) in zip(self.starts, self.tables, strict=True)], start + 1) - 1) if self.starts else 0
        old_starts, old_tables = self.starts, self.tables
        self.text = self.text[:start] + new + self.text[end:]
        begin = old_starts[keep] if keep < len(old_starts) else 0
        starts, tables, back = [], [], len(old_starts)
        for match in self.vocabulary.pattern.finditer(self.text, begin):
            at = match.start()
            if at >= start + len(new):
                same = bisect_left(old_starts, at - shift)
                if same < len(old_starts) and old_starts[same] == at - shift:
                    back = same
                    break
            piece = match.group()
            reuse = keep + len(tables)
            last = [-1]
            if reuse < len(old_tables):
                same_bytes = len(_common(old_tables[reuse][0], piece).encode())
                last = old_tables[reuse][1][: same_bytes + 1]
            self.vocabulary.extend(piece.encode(), last)
            starts.append(at)
            tables.append((piece, last))
        self.starts = old_starts[:keep] + starts + [s + shift for s in old_starts[back:]]
        self.tables = old_tables[:keep] + tables + old_tables[back:]

    def ids(self) -> list[int]:
        return [i for _, last in self.tables for i in self.vocabulary.read_back(last)]

    def count_until(self, position: int) -> int:
        """Number of tokens of the pieces that begin before a position."""
        return sum(len(self.vocabulary.read_back(last)) for _, last in self.tables[: bisect_right(self.starts, position - 1)])


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path, pattern)


@lru_cache(maxsize=2)
def _memory(path: str, pattern: str) -> UnitMemory:
    return UnitMemory(vocabulary(path, pattern).encode_units)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (little-endian unsigned 32-bit integers as binary) of every row. Nothing is shuffled.

    path: the ranks, a file that every executor has. pattern: what splits texts into pieces.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in ta.byte_ranges(batch.column(1)):
                ids, ends = _memory(path, pattern).encode(data, offsets)
                lists = pa.BinaryArray.from_buffers(pa.binary(), end - row, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and the bytes that the ids stand for; an id outside the vocabulary is an error. null ids: no bytes."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = vocabulary(path, pattern)
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                decoded = [words.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
