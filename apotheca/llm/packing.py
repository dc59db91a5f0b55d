"""Harmonic packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into pieces: full sequences first, then halves, quarters and eighths of a sequence as
they fit, and a rest shorter than an eighth. A piece of length n belongs to the reciprocal class
k = capacity // n, and a bin of class k is filled with exactly k pieces, so no search is
needed and every worker fills its own bins. Halves, quarters and eighths fill their bins without a gap; a rest
wastes at most capacity / k - n.

When a worker's input ends, it holds fewer than k pieces of each class k, less than a sequence for each of at most
2 * sqrt(capacity) classes. They are laid end to end
and cut into full sequences, and what remains into sequences whose lengths are powers of two, so that they
need no padding.

Defined results: a null or empty text is the end id alone. The spelling of an added token in a text, such as
<|endoftext|>, is that token, as the library has it. Rows that repeat an id, or are equal, are packed each by itself, in
the order in which they come. An empty table gives an empty result. Only the id and the text are read, so other
columns can't clash, whatever their names. sequence_id is the number of the
partition times 2 ** 40 plus a count, so it is unique, and the same again if a lost task is repeated.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.units import UnitMemory, begin_with_space, gather

#: doc_id, start, length, doc_tokens, ids
Piece = tuple[object, int, int, int, bytes]


class Encoder:
    """The library's ids of whole texts, by units that are remembered (see ``units``).

    Units that begin with a space are encoded many at a time, as one text, and the ids are dealt back by the
    number of their bytes; others one by one. Texts that hold an added token's spelling, such as <|endoftext|>,
    are encoded whole.
    """

    AT_ONCE = 200

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, rank in self.tokenizer.get_vocab().items():
            self.token_bytes[rank] = len(token)
        self.memory = UnitMemory(self.encode_units, most)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, texts: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, starts = np.frombuffer(texts, dtype=np.uint8), np.cumsum(sizes) - sizes
        spaced = begin_with_space(raw, sizes)
        joined, ends = gather(raw, starts[spaced], sizes[spaced]).tobytes(), np.cumsum(sizes[spaced])
        cuts = [0, *ends[self.AT_ONCE - 1 :: self.AT_ONCE].tolist(), len(joined)]
        ids = np.concatenate(self.plain([joined[a:b].decode() for a, b in itertools.pairwise(cuts)]))
        counts = np.zeros(len(sizes), dtype=np.int64)
        counts[spaced] = np.diff(np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1, prepend=0)
        single = self.plain([texts[a : a + n].decode() for a, n in zip(starts[~spaced].tolist(), sizes[~spaced].tolist(), strict=True)])
        counts[~spaced] = [len(x) for x in single]
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        at = np.empty(len(sizes), dtype=np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return gather(np.concatenate([ids, *single]), at, counts), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each of the texts that lie end to end, as little-endian unsigned 32-bit integers."""
        ids, ends = self.memory.encode(data, offsets)
        raw, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        whole = data.tobytes() if self.added else b""
        if any(word in whole for word in self.added):
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(word in whole[a:b] for word in self.added):
                    out[k] = self.plain([whole[a:b].decode()])[0].astype("<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    for part in (2, 4, 8):
        size = capacity // part
        if size and rest >= size:
            lengths.append(size)
            rest -= size
    return lengths + [rest] * (rest > 0)


class Worker:
    """The open bins of one worker."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list[Piece]] = {}

    def _close(self, pieces: list[Piece]) -> list[tuple[Piece, int, int]]:
        out, offset = [], 0
        for piece in pieces:
            out.append((piece, self.sequence, offset))
            offset += piece[2]
        self.sequence += 1
        return out

    def add(self, doc_id: object, ids: bytes) -> list[tuple[Piece, int, int]]:
        """Take a document; the placed pieces (piece, sequence, offset) of the bins that this fills."""
        out, start, total = [], 0, len(ids) // 4
        for length in cut(total, self.capacity):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)]))
            start += length
            if len(bin_) == k:
                out += self._close(self.open.pop(k))
        return out

    def finish(self) -> list[tuple[Piece, int, int]]:
        """Place what is left in full sequences and in sequences of powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]][::-1]
        rest, out = sum(piece[2] for piece in left), []
        while rest:
            room = min(self.capacity, 1 << (rest.bit_length() - 1)) if rest < self.capacity else self.capacity
            rest -= room
            taken: list[Piece] = []
            while room:
                doc_id, start, length, total, ids = left.pop()
                if length > room:
                    left.append((doc_id, start + room, length - room, total, ids[4 * room :]))
                    length, ids = room, ids[: 4 * room]
                taken.append((doc_id, start, length, total, ids))
                room -= length
            out += self._close(taken)
        self.open = {}
        return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    path: a tokenizer file that every executor has. end_id follows each document. One narrow pass.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    end = int(end_id).to_bytes(4, "little")

    def rows(placed: list[tuple[Piece, int, int]], id_type: pa.DataType) -> pa.RecordBatch:
        column = lambda values, kind: pa.array(values, kind)
        return pa.RecordBatch.from_arrays(
            [
                column([p[0] for p, _, _ in placed], id_type),
                column([p[1] for p, _, _ in placed], pa.int64()),
                column([p[2] for p, _, _ in placed], pa.int64()),
                column([p[4] for p, _, _ in placed], pa.binary()),
                column([p[3] for p, _, _ in placed], pa.int64()),
                column([s for _, s, _ in placed], pa.int64()),
                column([o for _, _, o in placed], pa.int64()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker(capacity, TaskContext.get().partitionId() << 40)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row, stop, data, offsets in ta.byte_ranges(batch.column(1)):
                placed = []
                for doc_id, ids in zip(batch.column(0).slice(row, stop - row).to_pylist(), _encoder(path).encode(data, offsets), strict=True):
                    placed += worker.add(doc_id, ids + end)
                yield rows(placed, id_type)
        if id_type is not None:
            yield rows(worker.finish(), id_type)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
