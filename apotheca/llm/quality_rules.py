"""Quality rules by repetition coverage.

Rolling hashes of word windows of several lengths are computed in numpy over whole texts. A character
counts as repeated under length n if its word lies in a window of n words that the same text has twice or
more; a line counts as repeated if an earlier line of the text equals it. The shares of repeated
characters decide.

Defined results: a null or empty text, or one of white space only, has no words, all counts 0, all shares
0, and fails the base rule (fewer than ``min_words`` words). Texts are never cut. Repeated rows and rows
with a null id are judged each by itself. ``repetition_stats`` returns only the id column and its own
columns, ``keep_documents`` exactly the input's columns, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text is kept if it passes the base rule and none of its shares is above its limit.

    ``ngram_share`` has, for each window length, the largest share of a text's word characters that may lie in
    repeated windows; ``line_share`` is the largest share in lines that repeat an earlier one;
    ``symbols_per_word`` bounds symbols against words.
    """

    min_words: int = 50
    base_window: int = 3
    base_percent: int = 50
    ngram_share: dict[int, float] = field(default_factory=lambda: {3: 0.5, 5: 0.4, 7: 0.35, 9: 0.3})
    line_share: float = 0.35
    symbols_per_word: float = 0.3


_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(texts: ta.Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All statistics and the verdict for the texts of one block."""
    words, doc, chars = texts.word_hashes(), texts.word_doc, texts.word_chars()
    out = {"n_words": texts.per_doc(doc), "word_chars": texts.per_doc(doc, chars).astype(np.int64)}
    symbols = texts.running(_IS_SYMBOL[texts.data])
    out["n_symbols"] = symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]]
    starts, ends, line_doc = texts.lines()
    again = ta.seen_before(ta.in_document(texts.range_hashes(starts, ends), line_doc))
    out["n_dup_lines"] = texts.per_doc(line_doc[again])
    run = np.cumsum(np.bincount(texts.word_end, weights=chars, minlength=len(texts.data) + 1))
    line_chars = run[ends] - run[starts]
    per_char = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = texts.per_doc(line_doc[again], line_chars[again]) / per_char
    ok = (out["dup_line_share"] <= limits.line_share) & (out["n_symbols"] <= limits.symbols_per_word * out["n_words"])
    for n in sorted({limits.base_window, *limits.ngram_share}):
        at, hashes = texts.ngrams(words, n)
        twice = ta.repeated(ta.in_document(hashes, doc[at]))
        inside = ta.covered(at[twice], n, len(words))
        if n == limits.base_window:
            out["n_repeat_words"] = texts.per_doc(doc[inside])
        if n in limits.ngram_share:
            share = texts.per_doc(doc[inside], chars[inside]) / per_char
            out[f"dup_{n}gram_share"] = share
            ok &= share <= limits.ngram_share[n]
    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.base_percent * out["n_words"])
    out["kept"] = ok & ~out["base_failed"]
    return out


def _columns(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    parts = [text_stats(texts, limits) for _, _, texts in ta.blocks(column)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def stats_schema(id_field: T.StructField, limits: Limits) -> T.StructType:
    schema = T.StructType([id_field])
    for name in COUNTS:
        schema.add(name, T.LongType())
    for name in ["dup_line_share", *(f"dup_{n}gram_share" for n in sorted(limits.ngram_share))]:
        schema.add(name, T.DoubleType())
    return schema.add("base_failed", T.BooleanType()).add("kept", T.BooleanType())


def repetition_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row per input row: the id, the base counts, the shares of repeated characters, and the verdict.

    One narrow pass over the two columns; nothing is shuffled.
    """
    limits = limits or Limits()
    schema = stats_schema(docs.schema[id_col], limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = _columns(batch.column(1), limits)
                arrays = [pa.array(got[f.name].astype(np.int64) if isinstance(f.dataType, T.LongType) else got[f.name]) for f in schema.fields[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    limits = limits or Limits()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_columns(batch.column(at), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
