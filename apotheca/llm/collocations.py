"""Phrases whose words go together, by counts of the longest windows only.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs.

1. Each word leads one window: the columns w1 ... w5 hold it and the words after it in its piece, padded with null.
   Equal windows are counted, first among the blocks of a task, and no shorter n-gram is ever made: the windows that begin with a phrase are all
   its occurrences, so ROLLUP over w1 ... w4 sums the counts of shorter phrases as prefixes of longer ones. A task soon
   meets most frequent windows of the corpus, and sends each once; so there are as many tasks as cores need, not as blocks of the input.
2. A window ends early where no frequent phrase can go on. Words and pairs of neighbours are first counted by hash, in
   ``buckets`` buckets; a bucket's count bounds each of its pairs from above, so where it is below ``least`` the pair,
   and every phrase with it, is rare. Triples of frequent pairs are counted alike in a second pass. Windows are padded
   from the first rare pair or triple on. No frequent phrase loses an occurrence, whatever the hashes do: where
   buckets are full, as in a corpus far larger than they are, windows just stay longer.
3. Phrases of at least ``least`` occurrences are joined with their two parts for each cut; the lowest score counts.
4. The first ``top`` of a language are taken within salts of their phrases, then of these.

What is sent to tasks is two bits a bucket. Blocks of whole texts bound a worker's memory. Words are told apart by their
bytes, never by hash, and scores are exact: products are decimals of 38 digits.

Defined results: null texts are empty, a null language is ``und``; repeated documents count as often as they are
there; phrases of equal score come by count, then by UTF-8 bytes, so there are no ties. Only the text and the language are
read. Empty tables, and languages without candidates, give no rows. A text of any length is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apotheca.llm.scratch import Table, small_batches
from apotheca.llm.textarrays import byte_ranges, mix, range_hashes

ORDER = 5
WORDS = [f"w{i + 1}" for i in range(ORDER)]
#: Bytes of texts in a block: of windows, which are told apart within it, and of counts, which aren't.
_BLOCK, _COUNT_BLOCK = 1 << 22, 1 << 20
_SEGMENT = 1 << 15
#: Tasks a core that make windows, at most.
_TASKS = 2
#: Hashes that are counted, and rows that are sent, at once.
_SLICE = 1 << 16
_NEXT = np.uint64(0x9FB21C651E98DF25)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Options:
    """least: occurrences of a candidate. top: phrases a language. redundant: percent of a phrase's count, at which a longer
    candidate makes it go. buckets: a power of two of at least 2 ** 15. keys: hashes that a task holds before it counts them. windows: those
    that it holds before it counts equal ones, and sends them where most differ. texts: rows that a worker gets at once."""

    least: int = 100
    top: int = 2000
    redundant: int = 100
    buckets: int = 1 << 27
    keys: int = 1 << 23
    windows: int = 1 << 20
    texts: int = 2500
    salts: int = 32


@dataclass
class Block:
    """Words of some whole texts. words: the distinct ones. word, lang: of each word in order; follows: whether the next word is in single, pair: buckets of each word, and of it with the next."""

    words: pa.StringArray
    word: np.ndarray
    lang: np.ndarray
    follows: np.ndarray
    single: np.ndarray
    pair: np.ndarray
    triple: np.ndarray


def _block(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, buckets: int) -> Block | None:
    data = _LOWER[data]
    kind = _KIND[data]
    ink = kind == 0
    n = len(data)
    before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
    before[1:], after[: max(n - 1, 0)] = ~ink, ~ink[1:]
    before[offsets] = True
    after[offsets[offsets > 0] - 1] = True
    start, end = np.flatnonzero(ink & before[:n]), np.flatnonzero(ink & after[:n]) + 1
    if not len(start):
        return None
    at = np.zeros(len(start) + 1, dtype=np.int32 if n < 2**31 else np.int64)
    np.cumsum(end - start, out=at[1:])
    kind_of = pa.string() if at.dtype == np.int32 else pa.large_string()
    coded = pa.Array.from_buffers(kind_of, len(start), [None, pa.py_buffer(at), pa.py_buffer(data[ink])]).dictionary_encode()
    words, word = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy().astype(np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.zeros(n + 1, dtype=at.dtype)
    np.cumsum(kind == 2, out=breaks[1:])
    follows = np.zeros(len(start), dtype=bool)
    follows[:-1] = (doc[1:] == doc[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    hashes = range_hashes(np.frombuffer(words.buffers()[2], dtype=np.uint8), ends[:-1], ends[1:])
    lang = langs[doc]
    own = mix(hashes[word] + lang_hash[lang])
    low = np.uint64(buckets - 1)
    bucket = lambda hashes: (hashes & low).astype(np.int32)
    pair, triple = (np.zeros(len(own), dtype=np.int32) for _ in range(2))
    pairs = mix(own[:-1] * _NEXT + own[1:])
    pair[:-1], triple[:-2] = bucket(pairs), bucket(mix(pairs[:-1] * _NEXT + own[2:]))
    return Block(words.cast(pa.large_string()), word, lang, follows, bucket(own), pair, triple)


def _blocks(batch: pa.RecordBatch, buckets: int, size: int = _BLOCK) -> Iterator[tuple[pa.Array, Block]]:
    """(languages, block) for blocks of whole texts of the batch; columns text and lang."""
    coded = batch.column("lang").dictionary_encode()
    langs, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    names = [x.encode() for x in langs.to_pylist()]
    ends = np.cumsum([0, *map(len, names)])
    hashes = range_hashes(np.frombuffer(b"".join(names), dtype=np.uint8), ends[:-1], ends[1:])
    for row, end, data, offsets in byte_ranges(batch.column("text"), size):
        if (block := _block(data, offsets, codes[row:end], hashes, buckets)) is not None:
            yield langs, block


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _pairs(block: Block, often: np.ndarray) -> np.ndarray:
    """Whether each word and the next are in a piece and may be a frequent pair."""
    return block.follows & _bit(often, block.pair)


def _triples(pairs: np.ndarray) -> np.ndarray:
    return pairs & np.append(pairs[1:], False)


def counted(buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """bucket and n of hashes, which are sorted in place. They are counted a slice at a time, so a bucket may come twice, its count dealt over both."""
    buckets.sort()
    for k in range(0, len(buckets), _SLICE):
        found, count = np.unique(buckets[k : k + _SLICE], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], names=["bucket", "n"])


def _bucket_counts(texts: DataFrame, often: bytes | None, options: Options) -> DataFrame:
    """Of words and pairs; of triples, if the frequent pairs are given."""
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(options.keys, dtype=np.int32), 0
        bits = None if sent.value is None else np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            for _, block in _blocks(batch, options.buckets, _COUNT_BLOCK):
                for found in [block.single, block.pair[block.follows]] if bits is None else [block.triple[_triples(_pairs(block, bits))]]:
                    while len(found):
                        taken = found[: len(held) - n]
                        held[n : n + len(taken)] = taken
                        n, found = n + len(taken), found[len(taken) :]
                        if n == len(held):
                            yield from counted(held)
                            n = 0
        yield from counted(held[:n])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def frequent_buckets(texts: DataFrame, options: Options, often: bytes | None = None) -> bytes:
    """One bit a bucket, set if what is in it occurs ``least`` times or more together; see ``_bucket_counts``."""
    often = _bucket_counts(texts, often, options).filter(F.col("n") >= options.least)

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(_SEGMENT, dtype=bool)
        bucket = rows.column("bucket").to_numpy()
        bits[bucket % _SEGMENT] = True
        return pa.table({"segment": pa.array([int(bucket[0]) // _SEGMENT], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    segments = often.groupBy(F.floor(F.col("bucket") / F.lit(_SEGMENT)).alias("segment")).applyInArrow(lambda rows: pack(rows), "segment int, bits binary")
    out = np.zeros((options.buckets // _SEGMENT, _SEGMENT // 8), dtype=np.uint8)
    for row in segments.collect():
        out[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def _windows(block: Block, often: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, words, count) of the distinct windows; words has a row of ORDER numbers, -1 for padding."""
    n = len(block.word)
    known, pairs = _bit(often, block.single), _pairs(block, often)
    # Whether a window goes on to the word after this one, in its second place and in later ones.
    goes_on = [pairs, np.append(False, (_triples(pairs) & _bit(triples, block.triple))[:-1])]
    code = block.lang * (len(block.words) + 1) + np.where(known, block.word + 1, 0)
    found = [code]
    inside = known
    for k in range(1, ORDER):
        inside = inside & np.append(goes_on[k > 1], np.zeros(k, dtype=bool))[k - 1 : k - 1 + n]
        if not inside.any():
            break
        rows = np.flatnonzero(inside)
        column = np.zeros(n, dtype=np.int64)
        column[rows] = block.word[rows + k] + 1
        found.append(column)
    # Windows are told apart column by column: a number for each distinct prefix, then for it with the next word.
    code, first, at, count = np.unique(found[0], return_index=True, return_inverse=True, return_counts=True)
    for column in found[1:]:
        code, first, at, count = np.unique(at * (len(block.words) + 1) + column, return_index=True, return_inverse=True, return_counts=True)
    words = np.full((len(first), ORDER), -1, dtype=np.int64)
    words[:, 0] = np.where(known[first], block.word[first], -1)
    for k, column in enumerate(found[1:], 1):
        words[:, k] = column[first] - 1
    return block.lang[first], words, count


def _numbers(known: pa.Array, more: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``known`` with those of ``more``, which are distinct, that it lacks, and where each of these is in it."""
    at = pc.index_in(more, value_set=known).fill_null(-1).to_numpy()
    lacks = at < 0
    return pa.concat_arrays([known, more.filter(pa.array(lacks))]), np.where(lacks, len(known) + np.cumsum(lacks) - 1, at).astype(np.int32)


class Held:
    """Windows of several blocks: rows of numbers, of the language and of ORDER words (-1: padding), with their counts."""

    def __init__(self) -> None:
        self.langs, self.words = pa.array([], pa.string()), pa.array([], pa.large_string())
        self.rows, self.counts = [np.empty((0, ORDER + 1), dtype=np.int32)], [np.empty(0, dtype=np.int64)]

    def __len__(self) -> int:
        return sum(map(len, self.counts))

    def add(self, langs: pa.Array, words: pa.Array, lang: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        """Windows of a block, as ``_windows`` gives them, with its languages and words."""
        self.langs, lang_number = _numbers(self.langs, langs.cast(pa.string()))
        used = np.unique(at)
        used = used[used >= 0]
        # The last is what -1 picks.
        number = np.full(len(words) + 1, -1, dtype=np.int32)
        self.words, number[used] = _numbers(self.words, words.take(pa.array(used)))
        self.rows.append(np.column_stack([lang_number[lang], number[at]]))
        self.counts.append(count.astype(np.int64))

    def count(self) -> None:
        """Equal windows become one."""
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        number, first = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for k in range(ORDER + 1):
            _, first, number = np.unique(number * (len(self.words) + len(self.langs) + 1) + rows[:, k] + 1, return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(first)))
        self.rows, self.counts = [rows[first]], [np.add.reduceat(counts[order], starts) if len(first) else counts]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """lang, w1 ... w5, n; some windows at a time become texts."""
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        for k in range(0, len(rows), _SLICE):
            some = rows[k : k + _SLICE]
            columns = [self.words.take(pa.array(w, mask=w < 0)).cast(pa.string()) for w in some[:, 1:].T]
            yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(some[:, 0])), *columns, pa.array(counts[k : k + _SLICE])], names=["lang", *WORDS, "n"])


def task_windows(batches: Iterator[pa.RecordBatch], often: bytes, triples: bytes, options: Options) -> Iterator[pa.RecordBatch]:
    """The windows of a task's texts; equal ones are one row, unless more than ``options.windows`` differ."""
    bits = [np.frombuffer(b, dtype=np.uint8) for b in (often, triples)]
    held = Held()
    for batch in batches:
        for langs, block in _blocks(batch, options.buckets):
            held.add(langs, block.words, *_windows(block, *bits))
            if len(held) > options.windows:
                held.count()
                if len(held) > options.windows * 3 // 4:
                    yield from held.batches()
                    held = Held()
    held.count()
    yield from held.batches()


def count_windows(texts: DataFrame, often: bytes, triples: bytes, options: Options) -> DataFrame:
    """lang, w1 ... w5, n: the distinct windows, padded with null, and how often they occur."""
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(often), context.broadcast(triples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task_windows(batches, *(s.value for s in sent), options)

    schema = ", ".join(f"{c} string" for c in ("lang", *WORDS)) + ", n long"
    return texts.mapInArrow(run, schema).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))


def frequent_phrases(windows: DataFrame, least: int) -> DataFrame:
    """lang, size, phrase (words joined by spaces), n: languages (size 0) and phrases of 1 to 5 words with n >= least."""
    longest = windows.filter(F.col(WORDS[-1]).isNotNull()).select("lang", F.lit(ORDER).alias("size"), *WORDS, "n")
    shorter = windows.rollup("lang", *WORDS[:-1]).agg(F.sum("n").alias("n"), F.grouping_id().alias("left"))
    # grouping_id has a bit for each column that a prefix leaves out.
    size = (F.lit(ORDER - 1) - F.bit_count("left")).cast("int")
    shorter = shorter.withColumn("size", size).filter("size >= 0")
    last = F.element_at(F.array(*WORDS[:-1]), F.greatest("size", F.lit(1)))
    shorter = shorter.filter((F.col("size") == 0) | last.isNotNull()).select("lang", "size", *WORDS[:-1], F.lit(None).cast("string").alias(WORDS[-1]), "n")
    kept = shorter.unionByName(longest).filter((F.col("size") == 0) | (F.col("n") >= least))
    return kept.select("lang", "size", F.concat_ws(" ", *WORDS).alias("phrase"), "n")


def _scored(phrases: DataFrame, options: Options) -> DataFrame:
    candidates = phrases.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    # Parts inside a longer candidate, with its count: at most nine for each.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(i, k))))
    inner = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * options.redundant))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    known = phrases.filter("size >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(phrases.filter("size = 0").select("lang", "n"), "lang")
    # Counts of up to 16 digits: 1000 * a * n has at most 36 of the 38 that a decimal holds.
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("up", exact("a") * F.lit(1000).cast("decimal(4,0)") * exact("n")).withColumn("down", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("CAST(up div down AS long)"))
    lowest = F.min(F.struct("score", "cut", "l", "r", "n")).alias("low")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.n", "low.score")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", options: Options | None = None) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    options = options or Options()
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    with small_batches(docs.sparkSession, options.texts):
        often = frequent_buckets(texts, options)
        triples = frequent_buckets(texts, options, often)
        windows = Table(count_windows(texts.coalesce(_TASKS * docs.sparkSession.sparkContext.defaultParallelism), often, triples, options), "windows")
    phrases = Table(frequent_phrases(windows.df, options.least), "phrases")
    windows.drop()
    scored = _scored(phrases.df, options)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(options.salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= options.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= options.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 100, top: int = 2000) -> str:
    """All n-grams of one to five words as rows, counted."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS MATERIALIZED (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i:i + k - 1])))) AS g FROM w),
f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
c AS MATERIALIZED (SELECT * FROM f WHERE len(g) > 1),
i AS (SELECT DISTINCT x.lang, x.g FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g FROM c WHERE len(g) > 2) y JOIN c x ON x.lang = y.lang AND x.g = y.g AND 100 * y.a >= 100 * x.a),
k AS (SELECT c.*, unnest(range(1, len(g))) AS k FROM c ANTI JOIN i ON c.lang = i.lang AND c.g = i.g),
s AS (SELECT k.lang, k.g, k.a, k.k, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * k.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k JOIN t USING (lang)
  JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:]),
b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {top}"""
