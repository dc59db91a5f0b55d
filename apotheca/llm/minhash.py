"""Near-duplicates by MinHash banding, signature verification, exact confirmation and connected components.

A text's set holds its distinct windows of ``words`` consecutive words after A-Z are lower-cased, as 64-bit
hashes; a text with fewer words has one element, the whole sequence. Two documents are linked if the
Jaccard similarity of their whole sets is at least ``percent`` / 100.

1. One pass over the texts makes a row per document: the set's size and 128-bit digest, the minima of
   ``bands * rows`` universal hash functions, and one key per band.
2. Documents with equal digests form a class; only the class's smallest id goes on, so copies cost nothing
   further, however many there are.
3. Every member of a band bucket is paired with the bucket's smallest id. These pairs are filtered by their
   signatures and confirmed on the whole sets, and components are found. Pairs inside a component need no more tests.
4. What is left are buckets that hold more than one component. Their members' signatures are compared in blocks of
   bounded size, each pair in the first bucket that it shares; a member that comes within ``slack`` of the
   threshold with one of another component is passed on with its whole set, and the pairs are confirmed where they
   meet. A task returns a spanning forest of confirmed links, never the pairs. So no candidate is given up. Members
   are dealt by the size of their sets first, for linked sets differ by a bounded factor; within a size
   class of m members of one such bucket, each goes to m / block tasks. All other steps make at most a row per
   member of a bucket.
5. Components come from alternating large-star and small-star.
6. Classes that hold more than a thousandth of all rows, at most a thousand, are given to all tasks; rows of other
   classes meet theirs by a join in which no key is common.

A pair at the threshold shares a band with probability 1 - (1 - s ** rows) ** bands: for the defaults at 0.8
all but 1.4e-7, and more above it. Its signatures pass with all but 1.8e-8 (120 minima, binomial).

Defined results: a null text, an empty one or one without words has size 0 and is linked with nothing. Rows with
a null id are linked with nothing and kept. Rows that repeat an id count as one document: they share a
component, whatever their texts. Only the id and the text are read; the result has no other input column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm import textarrays as ta
from apotheca.llm.components import components
from apotheca.llm.scratch import Table, small_batches, with_class


@dataclass(frozen=True)
class Options:
    """slack: in shares of the signature. block, block_bytes: most rows, and bytes of whole sets, of a bucket that one
    task compares with as many others. batch: rows with whole sets that go to Python at once.
    """

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    slack: float = 0.22
    block: int = 1024
    block_bytes: int = 4 << 20
    batch: int = 500
    seed: int = 7


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: ta.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and each set's size."""
    hashes, doc = texts.word_hashes(), texts.word_doc
    at, found = texts.ngrams(hashes, words)
    counts = texts.per_doc(doc)
    first = np.searchsorted(doc, np.arange(texts.n))
    short = np.flatnonzero((counts > 0) & (counts < words))
    whole = [np.bitwise_xor.reduce(ta.mix(hashes[first[k] : first[k] + counts[k]] + np.arange(1, counts[k] + 1, dtype=np.uint64))) for k in short]
    begin = np.searchsorted(doc[at], np.arange(texts.n + 1)) if len(at) else np.zeros(texts.n + 1, dtype=np.int64)
    sets = [np.unique(found[begin[k] : begin[k + 1]]) for k in range(texts.n)]
    for k, h in zip(short, whole, strict=True):
        sets[k] = np.array([h], dtype=np.uint64)
    return (np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)), np.array([len(s) for s in sets], dtype=np.int64)


def _lowered(texts: ta.Texts) -> ta.Texts:
    return ta.Texts(_LOWER[texts.data], texts.offsets)


def _functions(options: Options) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the universal hash functions x -> (a * x + b mod 2 ** 64) >> 32."""
    rng = np.random.Generator(np.random.PCG64(options.seed))
    n = options.bands * options.rows
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, options: Options) -> np.ndarray:
    """The minima of all hash functions over each non-empty set: a row of 32-bit integers per set."""
    sizes = sizes[sizes > 0]
    starts = np.cumsum(sizes) - sizes
    x = hashes >> np.uint64(32)
    out = np.empty((len(sizes), options.bands * options.rows), dtype=np.uint32)
    value = np.empty_like(x)
    for i, (a, b) in enumerate(zip(*_functions(options), strict=True)):
        np.multiply(x, a, out=value)
        value += b
        value >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(value, starts) if len(starts) else 0
    return out


def band_keys(signature: np.ndarray, options: Options) -> np.ndarray:
    keys = np.empty((len(signature), options.bands), dtype=np.int64)
    for band in range(options.bands):
        key = np.full(len(signature), band + 1, dtype=np.uint64)
        for i in range(options.rows):
            key = ta.mix(key ^ signature[:, band * options.rows + i])
        keys[:, band] = key.view(np.int64)
    return keys


def _sketches(docs: DataFrame, id_col: str, text_col: str, options: Options) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    schema.add("n_shingles", T.LongType()).add("high", T.LongType()).add("low", T.LongType())
    schema.add("signature", T.BinaryType()).add("keys", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(1)):
                hashes, sizes = shingle_sets(_lowered(texts), options.words)
                has = sizes > 0
                digests = []
                for salt in (1, 2):
                    total = np.zeros(texts.n, dtype=np.uint64)
                    if has.any():
                        total[has] = np.add.reduceat(ta.mix(hashes ^ ta.mix(np.uint64(salt))), (np.cumsum(sizes) - sizes)[has])
                    digests.append(pa.array(total.view(np.int64)))
                signature = signatures(hashes, sizes, options)
                keys = band_keys(signature, options)
                at = np.cumsum(has) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(sizes),
                        *digests,
                        pa.array([signature[i].tobytes() if h else None for h, i in zip(has, at, strict=True)], pa.binary()),
                        pa.array([keys[i] if h else None for h, i in zip(has, at, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id and the sorted set as binary, for rows (id, text)."""
    schema = T.StructType([docs.schema["id"], T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in ta.blocks(batch.column(1)):
                hashes, sizes = shingle_sets(_lowered(texts), words)
                ends = np.cumsum(sizes)
                sets = [hashes[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sets, pa.binary())], names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)


def _signature_matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, _ = ta.buffers(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint32).reshape(-1, n)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """The pairs (a, b) that pass the signatures and then the whole sets."""
    n, least, percent = options.bands * options.rows, (options.percent / 100 - options.slack) * options.bands * options.rows, options.percent
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_signature_matrix(batch.column(2), n) == _signature_matrix(batch.column(3), n)).sum(1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            ok = [_similar(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), percent) for x, y in sets]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def with_both(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
        left = side.select(F.col("id").alias("a"), F.col(what).alias("x"))
        right = side.select(F.col("id").alias("b"), F.col(what).alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    passed = with_both(pairs, sketches, "signature").mapInArrow(alike, schema)
    return with_both(passed, sets, "shingles").mapInArrow(equal, schema).distinct()


def _blocked(members: DataFrame, weight: Column, limit: int, options: Options) -> tuple[DataFrame, DataFrame]:
    """The blocks of buckets, kept until they are released, and the members of buckets dealt to pairs of blocks i <= j that may hold linked sets; ``limit``: of a block's weights.

    In buckets of more than one block, a block holds sets of one size class, and only blocks of the same class and of
    neighbouring ones meet: sets of classes further apart are too different in size to be linked.
    """
    unit = 1.001 * max(math.log(100 / options.percent), 1e-3)
    shift = 1 << 20
    sized = members.withColumn("class", F.floor(F.log("n_shingles") / unit).cast("int"))
    sizes = sized.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum(weight).alias("weight")).groupBy("key")
    sizes = sizes.agg(F.sum("n").alias("copies"), F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("weight") / F.lit(limit)).cast("int")))).alias("cuts"))
    sizes = sizes.withColumn("cuts", F.when(F.col("total") > limit, F.col("cuts")).otherwise(F.create_map(F.lit(0), F.lit(1)))).persist()
    dealt = with_class(sized, sizes, ["key"], sizes.agg(F.sum("copies")).first()[0] or 0).withColumn("class", F.when(F.col("total") > limit, F.col("class")).otherwise(F.lit(0)))
    dealt = dealt.withColumn("part", (F.col("class") * shift + F.pmod(F.xxhash64("id"), F.col("cuts")[F.col("class")])).cast("long"))
    near = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("class") + d), lambda c: F.map_contains_key("cuts", c))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.col("cuts")[c] - 1), lambda k: (c * shift + k).cast("long"))))
    dealt = dealt.withColumn("other", F.explode(others))
    return sizes, dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *[c for c in members.columns if c not in ("key", "n_shingles")])


def _close_pairs(group: pa.Table, options: Options) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and equal minima of members of different components and, in mixed tasks, blocks, that have like signatures
    and no earlier bucket in common; by stripes of rows."""
    n, rows = options.bands * options.rows, options.rows
    least = (options.percent / 100 - options.slack) * n
    matrix, component, part = _signature_matrix(group.column("signature"), n), group.column("component").to_numpy(), group.column("part").to_numpy()
    band, mixed = group.column("band")[0].as_py(), group.column("i")[0].as_py() != group.column("j")[0].as_py()
    for start in range(0, len(matrix), 32):
        stop = min(start + 32, len(matrix))
        like = np.zeros((stop - start, len(matrix)), dtype=np.int16)
        for k in range(n):
            like += matrix[start:stop, k][:, None] == matrix[:, k][None, :]
        far = component[start:stop, None] == component[None, :]
        far |= np.arange(start, stop)[:, None] >= np.arange(len(matrix))[None, :]
        if mixed:
            far |= part[start:stop, None] == part[None, :]
        like[far] = -1
        x, y = np.nonzero(like >= least)
        # Pairs are looked at a few thousand at a time, for a stripe may hold very many.
        for some in range(0, len(x), 4096):
            left, right = x[some : some + 4096], y[some : some + 4096]
            earlier = (matrix[start + left, : band * rows] == matrix[right, : band * rows]).reshape(len(left), band, rows).all(2).any(1)
            left, right = left[~earlier], right[~earlier]
            yield (start + left).astype(np.int32), right.astype(np.int32), like[left, right]


def _rest(members: DataFrame, sketches: DataFrame, sets: DataFrame, most: int, options: Options) -> Table:
    """A spanning forest (a, b) of the links between components that share a bucket. members, ``most`` rows: key, band, id, component."""
    id_type = members.schema["id"]
    flagged_schema = T.StructType([members.schema["key"], members.schema["band"], id_type, members.schema["component"]])
    link_schema = T.StructType([T.StructField("a", id_type.dataType), T.StructField("b", id_type.dataType)])

    def flag(group: pa.Table) -> pa.Table:
        close = np.zeros(group.num_rows, dtype=bool)
        for x, y, _ in _close_pairs(group, options):
            close[x] = close[y] = True
        return group.select(["key", "band", "id", "component"]).filter(pa.array(close))

    def link(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("shingles")]
        root, left, right = list(range(len(ids))), [], []

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        first: dict[int, int] = {}
        for k, c in enumerate(group.column("component").to_pylist()):
            root[k] = first.setdefault(c, k)
        pairs = [np.concatenate(p) for p in zip(*_close_pairs(group, options), strict=True)]
        order = np.argsort(-pairs[2], kind="stable") if pairs else ()
        for some in range(0, len(order), 4096):
            for x, y in zip(*(p[order[some : some + 4096]].tolist() for p in pairs[:2]), strict=True):
                a, b = top(x), top(y)
                if a != b and _similar(sets[x], sets[y], options.percent):
                    root[max(a, b)] = min(a, b)
                    left.append(ids[x])
                    right.append(ids[y])
        kind = group.schema.field("id").type
        return pa.table({"a": pa.array(left, kind), "b": pa.array(right, kind)})

    signed = members.join(sketches, "id").select("key", "band", "id", "component", "n_shingles", "signature")
    sizes, dealt = _blocked(signed, F.lit(1), options.block, options)
    flagged = Table(dealt.groupBy("key", "i", "j").applyInArrow(flag, flagged_schema).distinct(), "close", most)
    sizes.unpersist()
    whole = flagged.df.join(sketches, "id").join(sets, "id").select("key", "band", "id", "component", "n_shingles", "signature", "shingles")
    sizes, dealt = _blocked(whole, 8 * F.col("n_shingles"), options.block_bytes, options)
    links = Table(dealt.groupBy("key", "i", "j").applyInArrow(link, link_schema).distinct(), "links", most)
    sizes.unpersist()
    flagged.drop()
    return links


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links), kept.

    Ids are integers. Intermediate tables go to the shared folder (see ``scratch``).
    """
    options = options or Options()
    with small_batches(docs.sparkSession, options.batch):
        all_rows = Table(_sketches(docs, id_col, text_col, options), "sketches").df
    total = all_rows.count()
    members = options.bands * total
    rows = all_rows.filter("id is not null and n_shingles > 0")
    classes = rows.groupBy("n_shingles", "high", "low").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    firsts = rows.join(classes.select("id").distinct(), "id", "left_semi")
    keyed = firsts.select("id", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    buckets = Table(keyed.join(shared.select("key", "least"), "key").distinct(), "buckets", members)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = rows.select("id", "n_shingles", "signature")
    with small_batches(docs.sparkSession, options.batch):
        sets = Table(_sets(texts.join(buckets.df.select("id").distinct(), "id", "left_semi"), options.words), "sets", total, 1 << 12)
        centre = buckets.df.filter("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
        links = Table(_confirmed(centre, sketches, sets.df, options), "links", members)
        found = components(links.df, "a", "b", links.df.count())
        component = buckets.df.select("key", "band", "id").join(found.df, buckets.df["id"] == found.df["node"], "left").select("key", "band", "id", F.coalesce("root", "id").alias("component"))
        mixed = component.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
        more = _rest(component.join(mixed, "key"), sketches, sets.df, members, options)
    roots = components(more.df.unionByName(found.df.select(F.col("root").alias("a"), F.col("node").alias("b"))), "a", "b", more.df.count() + found.df.count())
    for table in (found, more, links, sets, buckets):
        table.drop()

    digest = ["n_shingles", "high", "low"]
    named = classes.join(roots.df, classes["id"] == roots.df["node"], "left").filter("copies > 1 or root is not null")
    named = Table(named.select(*digest, "copies", F.coalesce("root", "id").alias("component")), "named", total).df
    placed = with_class(all_rows.select("id", *digest), named, digest, total)
    component_id = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "id")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group, with all their columns."""
    gone = duplicate_groups(docs, id_col, text_col, options).filter(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
