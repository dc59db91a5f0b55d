"""Hard negatives through an inverted multi-index.

Components are whole numbers, floor(scale * x), and scores are inner products of them. An anchor's positives are its best
rows of the same label. A hard negative of a positive is a row of another label whose score lies in a window of
percents of the positive's.

1. Two codebooks, one for each half of the components, are fitted by k-means on a bounded sample.
2. Each block of rows is indexed by its cells, a codeword of the one half and one of the other; each codeword also has the
   radius of its rows around it.
3. For an anchor a, the score of a row in a cell is at most the sum of two half-scores, a1 . c1 + |a1| r1 and
   a2 . c2 + |a2| r2. Codewords are sorted by these, and a heap takes cells in the order of their sums (multi-sequence). Cells
   are scored in runs of growing size. The search of a block stops when all windows are certified: a window is, once the
   next bound is below its lower end, or below the last of as many rows as are wanted from it.
4. The best of all blocks are merged. So results are exact, whatever the codebooks are; where vectors form no clusters,
   bounds are loose and most cells are visited.

Anchors are a stated set of rows, which meet all rows in blocks (see ``vectors``).

Defined results: rows with a null id or label, a null vector, null or non-finite components, or components beyond
2 ** 27 in size (whose products may pass 64 bits) take no part. Vectors of different lengths have no score. A row
is never a positive or a negative of an anchor with its id. Repeated rows are rows of their own; anchors that are
equal in all count once. Ties go to the smaller id. A negative positive score has an empty window. Anchors without
positives, and positives without negatives, give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apotheca.llm.scratch import Table
from apotheca.llm.vectors import in_blocks, kmeans, matrix, sampled, squared_distances, usable

LARGEST = 2**27


@dataclass(frozen=True)
class Options:
    """low, high: percents of a positive's score between which negatives lie. codewords: of each half."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    codewords: int = 16
    sample: int = 20_000
    rounds: int = 10
    seed: int = 5
    row_block: int = 8192
    anchor_block: int = 8192
    first_run: int = 256


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in double precision where all sums stay below 2 ** 53."""
    most = np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * max(rows.shape[1], 1)
    if most < 2**53:
        return (rows @ anchor).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


class MultiIndex:
    """A block of rows by cells. codebooks: for each half of the components."""

    def __init__(self, vectors: np.ndarray, codebooks: tuple[np.ndarray, np.ndarray]):
        half = codebooks[0].shape[1]
        self.halves = (slice(0, half), slice(half, vectors.shape[1]))
        codes, self.words, self.radii = [], [], []
        for part, words in zip(self.halves, codebooks, strict=True):
            apart = squared_distances(vectors[:, part], words)
            code = apart.argmin(1)
            used, code = np.unique(code, return_inverse=True)
            radius = np.zeros(len(used))
            # From the differences: expanded squares are too rough near zero.
            np.maximum.at(radius, code, np.sqrt(((vectors[:, part] - words[used][code]) ** 2).sum(1)))
            codes.append(code)
            self.words.append(words[used])
            self.radii.append(radius)
        self.shape = (len(self.words[0]), len(self.words[1]))
        cell = codes[0] * self.shape[1] + codes[1]
        self.order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(self.shape[0] * self.shape[1] + 1))
        self.vectors = vectors[self.order]

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, end row) of the cells that have rows, by falling bounds."""
        sorted_words, bounds = [], []
        for part, words, radii in zip(self.halves, self.words, self.radii, strict=True):
            length = np.linalg.norm(anchor[part])
            bound = words @ anchor[part] + length * radii
            bound += 1e-9 * (np.abs(bound) + length * np.abs(words).sum(1) + 1)  # above what rounding may take off
            order = np.argsort(-bound, kind="stable")
            sorted_words.append(order.tolist())
            bounds.append(bound[order].tolist())
        (first, second), (up, down) = sorted_words, bounds
        starts, width = self.starts.tolist(), self.shape[1]
        heap = [(-up[0] - down[0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-up[i + 1] - down[0], i + 1, 0))
            if j + 1 < len(down):
                heapq.heappush(heap, (-up[i] - down[j + 1], i, j + 1))
            cell = first[i] * width + second[j]
            if starts[cell + 1] > starts[cell]:
                yield -bound, starts[cell], starts[cell + 1]

    def runs(self, anchor: np.ndarray, size: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(bound of what is left, rows, their scores) over runs of cells, each twice as large as the one before."""
        held, n = [], 0
        for bound, start, end in self.cells(anchor):
            if n >= size:
                at = np.concatenate(held)
                yield bound, at, scores(self.vectors[at], anchor)
                held, n, size = [], 0, size * 2
            held.append(np.arange(start, end))
            n += end - start
        if held:
            at = np.concatenate(held)
            yield -np.inf, at, scores(self.vectors[at], anchor)


def best_in_windows(index: MultiIndex, anchor: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], wanted: int, first_run: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of the best ``wanted`` allowed rows in each window, both ends included."""
    best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in windows]
    opened = [k for k, (low, high) in enumerate(windows) if low <= high]
    lowest = min((windows[k][0] for k in opened), default=0)
    for left, rows, score in index.runs(anchor, first_run) if opened else ():
        at = index.order[rows]
        keep = allowed[at] & (score >= lowest)
        score, found = score[keep], ids[at[keep]]
        for k in opened:
            low, high = windows[k]
            inside = (score >= low) & (score <= high)
            if inside.any():
                s, i = np.concatenate([best[k][0], score[inside]]), np.concatenate([best[k][1], found[inside]])
                order = np.lexsort((i, -s))[:wanted]
                best[k] = s[order], i[order]
        # A bound that equals the last score may hide a smaller id.
        opened = [k for k in opened if left >= windows[k][0] and not (len(best[k][0]) == wanted and best[k][0][-1] > left)]
        if not opened:
            break
    return best


def _compare(codebooks: dict[int, tuple[np.ndarray, np.ndarray]], options: Options, same: bool):
    """Positives (same label, no window) or negatives (other labels, the windows of each query's positives)."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        whole = lambda t: np.floor(matrix(t.column("vector"), size) * options.scale)
        ids, labels = (rows.column(c).combine_chunks() for c in ("id", "label"))
        codes = pa.concat_arrays([labels, anchors.column("label").combine_chunks()]).dictionary_encode().indices.to_numpy()
        codes, own = codes[: len(labels)], codes[len(labels) :]
        ids, index, vectors = ids.to_numpy(), MultiIndex(whole(rows), codebooks[size]), whole(anchors)
        positives = anchors.column("positives").to_pylist() if not same else [None] * len(vectors)
        key, anchor_ids = anchors.column("key").to_pylist(), anchors.column("id").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for n, vector in enumerate(vectors):
            allowed = ((codes == own[n]) == same) & (ids != anchor_ids[n])
            if same:
                windows, wanted = [(-np.inf, np.inf)], options.positives
            else:
                windows, wanted = [(-(-options.low * p // 100), options.high * p // 100) for p in positives[n]], options.negatives
            for k, (score, found) in enumerate(best_in_windows(index, vector, ids, allowed, windows, wanted, options.first_run)):
                for c, values in zip(out, ([key[n]] * len(score), [anchor_ids[n]] * len(score), [k] * len(score), found.tolist(), score.tolist()), strict=True):
                    c.extend(values)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "anchor_id", "window", "found_id", "score"])

    return run


_FOUND = "key string, anchor_id long, window int, found_id long, score long"


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id"))).filter(F.col("rank") <= n)


def mine_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", options: Options | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Ids are integers."""
    options = options or Options()
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    small = F.forall("vector", lambda x: F.abs(F.floor(x.cast("double") * options.scale)) <= LARGEST)
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull()).filter(usable("vector")).filter(small)
    rows = Table(rows.withColumn("size", F.size("vector")), "rows").df
    key = F.sha2(F.concat_ws("|", "id", "label", F.to_json("vector")), 256)
    anchors = rows.filter("is_anchor").drop("is_anchor").withColumn("key", key).dropDuplicates(["key"])
    rows = rows.drop("is_anchor")

    # One codebook for each length of the vectors; lengths that no anchor has are not searched.
    sizes = sorted(r["size"] for r in anchors.select("size").distinct().collect())
    codebooks = {}
    for size in sizes:
        taken = np.floor(sampled(rows, "id", "vector", size, options.sample) * options.scale)
        halves = taken[:, : size // 2], taken[:, size // 2 :]
        codebooks[size] = tuple(kmeans(h, options.codewords, options.rounds, options.seed) for h in halves)

    blocks = lambda queries, same: in_blocks(rows.withColumns({"key": F.lit(None).cast("string"), "positives": F.lit(None).cast("array<long>")}), queries, ["size"], options.row_block, options.anchor_block, _compare(codebooks, options, same), _FOUND)
    positives = _first(blocks(anchors.withColumn("positives", F.lit(None).cast("array<long>")), True), ["key"], options.positives)
    positives = Table(positives.select("key", "anchor_id", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives").df
    lists = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    negatives = _first(blocks(anchors.join(lists, "key"), False), ["key", "window"], options.negatives)
    joined = negatives.select("key", "window", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["key", "window"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql(anchors: str = "vec_id % 100 = 0", label: str = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") -> str:
    """Every anchor with every row."""
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.{anchors}),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
