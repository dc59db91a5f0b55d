"""Approximate nearest neighbours by an adaptive scan of dimensions.

1. k-means on a bounded sample makes about sqrt(n) lists; every row goes to the list of its nearest centroid.
2. Vectors are rotated by a random orthogonal matrix, so each block of columns holds its share of a distance on
   average, whatever the components mean.
3. A query first sees its own list, whole; its k-th distance there is its limit.
4. It then probes each other list that may hold a nearer row: rows at distance r from a centroid at distance c lie at c^2 +
   r^2 - 2 c r u, and in D dimensions u is about normal with variance 1 / D, so a list is passed over only if no r
   between its least and largest comes below the limit at ``reach`` standard deviations. Within a list the rotated columns
   are read block by block. After d of D columns a row is abandoned if the hypothesis that it is near enough is rejected: if
   its partial distance times sqrt(D / d) is over (1 + certainty / sqrt(d)) times the limit.
5. What is left is measured on the original vectors, in double precision, and the best k of all lists are merged.

Both tests err rarely, and only by leaving out a neighbour; distances that are returned are exact. tests/llm measures
recall against brute force.

Lists of any size are blocks of bounded size, queries are a stated set that meets rows in blocks (see ``vectors``), and
the driver has a centroid and three numbers for each of at most ``most_lists`` lists of a vector length.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take
no part. Vectors of different lengths are not near. A row is never found by a query with its id. Repeated rows are found
each; queries that are equal in all count once. Ties go to the smaller id. With fewer than k candidates all are found,
since the limit is then infinite. An empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm.scratch import Table
from apotheca.llm.vectors import in_blocks, kmeans, matrix, sampled, squared_distances, usable


@dataclass(frozen=True)
class Options:
    """k: neighbours. columns: of a block. certainty, reach: of the two tests, in standard deviations."""

    k: int = 10
    columns: int = 16
    certainty: float = 2.1
    reach: float = 3.5
    sample: int = 20_000
    most_lists: int = 1024
    rounds: int = 8
    seed: int = 3
    row_block: int = 8192
    query_block: int = 8192


@dataclass
class Lists:
    """Of one vector length. rotation: orthogonal. near, far: the least and largest distance of a list's rows from its centroid."""

    centroids: np.ndarray
    rotation: np.ndarray
    near: np.ndarray | None = None
    far: np.ndarray | None = None


def _rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _listed(rows: DataFrame, found: dict[int, Lists]) -> DataFrame:
    """Rows with the list that they are in and their distance from its centroid."""
    schema = T.StructType(rows.schema.fields + [T.StructField("list", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                sizes = batch.column("size").to_numpy()
                for size in np.unique(sizes):
                    if size not in found:
                        continue
                    part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                    vectors, centroids = matrix(part.column("vector"), size), found[size].centroids
                    home = squared_distances(vectors, centroids).argmin(1)
                    away = np.sqrt(((vectors - centroids[home]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(away)], names=schema.names)

    return rows.mapInArrow(run, schema)


def lists_to_probe(query: np.ndarray, limit: float, lists: Lists, reach: float) -> np.ndarray:
    """Lists of which some row may be within the limit."""
    apart = np.sqrt(((lists.centroids - query) ** 2).sum(1))
    u = min(reach / np.sqrt(max(len(query), 1)), 1.0)
    r = np.clip(apart * u, lists.near, lists.far)
    return np.flatnonzero((apart**2 + r**2 - 2 * apart * r * u <= limit**2 * (1 + 1e-9) + 1e-12) & (lists.far >= 0))


def _probes(queries: DataFrame, found: dict[int, Lists], options: Options) -> DataFrame:
    """Queries, with their limit, once for each list that they have to probe besides their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, own = batch.column("size")[row].as_py(), batch.column("list")[row].as_py()
                vector = matrix(batch.column("vector").slice(row, 1), size)[0]
                to = lists_to_probe(vector, batch.column("limit")[row].as_py(), found[size], options.reach)
                to = to[to != own]
                part = batch.take(pa.array(np.full(len(to), row)))
                yield part.set_column(part.schema.get_field_index("list"), "list", pa.array(to.astype(np.int32)))

    return queries.mapInArrow(run, queries.schema)


def near_rows(blocks: list[np.ndarray], query: list[np.ndarray], limit: float, certainty: float) -> np.ndarray:
    """Rows that no test rejects. blocks: the rotated columns, a matrix for each block; query: the same of the query."""
    left, partial, size = np.arange(len(blocks[0])), np.zeros(len(blocks[0])), sum(b.shape[1] for b in blocks)
    seen = 0
    for block, part in zip(blocks, query, strict=True):
        partial += ((block[left] - part) ** 2).sum(1)
        seen += block.shape[1]
        slack = (1 + certainty / np.sqrt(seen)) ** 2 if seen < size else 1 + 1e-9
        keep = partial * (size / seen) <= limit**2 * slack + 1e-12
        left, partial = left[keep], partial[keep]
        if not len(left):
            break
    return left


_FOUND = "key string, query_id long, found_id long, score double"


def _compare(found: dict[int, Lists], options: Options):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        vectors, wanted, ids = matrix(rows.column("vector"), size), matrix(queries.column("vector"), size), rows.column("id").to_numpy()
        rotation = found[size].rotation
        cut = lambda m: [np.ascontiguousarray((m @ rotation)[..., s : s + options.columns]) for s in range(0, size, options.columns)]
        blocks, parts = cut(vectors), cut(wanted)
        limits, keys, query_ids = queries.column("limit").to_numpy(), queries.column("key").to_pylist(), queries.column("id").to_numpy()
        out: list[list] = [[], [], [], []]
        for n, vector in enumerate(wanted):
            left = np.arange(len(ids)) if np.isinf(limits[n]) else near_rows(blocks, [p[n] for p in parts], limits[n], options.certainty)
            left = left[ids[left] != query_ids[n]]
            score = np.sqrt(((vectors[left] - vector) ** 2).sum(1))
            order = np.lexsort((ids[left], score))[: options.k]
            for column, values in zip(out, ([keys[n]] * len(order), [int(query_ids[n])] * len(order), ids[left][order].tolist(), score[order].tolist()), strict=True):
                column.extend(values)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "query_id", "found_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", options: Options | None = None) -> DataFrame:
    """query_id, rank (from 1), the id column, score (the Euclidean distance): the k nearest rows of each query. Ids are integers."""
    options = options or Options()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("id").isNotNull() & usable("vector")).filter(F.exists("vector", lambda x: x != 0)).withColumn("size", F.size("vector"))
    wanted = rows.filter("is_query").select("size").distinct()
    found = {}
    for row in rows.groupBy("size").agg(F.count("*").alias("n")).join(wanted, "size").collect():
        size, k = row["size"], min(max(int(np.sqrt(row["n"])), 1), options.most_lists)
        taken = sampled(rows, "id", "vector", size, options.sample)
        found[size] = Lists(kmeans(taken, k, options.rounds, options.seed), _rotation(size, options.seed))
    listed = Table(_listed(rows, found), "listed").df
    for lists in found.values():
        lists.near, lists.far = np.zeros(len(lists.centroids)), np.full(len(lists.centroids), -1.0)
    for row in listed.groupBy("size", "list").agg(F.min("away").alias("near"), F.max("away").alias("far")).collect():
        found[row["size"]].near[row["list"]], found[row["size"]].far[row["list"]] = row["near"], row["far"]

    no_limit = F.lit(float("inf"))
    key = F.sha2(F.concat_ws("|", "id", F.to_json("vector")), 256)
    queries = listed.filter("is_query").withColumn("key", key).withColumn("limit", no_limit).drop("is_query", "away").dropDuplicates(["key"])
    candidates = listed.drop("is_query", "away").withColumns({"key": F.lit(None).cast("string"), "limit": F.lit(None).cast("double")})
    scan = lambda q: in_blocks(candidates, q, ["size", "list"], options.row_block, options.query_block, _compare(found, options), _FOUND)
    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("score", "found_id"))).filter(F.col("rank") <= options.k)
    own = Table(best(scan(queries)).drop("rank"), "own_lists").df
    limits = own.groupBy("key").agg(F.when(F.count("*") >= options.k, F.max("score")).alias("limit"))
    limited = queries.drop("limit").join(limits, "key", "left").withColumn("limit", F.coalesce("limit", no_limit)).select(*queries.columns)
    others = scan(_probes(limited, found, options))
    return best(own.unionByName(others)).select("query_id", "rank", F.col("found_id").alias(id_col), "score")
