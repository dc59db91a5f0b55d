"""Vectors as numpy matrices, k-means, and blocks in which every query meets the rows it is to see.

Searches deal rows and queries into blocks of bounded size by a hash of their ids, and one task gets a block of rows with a
block of queries. So a task's memory is bounded, a group of any size is many blocks, and nothing is broadcast that grows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm.scratch import hash_sample


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components."""
    element = F.col(vector)
    return F.coalesce(element.isNotNull() & F.forall(element, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centroids; an empty cell starts again at the vector that is farthest from its centroid."""
    centroids = np.unique(vectors[np.random.Generator(np.random.PCG64(seed)).permutation(len(vectors))[:k]], axis=0)
    for _ in range(rounds):
        apart = squared_distances(vectors, centroids)
        home, away = apart.argmin(1), apart.min(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        n = np.bincount(home, minlength=len(centroids)).astype(np.float64)
        empty = np.flatnonzero(n == 0)
        sums[empty], n[empty] = vectors[np.argsort(-away, kind="stable")[: len(empty)]], 1
        centroids = sums / n[:, None]
    return centroids


def sampled(rows: DataFrame, id_col: str, vector_col: str, size: int, sample: int) -> np.ndarray:
    """At most ``sample`` vectors of one length, by the order of a hash of their ids."""
    ids = hash_sample(rows.filter(F.size(vector_col) == size).select(id_col), id_col, sample)
    taken = rows.filter(F.size(vector_col) == size).join(F.broadcast(ids.distinct()), id_col, "left_semi")
    return matrix(taken.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow().column(0), size)


def in_blocks(rows: DataFrame, queries: DataFrame, keys: list[str], row_block: int, query_block: int, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """compare(rows, queries) for each block of rows and each block of queries that have the same keys.

    Both have the column id and the same columns, where those of the one or the other may be null. A key with
    many rows is many blocks, and each is one task with at most about ``row_block`` rows and ``query_block`` queries.
    """
    cuts = lambda df, name, block: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name))
    dealt = cuts(rows, "__rows", row_block).join(cuts(queries, "__queries", query_block), keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = rows.join(dealt, keys).withColumn("__r", own("__rows")).withColumn("__q", every("__queries")).withColumn("__row", F.lit(True))
    right = queries.join(dealt, keys).withColumn("__q", own("__queries")).withColumn("__r", every("__rows")).withColumn("__row", F.lit(False))
    both = left.unionByName(right).drop("__rows", "__queries")

    def run(group: pa.Table) -> pa.Table:
        is_row = group.column("__row")
        return compare(group.filter(is_row), group.filter(pa.compute.invert(is_row)))

    # Work per byte is high here, so tasks are not joined by their few bytes: a fixed number of partitions, dealt by the group's key.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, *keys, "__r", "__q").groupBy(*keys, "__r", "__q").applyInArrow(lambda group: run(group), schema)
