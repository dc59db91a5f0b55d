"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

1. Equal vectors of a label form a class with a count; only its smallest id goes on.
2. Spherical k-means, fitted on a bounded sample, gives each vector a home cell. A vector also visits every cell
   in which a vector linked with it could have its home: for linked x and y, at chord distance of at most d,
   and y at home in c, x . c_x - x . c <= d * |c_x - c|. So each link is seen in the home cells of both ends, and
   no link is lost at a boundary.
3. Within a label and cell, blocks of bounded size are multiplied. A task returns, for each vector at home, how
   many vectors it is linked with, and a spanning forest of the links instead of the links.
4. Components come from alternating large-star and small-star; the smallest id of each is kept.

Vectors that more than a thousandth of all rows have, at most a thousand, are given to all tasks when rows are joined
with their results; rows of others meet theirs by a join in which no key is common.

Bounds: k-means sees at most ``sample`` vectors and makes at most ``most_cells`` cells, so what is sent to tasks is
bounded; a cell of any size is cut into blocks of ``block`` vectors, every two of which meet in a task. On data
without clusters the visits come near to comparing all vectors of a label, which is what exactness costs there.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label or id
is null, is linked with nothing: no links, its own component, kept. Vectors of different lengths are not linked.
Repeated rows count as vectors of their own, so a vector that is there three times has two links more; each of the rows
comes back, with the same component. Rows of an id on several vectors are judged each by its vector; where that id is the
smallest of the rows of several vectors, these count as one vector. An empty table gives an empty result. Only the id,
vector and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.llm.components import components
from apotheca.llm.scratch import Table, with_class


@dataclass(frozen=True)
class Options:
    """cosine: links are at least this. cell: vectors of the largest label, n of them, per cell that k-means aims at; by default
    n ** (2 / 3), so cells are n ** (1 / 3) at every size."""

    cosine: float = 0.93
    cell: int | None = None
    block: int = 2048
    sample: int = 20_000
    most_cells: int = 1024
    rounds: int = 10
    seed: int = 11


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def spherical_kmeans(vectors: np.ndarray, k: int, options: Options) -> np.ndarray:
    """k unit centroids; an empty cell starts again at the vector that is least like its centroid."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    centroids = unit[np.random.Generator(np.random.PCG64(options.seed)).permutation(len(unit))[:k]]
    for _ in range(options.rounds):
        like = unit @ centroids.T
        home, best = like.argmax(1), like.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, unit)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        sums[empty], norm[empty] = unit[np.argsort(best)[: len(empty)]], 1
        centroids = sums / norm[:, None]
    return centroids


def cells_of(vectors: np.ndarray, centroids: np.ndarray, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for each vector's home and for every cell that it has to visit."""
    like = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ centroids.T
    home = like.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    reach = np.sqrt(2 - 2 * options.cosine)
    row, cell = np.nonzero(like[np.arange(len(like)), home][:, None] - like <= reach * apart[home] + 1e-9)
    return row, cell, cell == home[row]


def _assigned(vectors: DataFrame, centroids: dict[int, np.ndarray], options: Options) -> DataFrame:
    schema = T.StructType(vectors.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes = batch.column("size").to_numpy()
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    if size in centroids:
                        row, cell, home = cells_of(_matrix(batch.column("vector").take(pa.array(rows))), centroids[size], options)
                        rows = rows[row]
                    else:
                        cell, home = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows), dtype=bool)
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _linked(assigned: DataFrame, options: Options) -> DataFrame:
    """id, n (weighted links of a vector at home, as far as this pair of blocks shows), root (of the forest)."""
    keys = ["label", "size", "cell"]
    sizes = assigned.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(options.block)).cast("int").alias("cuts"))
    part = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    dealt = assigned.join(sizes, keys).withColumn("part", part)
    everywhere = F.sequence(F.lit(0), F.col("cuts") - 1)
    # Task (i, j) holds the cell's block j, and the vectors at home of its block i, which count their links there.
    held = dealt.withColumn("i", F.explode(everywhere)).withColumn("j", F.col("part")).withColumn("own", F.col("home") & (F.col("i") == F.col("part")))
    sent = dealt.filter("home").withColumn("j", F.explode(everywhere)).filter("j != part").withColumn("i", F.col("part")).withColumn("own", F.lit(True))
    rows = held.unionByName(sent)
    schema = T.StructType([assigned.schema["id"], T.StructField("n", T.LongType()), T.StructField("root", assigned.schema["id"].dataType)])
    least = options.cosine

    def compare(group: pa.Table) -> pa.Table:
        own, at = group.column("own").to_numpy(), group.column("i").to_numpy() == group.column("j").to_numpy()
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        group, own = group.take(pa.array(order)), own[order]
        other = np.flatnonzero(~own | at[order])
        own = np.flatnonzero(own)
        vectors, copies, ids = _matrix(group.column("vector")), group.column("copies").to_numpy(), group.column("id").to_numpy()
        norms = np.linalg.norm(vectors, axis=1)
        root, n = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for start in range(0, len(own), 128):
            rows = own[start : start + 128]
            link = (vectors[rows] @ vectors[other].T) / (norms[rows][:, None] * norms[other][None, :]) >= least
            link &= ids[rows][:, None] != ids[other][None, :]
            n[rows] += link @ copies[other]
            for row, links in zip(rows, link, strict=True):
                found = np.unique(root[np.append(other[links], row)])
                if len(found) > 1:
                    root[np.isin(root, found)] = found[0]
        touched = np.flatnonzero((n > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": group.column("id").take(pa.array(touched)), "n": pa.array(n[touched]), "root": group.column("id").take(pa.array(root[touched]))})

    return rows.select("label", "size", "cell", "i", "j", "own", "id", "copies", "vector").groupBy("label", "size", "cell", "i", "j").applyInArrow(compare, schema)


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", options: Options | None = None) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Ids are integers. Intermediate tables go to the shared folder (see ``scratch``).
    """
    options = options or Options()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    element = F.col("vector")
    finite = F.forall(element, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(element, lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & element.isNotNull() & finite, F.lit(False))
    classes = rows.filter(usable).groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = Table(classes.withColumn("size", F.size("vector")), "vectors").df

    # A row for each length that vectors have.
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n"))
    counts = {r["size"]: r["n"] for r in sizes.orderBy("size").collect()}
    centroids = {}
    for size, n in counts.items():
        cells = min(-(-n // options.cell) if options.cell else math.ceil(n ** (1 / 3) - 1e-9), options.most_cells)
        if cells > 1:
            taken = classes.filter(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(options.sample).select("vector").toArrow()
            centroids[size] = spherical_kmeans(_matrix(taken.column(0)), cells, options)
    found = Table(_linked(_assigned(classes.select("label", "size", "id", "copies", "vector"), centroids, options), options), "links").df
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("root != id"), "id", "root").df

    named = classes.join(links, "id", "left").join(roots, classes["id"] == roots["node"], "left")
    named = named.select("label", "vector", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    named = Table(named, "named").df
    linked = with_class(rows.filter(usable), named, ["label", "vector"], named.agg(F.sum("copies")).first()[0] or 0).select("id", "n_links", "component_id")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", options: Options | None = None) -> DataFrame:
    """The rows of ``vectors`` that are the smallest id of their group, with all their columns."""
    gone = vector_groups(vectors, id_col, vector_col, label_col, options).filter(~F.col("kept")).select(id_col).distinct()
    return vectors.join(gone, id_col, "left_anti").select(*vectors.columns)
