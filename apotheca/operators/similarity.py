"""Attachment of ungrouped products to sub-clusters by similar names and forms, as a similarity join.

Names are compared if enough of their q-grams are equal (Jaccard similarity ``share``). Of each name only its rarest grams are
posted: two names with that share of grams have one in common among the first n - ceil(share * n) + 1 of each, in any
order of all grams that both sides keep to. Postings meet by gram and by size; grams of many names are dealt into cuts, so
no task holds all names of a gram. Candidates are scored by Jaro-Winkler in numpy, whole batches at once.

Equal names are compared once, however many products have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.functions.numbers import rounded

#: Fixed values of Jaro-Winkler similarity: the weight of a common prefix letter, at most so many, for scores above.
PREFIX_WEIGHT, PREFIX_MOST, BOOST_ABOVE = 0.1, 4, 0.7


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows of a matrix, 0 beyond the end, and lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, sizes


def jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of each pair, 0 to 1; of empty texts 0. Letters match within half of the longer length; each takes the first free."""
    (a, la), (b, lb) = _letters(left), _letters(right)
    n, at, rows = len(la), np.arange(b.shape[1]), np.arange(len(la))
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    free, hit = at < lb[:, None], np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        found = free & (b == a[:, i, None]) & (np.abs(at - i) <= window) & (i < la)[:, None]
        hit[:, i] = found.any(1)
        free[rows[hit[:, i]], found.argmax(1)[hit[:, i]]] = False
    taken = (at < lb[:, None]) & ~free
    m = hit.sum(1)
    width = min(a.shape[1], b.shape[1])
    first = lambda x, mask: np.take_along_axis(x, np.argsort(~mask, axis=1, kind="stable"), 1)[:, :width]
    moved = ((first(a, hit) != first(b, taken)) & (np.arange(width) < m[:, None])).sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / some) / 3, 0.0)
    head = min(width, PREFIX_MOST)
    same = (a[:, :head] == b[:, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1) if n else np.zeros(0)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)


def with_similarity(pairs: DataFrame, left: str, right: str, name: str, block: int = 4096) -> DataFrame:
    """``pairs`` with the similarity of two columns; null is like nothing."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())])
    at = [pairs.columns.index(left), pairs.columns.index(right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                a, b = (batch.column(i).to_pylist() for i in at)
                known = np.array([x is not None and y is not None for x, y in zip(a, b, strict=True)], dtype=bool)
                score = jaro_winkler([x or "" for x in a], [y or "" for y in b])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(known, score, 0.0))], names=schema.names)

    return pairs.mapInArrow(run, schema)


def grams(name: str | Column, q: int = 3) -> Column:
    """The distinct q-grams of a name between blanks, without case."""
    low = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - q + 1, F.lit(1))), lambda i: low.substr(i, F.lit(q))))


def _posted(names: DataFrame, order: DataFrame, share: float) -> DataFrame:
    """name, n (its grams) and gram, for the rarest of its grams that a name of that similarity must meet."""
    held = names.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(order, "gram")
    gathered = held.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    first = F.slice("grams", 1, F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1)
    return gathered.select("name", "n", F.explode(F.transform(first, lambda g: g["gram"])).alias("gram"))


def similar_names(left: DataFrame, right: DataFrame, share: float = 0.3, q: int = 3, cut: int = 5000) -> DataFrame:
    """left_name, right_name: pairs of distinct names (column name) whose q-grams have at least that Jaccard similarity."""
    sides = [df.select("name").filter("name is not null").distinct().withColumn("grams", grams("name", q)) for df in (left, right)]
    order = sides[0].unionByName(sides[1]).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    a, b = (_posted(df, order, share) for df in sides)
    # Names of a common gram on the right are dealt into cuts, and each name on the left goes to all of them.
    cuts = b.groupBy("gram").agg(F.ceil(F.count("*") / F.lit(cut)).cast("long").alias("cuts"))
    b = b.join(cuts, "gram").select(F.col("name").alias("right_name"), F.col("n").alias("m"), "gram", F.pmod(F.xxhash64("name"), F.col("cuts")).alias("cut"))
    a = a.join(cuts, "gram").select(F.col("name").alias("left_name"), "n", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    fits = (F.col("m") >= F.col("n") * share - 1e-9) & (F.col("n") >= F.col("m") * share - 1e-9)
    pairs = a.join(b, ["gram", "cut"]).filter(fits).select("left_name", "right_name").distinct()
    both = F.size(F.array_intersect(grams("left_name", q), grams("right_name", q)))
    every = F.size(F.array_union(grams("left_name", q), grams("right_name", q)))
    return pairs.filter(both >= every * share - 1e-9)


def attach(orphans: DataFrame, groups: DataFrame, least: float = 0.85, name_weight: float = 0.7, share: float = 0.3) -> DataFrame:
    """Orphans (id, name, form) with the sub-cluster (group_id, name, form) that is most like them, and its score.

    The score weighs the similarity of names and that of forms; below ``least`` there is no group, and the
    orphan is to found a cluster of its own. Ties go to the smallest group_id; null names stay alone.
    """
    wanted = orphans.select("name", "form").distinct()
    known = groups.select("group_id", F.col("name").alias("right_name"), F.col("form").alias("right_form"))
    names = with_similarity(similar_names(orphans, groups, share), "left_name", "right_name", "name_score")
    # A form adds at most its weight, so names below this can't reach the score with any form.
    names = names.filter(F.col("name_score") * name_weight + (1 - name_weight) >= least - 1e-9)
    pairs = wanted.join(names, wanted["name"] == names["left_name"]).drop("left_name").join(known, "right_name")
    scored = with_similarity(pairs, "form", "right_form", "form_score")
    scored = scored.withColumn("score", rounded(F.col("name_score") * name_weight + F.col("form_score") * (1 - name_weight), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("name", "form").agg(F.min_by(F.struct("group_id", "score"), F.struct(-F.col("score"), "group_id")).alias("best"))
    best = best.select(F.col("name").alias("__name"), F.col("form").alias("__form"), "best.*")
    return orphans.join(best, (F.col("name") == F.col("__name")) & F.col("form").eqNullSafe(F.col("__form")), "left").drop("__name", "__form")
