"""Connected components by alternating large-star and small-star.

Edges are rows, neighbourhoods are never gathered: each star step is a minimum per node, summed on the map
side, joined back to the edges. Every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.llm.scratch import Table


EDGES_A_FILE = 8192


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str, most: int | None = None) -> Table:
    """Table (node, root) of every linked node and the smallest node it can reach; a root is not listed.

    Loops, repeated links and nulls are ignored; an empty table of links gives an empty table.
    most: of links, if that is known.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    table = Table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges", most)
    digest = _digest(table.df)
    while digest[0]:
        # There are never more edges than before, so few are not spread over very many files.
        after = Table(_small_star(_large_star(table.df)).coalesce(max(1, -(-digest[0] // EDGES_A_FILE))), "edges")
        table.drop()
        table, before, digest = after, digest, _digest(after.df)
        if digest == before:
            break
    table.df = table.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return table
