"""Clusters that are other clusters by a table of renames, and which of these merges routes and ATC codes allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions import words
from apotheca.operators.skew import with_group
from apotheca.sources.store import materialised


def route_groups(routes: Column) -> Column:
    """The groups that a product's routes belong to, from names between semicolons; a route may be of two groups."""
    names = F.transform(F.split(F.coalesce(F.upper(routes), F.lit("")), ";"), lambda r: F.trim(r))
    member = [F.when(F.arrays_overlap(names, F.array(*(F.lit(r) for r in listed))), group) for group, listed in words.ROUTE_GROUPS.items()]
    return F.array_compact(F.array(*member))


def routes_fit(source: Column, target: Column) -> Column:
    """Whether some route group of the source may go into one of the target; none known fits all. Not the same both ways."""
    pairs = [F.array_contains(source, a) & F.array_contains(target, b) for a, b in words.ROUTE_MERGES]
    fits = F.lit(False)
    for pair in pairs:
        fits = fits | pair
    unknown = lambda groups: F.size(F.coalesce(groups, F.array())) == 0
    return unknown(source) | unknown(target) | F.coalesce(fits, F.lit(False))


def atc_fits(source: Column, target: Column, bridges: Column | None = None, least: int = 3) -> Column:
    """Whether a code of one is above or below a code of the other, or their first ``least`` characters are equal; no codes fit all.

    bridges: roots that the target may hold side by side; all codes of both must be under them.
    """
    known = lambda codes: F.filter(F.coalesce(codes, F.expr("cast(array() as array<string>)")), lambda c: F.length(F.trim(c)) > 0)
    a, b = known(source), known(target)
    related = lambda x, y: F.startswith(x, y) | F.startswith(y, x) | ((F.length(x) >= least) & (F.length(y) >= least) & (F.substring(x, 1, least) == F.substring(y, 1, least)))
    fits = (F.size(a) == 0) | (F.size(b) == 0) | F.exists(a, lambda x: F.exists(b, lambda y: related(x, y)))
    if bridges is None:
        return fits
    under = F.forall(F.concat(a, b), lambda c: F.exists(bridges, lambda r: F.startswith(c, r)))
    return fits | F.coalesce(under, F.lit(False))


def allowed(aliases: DataFrame, clusters: DataFrame) -> DataFrame:
    """The renames whose two clusters fit by route and by ATC code.

    aliases: alias, target. clusters: cluster_id, routes (groups), atc (codes), bridges (roots, or null). A target that is no
    cluster is a name only, and fits.
    """
    sides = [clusters.select(F.col("cluster_id").alias(key), *(F.col(c).alias(f"__{key}_{c}") for c in ("routes", "atc", "bridges"))) for key in ("alias", "target")]
    both = aliases.join(sides[0].hint("merge"), "alias", "left").join(sides[1].hint("merge"), "target", "left")
    fits = routes_fit(F.col("__alias_routes"), F.col("__target_routes")) & atc_fits(F.col("__alias_atc"), F.col("__target_atc"), F.col("__target_bridges"))
    return both.filter(fits).select("alias", "target")


def resolve(aliases: DataFrame) -> DataFrame:
    """alias and root: the end of each chain of renames, by pointer doubling.

    Of several targets of an alias the smallest counts; an alias of itself, a null alias and a null target are no rename. A
    chain that runs into a cycle ends at the cycle's smallest id. Each step halves the way that is left: a pointer jumps over
    its target's pointer and notes the smallest id that it has passed. Steps end when all pointers are at ends, or have passed
    more ids than there are, which only those into cycles do. Targets that many aliases share are many tasks. Joins are merges here and
    in ``allowed`` and ``canonical``: the files of these tables are small for their rows, so the planner would send all rows through the driver.
    """
    single = aliases.filter("alias is not null and target is not null and alias <> target").groupBy("alias").agg(F.min("target").alias("to"))
    links = materialised(single.withColumn("low", F.col("to")), "links")
    total, length = links.count(), 1
    while True:
        open_ends = links.groupBy("to").agg(F.count("*").alias("__n"))
        onward = materialised(open_ends.join(links.select(F.col("alias").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low")).hint("merge"), "to"), "onward")
        if onward.isEmpty():
            return links.select("alias", F.col("to").alias("root"))
        if length >= total:
            # What still goes on is on a cycle or leads into one; a pointer's own lows are those of the whole cycle.
            ends = onward.select("to", F.col("__low").alias("root"), "__n")
            into = with_group(links, ends, ["to"], "__n").select("alias", "root")
            return into.unionByName(links.join(ends.select("to").hint("merge"), "to", "left_anti").select("alias", F.col("to").alias("root")))
        jumped = with_group(links, onward, ["to"], "__n").select("alias", F.col("__to").alias("to"), F.least("low", "__low").alias("low"))
        stay = links.join(onward.select("to").hint("merge"), "to", "left_anti").select("alias", "to", "low")
        links = materialised(jumped.unionByName(stay), "links")
        length *= 2


def canonical(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Rows with the column's alias replaced by its root."""
    return rows.join(roots.withColumnRenamed("alias", column).withColumnRenamed("root", "__root").hint("merge"), column, "left").withColumn(column, F.coalesce("__root", column)).select(*rows.columns)
