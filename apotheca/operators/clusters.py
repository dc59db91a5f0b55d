"""Therapeutic clusters: groups vote on a chemical signature and merge by it; clusters get names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.operators.skew import with_group
from apotheca.sources.store import materialised


def majority_vote(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """group_id, chemical_id, votes: the most frequent signature among a group's members, first seen on ties.

    Votes are counted on the map side; groups without any profiled member are left out.
    """
    counted = members.join(profiles.select("cis", "chemical_id"), "cis").groupBy("group_id", "chemical_id").agg(F.count("*").alias("votes"), F.min("pos").alias("first"))
    best = F.max_by(F.struct("chemical_id", "votes"), F.struct("votes", -F.col("first"))).alias("best")
    return counted.groupBy("group_id").agg(best).select("group_id", "best.chemical_id", "best.votes")


def memberships(members: DataFrame, votes: DataFrame) -> DataFrame:
    """chemical_id, cluster_id, kind (group or product), id and pos (where it is first seen): a row per member.

    Nothing is gathered, whatever share of all groups a signature has.
    """
    voted = members.join(votes.select("group_id", "chemical_id"), "group_id")
    rows = [voted.select("chemical_id", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"), "pos") for kind, c in (("group", "group_id"), ("product", "cis"))]
    found = rows[0].unionByName(rows[1]).groupBy("chemical_id", "kind", "id").agg(F.min("pos").alias("pos"))
    return found.withColumn("cluster_id", cluster_key("SCL_"))


def cluster_key(prefix: str) -> Column:
    """The id of a signature's cluster."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5("chemical_id"), 1, 12)))


def name_clusters(memberships: DataFrame, elections: DataFrame) -> DataFrame:
    """chemical_id, cluster_id, groups, products, display_name and naming_method of every cluster.

    The elected names of a cluster's groups stay rows, whatever their number.
    """
    counts = memberships.groupBy("chemical_id", "cluster_id").agg(F.count_if(F.col("kind") == "group").alias("groups"), F.count_if(F.col("kind") == "product").alias("products"))
    common = common_runs(elected_names(memberships, elections), ["chemical_id"])
    display, method = text.agreed_name("common", "first_name", F.coalesce("names", F.lit(0)), "chemical_id")
    return counts.join(common, "chemical_id", "left").select(*counts.columns, display.alias("display_name"), method.alias("naming_method"))


def elected_names(memberships: DataFrame, elections: DataFrame) -> DataFrame:
    """chemical_id, cluster_id, name and pos of the winners that aren't blank, a row per group."""
    winners = elections.select(F.col("group_id").cast("string").alias("id"), F.col("winner_name").alias("name")).filter("name <> ''")
    return memberships.filter("kind = 'group'").join(winners, "id").select("chemical_id", "cluster_id", "name", "pos")


def common_runs(names: DataFrame, keys: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """keys, names (how many), first_name, first_pos and common: the longest run of words in all names of a group (T11), "" if none.

    The group's shortest name, the last of equals, gives the runs, an array bounded by its length. Each distinct name notes
    which of them it has; these are counted, and a run of all names stays. No task holds a group's names, whatever share of
    all rows it has. One name is its own answer. Null names and keys are left out.
    """
    rows = names.filter(F.col(name).isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    rows = rows.select(*keys, F.col(name).alias("__name"), F.col(pos).alias("__pos"), text.normalise_name(name).alias("__plain"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("names"), F.min_by("__name", "__pos").alias("first_name"), F.min("__pos").alias("first_pos"))
    distinct = materialised(rows.groupBy(*keys, "__plain").agg(F.max("__pos").alias("__pos")).withColumn("__words", text.run_words("__plain")), "names")
    shortest = distinct.groupBy(*keys).agg(F.count("*").alias("__n"), F.max_by("__words", F.struct(-F.size("__words"), "__pos")).alias("__short"))
    groups = materialised(shortest.select(*keys, "__n", text.word_runs("__short").alias("__runs")), "runs")
    met = with_group(distinct.select(*keys, "__plain"), groups, keys, "__n")
    found = met.select(*keys, "__n", F.explode(F.filter(F.transform("__runs", lambda run, i: F.struct(i.alias("at"), run.alias("run"))), lambda r: text.has_run("__plain", r["run"]))).alias("r"))
    best = found.groupBy(*keys, "__n", "r").agg(F.count("*").alias("__has")).filter("__has = __n").groupBy(*keys).agg(F.min(F.col("r")).alias("r"))
    common = F.when(F.col("names") == 1, F.col("first_name")).otherwise(F.coalesce("r.run", F.lit("")))
    return counted.join(best, keys, "left").select(*keys, "names", "first_name", "first_pos", common.alias("common"))


def first_names(names: DataFrame, n: int = 5) -> DataFrame:
    """cluster_id and the first n names by position (J19); rows: cluster_id, pos, name."""
    window = Window.partitionBy("cluster_id").orderBy("pos")
    kept = names.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    return kept.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("sample_names"))
