"""Attachment of ungrouped products to clusters, and the final clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.operators.clusters import cluster_key, common_runs


def orphans(products: DataFrame, members: DataFrame, votes: DataFrame) -> DataFrame:
    """Products in no profiled cluster."""
    grouped = members.join(votes.select("group_id"), "group_id", "left_semi").select("cis").distinct()
    return products.filter("not is_homeopathic").join(grouped, "cis", "left_anti")


def place_orphans(orphan_products: DataFrame, profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Orphans with chemical_id and fate: ATTACHED to the cluster of their signature, PROMOTED or NO_PROFILE."""
    known = clusters.select("chemical_id", "cluster_id")
    placed = orphan_products.join(profiles.select("cis", "chemical_id"), "cis", "left").join(known, "chemical_id", "left")
    fate = F.when(F.col("chemical_id").isNull(), "NO_PROFILE").when(F.col("cluster_id").isNull(), "PROMOTED").otherwise("ATTACHED")
    return placed.withColumn("fate", fate)


def promoted_members(placed: DataFrame) -> DataFrame:
    """chemical_id, cluster_id, cis and pos of every promoted orphan, a row each."""
    return placed.filter("fate = 'PROMOTED'").select("chemical_id", cluster_key("ORPH_").alias("cluster_id"), "cis", "pos")


def promoted_names(placed: DataFrame) -> DataFrame:
    """chemical_id, cluster_id, display_name and products of the clusters of promoted orphans."""
    grouped = placed.filter("fate = 'PROMOTED'").groupBy("chemical_id").agg(F.min_by("name", "pos").alias("first_name"), F.count("*").alias("products"))
    return grouped.select("chemical_id", cluster_key("ORPH_").alias("cluster_id"), text.promoted_name("first_name").alias("display_name"), "products")


def missing_signatures(placed: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent signatures of promoted orphans with an example."""
    grouped = placed.filter("fate = 'PROMOTED'").groupBy("chemical_id").agg(F.count("*").alias("n"), F.min_by("name", "pos").alias("example"))
    return grouped.orderBy(F.desc("n"), "chemical_id").limit(n)


def consolidate(secondaries: DataFrame) -> DataFrame:
    """cluster_id, brand and pos, a row per brand: names by first word, as their common words of 3 letters or more, else the first.

    Rows: cluster_id, pos, name.
    """
    distinct = secondaries.groupBy("cluster_id", "name").agg(F.min("pos").alias("pos"))
    families = distinct.withColumn("word", F.get(F.split(text.trim("name"), r"\s+"), F.lit(0)))
    brand = F.when(F.length("common") >= 3, F.col("common")).otherwise(F.col("first_name"))
    named = common_runs(families, ["cluster_id", "word"]).select("cluster_id", brand.alias("brand"), "first_pos")
    return named.groupBy("cluster_id", "brand").agg(F.min("first_pos").alias("pos"))


def brands(memberships: DataFrame, secondaries: DataFrame) -> DataFrame:
    """cluster_id, brand and pos of the brands beside the elected ones, in the order of groups and of their runners."""
    groups = memberships.filter("kind = 'group'").select("cluster_id", F.col("id").alias("group_id"))
    runners = secondaries.withColumn("group_id", F.col("group_id").cast("string")).join(groups, "group_id")
    return consolidate(runners.select("cluster_id", F.struct("group_id", "sort_order", "pos", "cis").alias("pos"), "name"))


def cluster_members(memberships: DataFrame, placed: DataFrame) -> DataFrame:
    """cluster_id, cis, role (GROUPED, ATTACHED, PROMOTED) and pos of every product in a cluster, a row each."""
    grouped = memberships.filter("kind = 'product'").select("cluster_id", F.col("id").alias("cis"), F.lit("GROUPED").alias("role"), "pos")
    cluster = F.coalesce("cluster_id", cluster_key("ORPH_"))
    return grouped.unionByName(placed.filter("fate <> 'NO_PROFILE'").select(cluster.alias("cluster_id"), "cis", F.col("fate").alias("role"), "pos"))


def final_clusters(named: DataFrame, placed: DataFrame, brands: DataFrame, samples: DataFrame) -> DataFrame:
    """All clusters with counts of their products and their search vector, which holds a few sample names and all brands.

    ``samples`` has cluster_id and sample_names. Products and brands are tables of their own.
    """
    attached = placed.filter("fate = 'ATTACHED'").groupBy("cluster_id").agg(F.count("*").alias("attached"))
    listed = brands.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "brand"))), lambda b: b["brand"]).alias("brands"))
    main = named.join(attached, "cluster_id", "left").join(listed, "cluster_id", "left").join(samples, "cluster_id", "left")
    vector = text.search_vector("display_name", F.array_join("brands", " "), F.array_join("sample_names", " "))
    total = F.col("products") + F.coalesce("attached", F.lit(0))
    main = main.select("cluster_id", "chemical_id", "display_name", "naming_method", total.alias("count_products"), vector.alias("search_vector"))
    alone = promoted_names(placed).select("cluster_id", "chemical_id", "display_name", F.lit("PROMOTED").alias("naming_method"), F.col("products").alias("count_products"), text.search_vector("display_name").alias("search_vector"))
    return main.unionByName(alone)
