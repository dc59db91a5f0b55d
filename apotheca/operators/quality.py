"""Reports on the catalogue's quality, and the naming strategies that are compared by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions import labels
from apotheca.functions.numbers import rounded

#: Short names that are right.
SHORT_NAMES = ("ZINC", "FER", "EAU", "GEL", "AIR", "SEL")


def distribution(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values, ties by value."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition, 0 without rows; null counts as no."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive (A3)."""
    return F.when(b > 0, a / b).otherwise(0.0)


def split_substances(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """Labels that stand in more than one cluster."""
    return rows.groupBy(label).agg(F.count_distinct(cluster).alias("clusters")).filter("clusters > 1")


def top_missing(rows: DataFrame, signature: str, name: str, order: str, n: int = 10) -> DataFrame:
    """The n most frequent signatures with their first name."""
    return rows.groupBy(signature).agg(F.count("*").alias("n"), F.min_by(name, order).alias("example")).orderBy(F.desc("n"), signature).limit(n)


def strategy_summary(scored: DataFrame, result: str) -> DataFrame:
    """Per method of a strategy's results: how many, and their mean confidence, summed as decimals so that no order of rows matters."""
    total = F.sum(F.col(f"{result}.confidence").cast("decimal(9,2)")).cast("double")
    return scored.groupBy(F.col(f"{result}.method").alias("method")).agg(F.count("*").alias("n"), rounded(total / F.count("*"), 4).alias("mean_confidence"))


def reference_of_group(members: DataFrame, order: list[str]) -> DataFrame:
    """The last type-0 product of each group."""
    return members.filter("type = '0'").groupBy("group_id").agg(F.max_by("cis", F.struct(*order)).alias("reference_cis"))


def cluster_metrics(clusters: DataFrame) -> DataFrame:
    """One row: clusters, share of promoted ones, share with a reference brand, names too short to be right."""
    name = F.coalesce(F.nullif("cluster_princeps", F.lit("")), F.col("cluster_name"))
    short = (F.length(name) < 4) & ~F.upper(name).isin(*SHORT_NAMES)
    return clusters.agg(
        F.count("*").alias("total_clusters"),
        rounded(rate(F.startswith("cluster_name", F.lit("ORPH_"))), 6).alias("orphan_rate"),
        rounded(rate(F.coalesce("cluster_princeps", F.lit("")) != ""), 6).alias("princeps_coverage"),
        F.count_if(short).alias("short_name_alerts"),
    )


def exists(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row meets a condition (A36); one row is enough for each task."""
    return rows.filter(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def cluster_flags(members: DataFrame, conditions: DataFrame) -> DataFrame:
    """cluster_id, flag and products: a flag of any member's condition is its cluster's, with how many members have it.

    members: cluster_id, cis. conditions: cis, condition, any number a product. Flags are made distinct per product first.
    """
    flags = conditions.select("cis", F.explode(labels.prescription_flags("condition")).alias("flag")).distinct()
    return members.select("cluster_id", "cis").distinct().join(flags, "cis").groupBy("cluster_id", "flag").agg(F.count("*").alias("products"))
