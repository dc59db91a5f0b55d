"""Election of each generic group's reference brand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.functions import labels, text
from apotheca.sources.store import last_per_key


def _placed(members: DataFrame, products: DataFrame) -> DataFrame:
    """Members with their product and whether they run for their group."""
    known = last_per_key(products.select("cis", "clean_name", "status", "commercial", "pos"), ["cis"], ["pos"]).drop("pos")
    runs = (F.col("type") == "0") & labels.is_active("status", "commercial") & F.col("clean_name").isNotNull()
    entry = F.struct(F.coalesce("sort_order", F.lit(999)).alias("sort_order"), "pos", "cis", F.col("clean_name").alias("name"))
    return members.join(known, "cis", "left").withColumn("entry", F.when(runs, entry))


def elect(members: DataFrame, products: DataFrame) -> DataFrame:
    """group_id, winner_cis, winner_name, runners, candidates, method.

    The active type-0 member with the least sort order wins, the first of equals. Without one the name comes from the
    group's first label. All are minima and counts, so a group of any size is summed up where its rows are read.
    """
    groups = _placed(members, products).groupBy("group_id").agg(
        F.min("entry").alias("winner"), F.count("entry").alias("runners"), F.count_if(F.col("type") == "0").alias("candidates"), F.min_by("label", "pos").alias("label")
    )
    elected = F.col("winner").isNotNull()
    return groups.select(
        "group_id",
        F.col("winner.cis").alias("winner_cis"),
        F.when(elected, F.col("winner.name")).otherwise(text.clean_fallback_label("label")).alias("winner_name"),
        "runners",
        "candidates",
        F.when(elected, "ACTIVE_PRINCEPS").otherwise("LABEL_FALLBACK").alias("method"),
    )


def secondaries(members: DataFrame, products: DataFrame, elected: DataFrame) -> DataFrame:
    """group_id, sort_order, pos, cis and name of every runner that isn't its group's winner, a row each."""
    winners = elected.filter("method = 'ACTIVE_PRINCEPS'").select("group_id", F.col("winner_cis").alias("__winner"))
    runners = _placed(members, products).filter("entry is not null").select("group_id", "entry.*")
    return runners.join(winners, "group_id").filter("cis <> __winner").select("group_id", "sort_order", "pos", "cis", "name")


def ghosts(members: DataFrame, products: DataFrame) -> DataFrame:
    """Memberships of products that don't exist, one row each."""
    return members.join(products.select("cis").distinct(), "cis", "left_anti")
