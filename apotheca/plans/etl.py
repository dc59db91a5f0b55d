"""The batch job: four raw files to the catalogue's clusters, with a quality gate before anything is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apotheca.operators import clusters, elections, integration, profiles
from apotheca.sources import tsv
from apotheca.sources.store import materialised


@dataclass(frozen=True)
class Catalogue:
    products: DataFrame
    members: DataFrame
    packages: DataFrame
    composition: DataFrame
    profiles: DataFrame
    elections: DataFrame
    votes: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    cluster_brands: DataFrame
    placed: DataFrame


def read(spark: SparkSession, folder: str) -> tuple[tsv.Parsed, tsv.Parsed, tsv.Parsed, tsv.Parsed]:
    load = lambda name: tsv.lines(spark, f"{folder}/{name}")
    return tsv.products(load("products.tsv")), tsv.members(load("members.tsv")), tsv.packages(load("packages.tsv")), tsv.compositions(load("composition.tsv"))


def build(products: DataFrame, members: DataFrame, packages: DataFrame, composition: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> Catalogue:
    """All phases; ``keep`` may write what several of them read."""
    resolved = profiles.resolve_links(profiles.of_products(composition, products.filter("not is_homeopathic")))
    profiled = keep(profiles.signatures(resolved), "profiles")
    elected = keep(elections.elect(members, products), "elections")
    votes = keep(clusters.majority_vote(members, profiled), "votes")
    belonging = keep(clusters.memberships(members, votes), "memberships")
    named = keep(clusters.name_clusters(belonging, elected), "named")
    placed = keep(integration.place_orphans(integration.orphans(products, members, votes), profiled, named), "placed")
    brands = keep(integration.brands(belonging, elections.secondaries(members, products, elected)), "brands")
    final = integration.final_clusters(named, placed, brands, clusters.first_names(clusters.elected_names(belonging, elected)))
    return Catalogue(products, members, packages, composition, profiled, elected, votes, final, integration.cluster_members(belonging, placed), brands, placed)


def quality(catalogue: Catalogue) -> DataFrame:
    """One row of the rates that the phases are judged by."""
    rate = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    p = catalogue.products.agg(F.count("*").alias("products"), rate(F.col("is_homeopathic")).alias("homeopathic_rate"), rate(F.col("is_suspect_name")).alias("suspect_name_rate"))
    e = catalogue.elections.agg(F.count("*").alias("groups"), rate(F.col("method") == "LABEL_FALLBACK").alias("fallback_rate"))
    o = catalogue.placed.agg(F.count("*").alias("orphans"), rate(F.col("fate") == "NO_PROFILE").alias("no_profile_rate"))
    return p.crossJoin(e).crossJoin(o)


def issues(rates: DataFrame, limits: dict[str, float]) -> DataFrame:
    """rate_name, value, most of each rate that is above its limit."""
    rows = F.array(*(F.struct(F.lit(k).alias("rate_name"), F.col(k).alias("value"), F.lit(v).alias("most")) for k, v in limits.items()))
    return rates.select(F.explode(rows).alias("r")).select("r.*").filter("value > most")


def run(spark: SparkSession, folder: str, out: str, limits: dict[str, float] | None = None) -> Catalogue:
    """Read, build, judge, and write; nothing is written to ``out`` if a rate is above its limit.

    Files are parsed once and every phase runs once: they are kept in the shared folder, so that positions stay the
    same and a lost executor costs no more than its tasks.
    """
    parsed = read(spark, folder)
    catalogue = build(*(materialised(p.rows, f"parsed-{i}") for i, p in enumerate(parsed)), keep=materialised)
    found = issues(quality(catalogue), limits).collect() if limits else []
    if found:
        raise ValueError(f"quality gate: {[(r['rate_name'], r['value']) for r in found]}")
    for name in ("products", "members", "packages", "elections", "clusters", "cluster_members", "cluster_brands", "placed"):
        getattr(catalogue, name).write.mode("overwrite").parquet(f"{out}/{name}")
    return catalogue
