"""Chemical profiles: substances and their canonical names, resolved composition rows, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apotheca.functions import text


def of_products(composition: DataFrame, products: DataFrame) -> DataFrame:
    """Composition rows of the given products only."""
    return composition.join(products.select("cis").distinct(), "cis", "left_semi")


def substance_names(composition: DataFrame) -> DataFrame:
    """code, variants (distinct normalised names in first-seen order), canonical, strategy.

    One variant is UNIQUE; else the shortest with a bracketed part, PARENTHESIS; else the shortest, SHORTEST. Ties go
    to the one seen first.
    """
    variants = composition.select("code", text.normalise_profile("substance").alias("name"), "pos").groupBy("code", "name").agg(F.min("pos").alias("first"))
    rank = F.struct(F.length("name"), F.col("first"))
    bracketed = (F.instr("name", "(") > 1) & F.contains("name", F.lit(")"))
    votes = variants.groupBy("code").agg(
        F.count("*").alias("n"),
        F.min_by("name", rank).alias("shortest"),
        F.min_by("name", F.when(bracketed, rank)).alias("__nested"),
        F.max(bracketed).alias("any_bracketed"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda v: v["name"]).alias("variants"),
    )
    canonical = F.when((F.col("n") > 1) & F.col("any_bracketed"), F.col("__nested")).otherwise(F.col("shortest"))
    strategy = F.when(F.col("n") == 1, "UNIQUE").when(F.col("any_bracketed"), "PARENTHESIS").otherwise("SHORTEST")
    return votes.select("code", "variants", canonical.alias("canonical"), strategy.alias("strategy"))


def resolve_links(composition: DataFrame) -> DataFrame:
    """One row per linked set of a product: its first FT or ST row, else its first; unlinked rows all stay."""
    window = Window.partitionBy("cis", "link").orderBy(F.col("nature").isin("FT", "ST").desc(), "pos")
    linked = composition.filter("link <> ''").withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")
    return composition.filter("link = ''").unionByName(linked)


def conflicts(composition: DataFrame) -> DataFrame:
    """One row: linked sets with more than one row."""
    return composition.filter("link <> ''").groupBy("cis", "link").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("conflicts"))


def signatures(resolved: DataFrame) -> DataFrame:
    """cis, chemical_id (sorted codes joined by +, repeats kept) and substances of each product (A10)."""
    return resolved.groupBy("cis").agg(
        F.array_join(F.array_sort(F.collect_list("code")), "+").alias("chemical_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("code", "pos", "substance", "dosage"))), lambda s: F.struct(s["code"].alias("code"), s["substance"].alias("name"), s["dosage"].alias("dosage"))).alias("substances"),
    )
