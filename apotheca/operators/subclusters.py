"""Sub-clusters by substances and form: dosages taken off brand names by the dosages of their own sub-cluster, then clusters of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.operators.skew import with_group
from apotheca.sources.store import materialised


def by_form(products: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiled products with chemical_id, form (trimmed, lower case) and subcluster_id, a digest of both.

    products: cis, shape and more; a null or blank shape is the form "". Products without a profile are left out.
    """
    form = F.lower(F.coalesce(text.trim("shape"), F.lit("")))
    placed = products.join(profiles.filter("chemical_id is not null").select("cis", "chemical_id"), "cis").withColumn("form", form)
    return placed.withColumn("subcluster_id", F.concat(F.lit("SUB_"), F.upper(F.substring(F.md5(F.concat_ws("\x1f", "chemical_id", "form")), 1, 12))))


def dosage_spellings(dosage: Column) -> Column:
    """A dosage's spellings, in lower case: with and without space, with comma and point, and whole numbers with one zero as decimal."""
    plain = F.regexp_replace(F.lower(text.trim(dosage)), r"\s+", " ")
    number = F.regexp_extract(plain, r"^([0-9]+(?:[.,][0-9]+)?) ?[^0-9 ]", 1)
    unit = F.trim(F.substring(plain, F.length(number) + 1, F.length(plain)))
    numbers = F.when(F.regexp_like(number, F.lit("[.,]")), F.array(F.replace(number, F.lit("."), F.lit(",")), F.replace(number, F.lit(","), F.lit("."))))
    numbers = numbers.otherwise(F.array(number, F.concat(number, F.lit(",0")), F.concat(number, F.lit(".0"))))
    spelt = F.flatten(F.transform(numbers, lambda n: F.array(F.concat(n, F.lit(" "), unit), F.concat(n, unit))))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.expr("cast(array() as array<string>)")).when(number == "", F.array(plain)).otherwise(spelt)


def dosage_mask(placed: DataFrame, compositions: DataFrame) -> DataFrame:
    """subcluster_id and suffix: every spelling of every dosage that a member of the sub-cluster has."""
    dosages = compositions.select("cis", "dosage").filter(text.nonblank("dosage").isNotNull()).distinct()
    # Dosages are made distinct before they are spelt out, on the map side first.
    known = placed.select("cis", "subcluster_id").distinct().join(dosages, "cis").select("subcluster_id", "dosage").distinct()
    return known.select("subcluster_id", F.explode(dosage_spellings(F.col("dosage"))).alias("suffix")).distinct()


def without_dosages(names: DataFrame, mask: DataFrame) -> DataFrame:
    """subcluster_id, name and clean: each distinct name without the longest suffix that its sub-cluster's mask holds.

    A suffix begins where no letter, digit, point or comma stands before it, so 50 mg isn't cut from 150 mg or 0.50 mg; a name
    that is a dosage only stays. Names are split into such suffixes, which meet the mask by equality: no name is tried against
    each dosage. A suffix that a large share of all names ends in is many tasks. Null names are left out.
    """
    distinct = materialised(names.filter("name is not null and subcluster_id is not null").select("subcluster_id", "name").distinct(), "names")
    place = F.explode(F.sequence(F.lit(2), F.greatest(F.length("name"), F.lit(2))))
    ends = distinct.select("subcluster_id", "name", place.alias("at")).filter(F.regexp_like(F.substring("name", F.col("at") - 1, F.lit(1)), F.lit(r"[^\p{L}\p{N}.,]")) & F.regexp_like(F.substring("name", F.col("at"), F.lit(1)), F.lit(r"\S")))
    suffixes = ends.select("subcluster_id", "name", "at", F.lower(F.substring("name", F.col("at"), F.length("name"))).alias("suffix"))
    suffixes = suffixes.withColumn("suffix", F.rtrim("suffix"))
    keys = ["subcluster_id", "suffix"]
    found = materialised(suffixes.groupBy(*keys).agg(F.count("*").alias("__n")).join(mask, keys), "suffixes")
    longest = with_group(suffixes, found, keys, "__n").groupBy("subcluster_id", "name").agg(F.min("at").alias("at"))
    stem = F.rtrim(F.substring("name", F.lit(1), F.col("at") - 1))
    return distinct.join(longest, ["subcluster_id", "name"], "left").select("subcluster_id", "name", F.when(stem != "", stem).otherwise(text.trim("name")).alias("clean"))


def representatives(brands: DataFrame, cleaned: DataFrame) -> DataFrame:
    """chemical_id, subcluster_id, brand and votes: the most frequent clean name of each sub-cluster's brands, first seen on ties.

    brands: chemical_id, subcluster_id, name, pos. Names are counted before they are cleaned, so equal ones are joined once.
    """
    counted = brands.groupBy("chemical_id", "subcluster_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    votes = counted.join(cleaned, ["subcluster_id", "name"]).groupBy("chemical_id", "subcluster_id", "clean").agg(F.sum("n").alias("votes"), F.min("pos").alias("pos"))
    best = F.max_by(F.struct("clean", "votes"), F.struct("votes", -F.col("pos"))).alias("best")
    return votes.groupBy("chemical_id", "subcluster_id").agg(best).select("chemical_id", "subcluster_id", F.col("best.clean").alias("brand"), "best.votes")


def merged(chosen: DataFrame) -> DataFrame:
    """Sub-clusters with cluster_id and merged_forms: those of equal substances and equal brand are one cluster, others stay apart."""
    digest = F.concat(F.lit("CLS_"), F.upper(F.substring(F.md5(F.concat_ws("\x1f", "chemical_id", F.upper("brand"))), 1, 12)))
    keyed = chosen.withColumn("cluster_id", digest)
    sizes = materialised(keyed.groupBy("cluster_id").agg(F.count("*").alias("merged_forms")), "merged")
    return with_group(keyed, sizes, ["cluster_id"], "merged_forms")
