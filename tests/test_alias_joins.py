"""Renames are joined without sending tables through the driver."""

from pyspark.sql import functions as F

from apotheca.operators import aliases
from apotheca.operators.skew import with_group


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_large_groups_are_broadcast(spark):
    ids = spark.range(5000)
    known = ids.select(F.col("id").alias("cluster_id"), F.array(F.lit("LOCAL")).alias("routes"), F.array(F.lit("A01")).alias("atc"), F.lit(None).cast("array<string>").alias("bridges"))
    renames = ids.filter("id > 0").select(F.col("id").alias("alias"), F.floor(F.col("id") / 2).alias("target"))
    allowed = aliases.allowed(renames, known)
    assert "Broadcast" not in plan(allowed)
    roots = aliases.resolve(allowed)
    found = aliases.canonical(ids.select(F.col("id").alias("cluster")), roots, "cluster")
    assert "Broadcast" not in plan(found)
    assert found.distinct().collect()[0].cluster == 0 and found.count() == 5000
    groups = renames.groupBy("target").agg(F.count("*").alias("n"))
    met = plan(with_group(renames, groups, ["target"], "n"))
    assert met.count("SortMergeJoin") == 1
