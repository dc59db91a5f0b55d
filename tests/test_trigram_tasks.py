"""Postings are made by many tasks, however small the file of texts is."""

from pyspark.sql import functions as F

from apotheca.operators import search


def test_trigrams_are_dealt(spark):
    rows = spark.range(50).select("id", F.lit("aab abaab").alias("name")).coalesce(1)
    found = search.trigrams(rows, "id", "name")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.trigram, r.n) for r in found.filter("id = 7").collect()} == {("aab", 2), ("ab ", 1), ("b a", 1), (" ab", 1), ("aba", 1), ("baa", 1)}
    assert found.count() == 300
