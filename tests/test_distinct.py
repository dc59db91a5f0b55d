"""Costly columns are computed once for each distinct input, over many tasks, with every row kept."""

from pyspark.sql import functions as F

from apotheca.operators import distinct


def test_each_text_is_rewritten_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        calls.add(1)
        return None if x is None else x.upper()

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("name")).coalesce(1)
    found = distinct.once_each(rows, {"text": F.col("name")}, {"up": slow("text")})
    got = {r.id: (r.name, r.up) for r in found.collect()}
    assert got == {i: (f"t{i % 7}", f"T{i % 7}") if i % 7 else (None, None) for i in range(3000)}
    assert calls.value == 7
    assert distinct.dealt(rows).rdd.getNumPartitions() >= 12
