"""Rounding as the database has it."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from apotheca.functions.numbers import rounded


def test_rounds_as_the_database_does(spark):
    values = [0.64565, 0.64575, -0.64565, 1.00005, 2.5, 0.0, None, 1e-9, *(i / 2000 for i in range(1, 2000, 2)), *(i / 20000 for i in range(1, 20000, 10))]
    rows = pd.DataFrame({"x": values})  # noqa: F841
    want = [r[0] for r in duckdb.sql("select round(x, 4) from (select case when isnan(x) then null else x end as x from rows)").fetchall()]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", rounded(F.col("x"), 4).alias("x")).orderBy("i").collect()
    assert [r.x for r in found] == want
