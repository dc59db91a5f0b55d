"""Costly rewrites of texts, once for each distinct text and dealt over all cores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as a shuffle has, and three a core at least: a small file of many rows is one task to read,
    and adaptive planning would join tasks by their bytes, however long their rows take."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def once_each(rows: DataFrame, inputs: dict[str, Column], results: dict[str, Column]) -> DataFrame:
    """``rows`` with ``results``, columns of ``inputs`` alone that are computed once for each distinct row of these."""
    named = rows.select("*", *(c.alias(name) for name, c in inputs.items()))
    done = dealt(named.select(*inputs).distinct()).select(*(F.col(name).alias(f"__{name}") for name in inputs), *(c.alias(name) for name, c in results.items()))
    same = reduce(lambda a, b: a & b, (F.col(name).eqNullSafe(F.col(f"__{name}")) for name in inputs))
    return named.join(done, same, "left").select(*rows.columns, *results)
