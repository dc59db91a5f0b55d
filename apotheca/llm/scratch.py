"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Where that is unset, as in tests on one machine, a temporary folder
is made; on a cluster that is an error, since other machines would not see it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="apotheca-"))
    return f"file://{_LOCAL[0]}"


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send at most so many rows at once to Python, for rows that are long; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Table:
    """A DataFrame written as Parquet and read back, so that its lineage is cut and a lost executor costs nothing.

    rows: most rows that it can have, where that is known; then few rows are not spread over as many files as a shuffle has
    partitions. Three tasks a core stay, and one for each ``a_file`` rows.
    """

    def __init__(self, df: DataFrame, name: str, rows: int | None = None, a_file: int = 1 << 16):
        self.spark = df.sparkSession
        if rows is not None:
            df = df.coalesce(max(3 * self.spark.sparkContext.defaultParallelism, -(-rows // a_file)))
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; for tables that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: DataFrame, id_col: str, size: int, count: int | None = None) -> DataFrame:
    """The first ``size`` rows in the order of a hash of their id; count: of the rows, if it is known.

    Hashes beyond four times that share of all are left out before rows are ordered, so a task passes on hardly
    more than its part of the sample, however many tasks there are. For few columns, best the id alone.
    """
    count = rows.count() if count is None else count
    hashed = rows.withColumn("__hash", F.xxhash64(id_col))
    if count > 4 * size:
        hashed = hashed.filter(F.col("__hash") < -(2**63) + int(2**64 * (4 * size / count)))
    return hashed.orderBy("__hash", id_col).limit(size).drop("__hash")


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows``, ``total`` in number, left joined with their classes by ``keys``; classes have the column copies.

    Classes of more than a thousandth of all rows, of which there are at most a thousand, are broadcast. So rows
    of a common class stay where they are, and no key of the other join has more than that share.
    """
    least = max(total // 1000, 1)
    large, others = classes.filter(F.col("copies") > least).drop("copies"), classes.filter(F.col("copies") <= least).drop("copies")
    found = rows.join(F.broadcast(large.withColumn("__large", F.lit(True))), keys, "left")
    common = found.filter("__large").drop("__large")
    return common.unionByName(rows.join(F.broadcast(large), keys, "left_anti").join(others, keys, "left"))
