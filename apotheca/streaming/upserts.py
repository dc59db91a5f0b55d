"""Stock and views that follow a stream: each micro-batch is merged once into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apotheca.operators.stock import accumulate
from apotheca.sources.versions import BucketedTable


class Stock:
    """Accumulating upsert (M3, M4): amounts add up, other columns keep their first values, the last change is noted."""

    def __init__(self, table: BucketedTable, key: str, amount: str, order: list[str], keep: list[str]):
        self.table, self.key, self.amount, self.order, self.keep = table, key, amount, order, keep

    def merge(self, batch: DataFrame, number: int) -> list[int] | None:
        at = F.struct(*self.order)
        # What a row keeps goes with its place in order, since batches may come in any order.
        summed = accumulate(batch, self.key, self.amount, self.order, self.keep)
        first = batch.groupBy(self.key).agg(F.min(at).alias("first_at"))
        return self.table.merge(summed.join(first, self.key), number, self._combined)

    def _combined(self, rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.unionByName(changes.select(*rows.columns))
        kept = [F.min_by(c, "first_at").alias(c) for c in self.keep]
        return both.groupBy(self.key).agg(F.sum("stock_count").alias("stock_count"), *kept, F.max("updated_at").alias("updated_at"), F.min("first_at").alias("first_at"))


class Boxes:
    """Distinct boxes (M10): a box counts once, in whichever batch it comes first."""

    def __init__(self, table: BucketedTable):
        self.table = table

    def merge(self, batch: DataFrame, number: int) -> list[int] | None:
        return self.table.merge(batch.select(*self.table.schema.names).distinct(), number, lambda rows, changes: rows.unionByName(changes).distinct())


class ClusterView:
    """Members, lowest and highest value of each cluster, kept up to date from signed changes (ST6, M13, A1).

    A change is a row (cluster, value, sign): 1 for a row that comes, -1 for one that goes; a row that changes is both.
    Values are counted, so that the next lowest is known when the lowest goes. ``values`` and ``view`` have the cluster as
    their key; a batch rewrites only buckets of clusters that it touches.
    """

    def __init__(self, spark: SparkSession, path: str, cluster: str, cluster_type: str, value_type: str, buckets: int = 16):
        self.cluster = cluster
        self.values = BucketedTable(spark, f"{path}/values", f"{cluster} {cluster_type}, value {value_type}, n long", [cluster], buckets)
        self.view = BucketedTable(spark, f"{path}/view", f"{cluster} {cluster_type}, members long, lowest {value_type}, highest {value_type}", [cluster], buckets)

    def merge(self, changes: DataFrame, number: int) -> list[int] | None:
        """Both tables have the batch, or the next call with it brings the second up to the first."""
        if self.view.version() > number:
            return None
        deltas = changes.groupBy(self.cluster, "value").agg(F.sum("sign").cast("long").alias("n")).filter("n <> 0")

        def counted(rows: DataFrame, more: DataFrame) -> DataFrame:
            return rows.unionByName(more.select(*rows.columns)).groupBy(self.cluster, "value").agg(F.sum("n").alias("n")).filter("n <> 0")

        self.values.merge(deltas, number, counted)
        touched = changes.select(self.cluster).distinct()
        # Of the version that this batch made, so a batch that is delivered again finds what it found at first.
        counts = self.values.read(version=number + 1)

        def shown(rows: DataFrame, touched: DataFrame) -> DataFrame:
            now = counts.join(touched, self.cluster, "left_semi").groupBy(self.cluster).agg(F.sum("n").alias("members"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
            return rows.join(touched, self.cluster, "left_anti").unionByName(now.select(*rows.columns))

        return self.view.merge(touched, number, shown)


def follow(stream: DataFrame, merge: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    """Everything there is now, batch by batch (ST6); what is merged twice after a failure counts once."""
    stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
