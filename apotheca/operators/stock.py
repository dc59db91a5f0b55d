"""Stock and settings as event logs: deterministic folds that give the state after all changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.sources.store import materialised


def accumulate(adds: DataFrame, key: str, amount: str, order: list[str], keep: list[str]) -> DataFrame:
    """Accumulating upsert: amounts add up, other columns keep their first values, the last change is noted (M3, M4)."""
    at = F.struct(*order)
    return adds.groupBy(key).agg(F.sum(amount).alias("stock_count"), *(F.min_by(c, at).alias(c) for c in keep), F.max(order[0]).alias("updated_at"))


def _lows(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """Of each run of a key in a sorted batch: its sum, its least prefix sum, and the prefix sums that are record lows."""
    part = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(batches):
        found: list[tuple[int, int, int, list[int]]] = []
        before: object = found
        total, least, lows = 0, 0, []
        keys = batch.column(0).to_pylist()
        for i, (key, change) in enumerate(zip(keys, batch.column(1).to_pylist(), strict=True)):
            if key != before:
                if i:
                    found.append((i - 1, total, least, lows))
                before, total, least, lows = key, 0, 0, []
            total += change
            if total < least or (total == least and not strict):
                least = total
                lows.append(total)
        if keys:
            found.append((len(keys) - 1, total, least, lows))
            at, totals, leasts, all_lows = zip(*found, strict=True)
            columns = [batch.column(0).take(pa.array(at)), pa.array([part + number] * len(at), pa.int64()), pa.array(totals, pa.int64()), pa.array(leasts, pa.int64()), pa.array(all_lows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "__chunk", "__total", "__least", "__lows"])


def fold_quantity(changes: DataFrame, key: str, delta: str, order: list[str], allow_zero: bool = False) -> DataFrame:
    """Quantity and number of deletions after all changes in order (M5).

    A quantity that falls to zero or below (below zero with allow_zero) deletes the item; the next change
    begins again from nothing. A null change changes nothing.

    The quantity is q = max(0, q + d), so changes are sorted by key and order over all tasks and cut into chunks, whose
    sums and least prefix sums give the quantity before each chunk. A chunk's deletions are its record lows that reach
    minus that quantity. No task needs a key's changes together.
    """
    known = changes.withColumn("__delta", F.col(delta).cast("long"))
    ordered = known.filter("__delta is not null").select(key, *order, "__delta").repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, "__delta")
    schema = T.StructType([changes.schema[key]]).add("__chunk", "long").add("__total", "long").add("__least", "long").add("__lows", T.ArrayType(T.LongType()))
    chunks = materialised(ordered.mapInArrow(lambda batches: _lows(batches, allow_zero), schema), "quantities")
    zero = F.lit(0).cast("long")
    sums = chunks.select(F.col(key).alias("__key"), F.col("__chunk").alias("__at"), "__total", "__least")
    earlier = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__total").over(earlier), zero)).withColumn("__low", F.col("__before") + F.col("__least"))
    sums = sums.withColumn("__start", F.col("__before") - F.least(zero, F.coalesce(F.min("__low").over(earlier), zero))).select("__key", "__at", "__start")
    both = chunks.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__at")))
    gone = F.size(F.filter("__lows", lambda low: (low < -F.col("__start")) if allow_zero else (low <= -F.col("__start")))).cast("long")
    after = F.greatest(F.col("__start") + F.col("__total"), F.col("__total") - F.col("__least"))
    return both.groupBy(key).agg(F.max_by(after, "__chunk").alias("quantity"), F.sum(gone).alias("deletions"))


def set_quantity(changes: DataFrame, key: str, quantity: str, order: list[str]) -> DataFrame:
    """The last quantity set; a negative one deletes the item (M6)."""
    return changes.groupBy(key).agg(F.max_by(quantity, F.struct(*order)).alias("quantity")).filter("quantity >= 0")


def toggled(changes: DataFrame, key: str) -> DataFrame:
    """Whether a flag is on after all its toggles (M8)."""
    return changes.groupBy(key).agg((F.count("*") % 2 == 1).alias("checked"))


def mark_duplicates(scans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Scans with outcome added for the first of a box and duplicate for the others (M9).

    Null boxes are a box too; of scans equal in order one is the first. Firsts are aggregated, on the map side first, and met by an
    id of the row, which no two rows share, so a box of any number of scans is many tasks.
    """
    numbered = materialised(scans.withColumn("__id", F.monotonically_increasing_id()), "scans")
    firsts = numbered.groupBy(*keys).agg(F.min(F.struct(*order, "__id")).alias("__at")).select("__at.__id", F.lit(True).alias("__is_first"))
    return numbered.join(firsts, "__id", "left").select(*scans.columns, F.when(F.col("__is_first"), "added").otherwise("duplicate").alias("outcome"))


def add_unique_boxes(scans: DataFrame, box: list[str], item: str, order: list[str]) -> DataFrame:
    """Stock per item from distinct boxes; duplicates don't count."""
    return scans.select(item, *box).distinct().groupBy(item).agg(F.count("*").alias("stock_count"))


def delete_cascade(items: DataFrame, scans: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Items and their scans without the deleted ones (M7)."""
    return items.join(gone, key, "left_anti"), scans.join(gone, key, "left_anti")


def last_flag(rows: DataFrame, key: str, flag: Column, order: list[str]) -> DataFrame:
    """The flag of each key's last row."""
    return rows.groupBy(key).agg(F.max_by(F.coalesce(flag, F.lit(False)), F.struct(*order)).alias("flag"))


def update_from(rows: DataFrame, changes: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Rows with a column replaced by the last matching change, if there is one."""
    last = changes.groupBy(key).agg(F.max_by(column, order).alias("__new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def settings(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key; null is a deletion."""
    return log.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("value")), F.struct(*order)).alias("s")).select(key, "s.value").filter("value is not null")
