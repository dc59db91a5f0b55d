"""Barcode scans: cooldown, decisions, recent lists, debounce. Each as a batch fold; cooldown and boxes also as streams.

Times are event times, so results don't depend on when a job runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from apotheca.operators.catalogue import ranked
from apotheca.sources.store import materialised

#: Fixed value: microseconds beyond any time.
_FOREVER = 2**61


def _segments(batches: Iterator[pa.RecordBatch], key: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each run of a key in a sorted batch as one row: its times, which scans are forced, its scans."""
    part = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(batches):
        keys = batch.column(key).to_pylist()
        if keys:
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            listed = lambda c: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), c)  # noqa: B023, E731
            rows = pa.StructArray.from_arrays(batch.columns[:-2], fields=list(batch.schema)[:-2])
            columns = [batch.column(key).take(pa.array(cuts[:-1])), pa.array([part + number] * (len(cuts) - 1), pa.int64()), listed(batch.column(-2)), listed(batch.column(-1)), listed(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _following(times: list[int], forced: list[bool], span: int) -> list[int]:
    """Of each scan, the next that is accepted if it is; the number of scans if there is none."""
    out, j, force = [len(times)] * len(times), len(times), len(times)
    for i in reversed(range(len(times))):
        while j > i + 1 and times[j - 1] - times[i] >= span:
            j -= 1
        out[i] = min(j, force)
        force = i if forced[i] else force
    return out


def _entered(times: list[int], forced: list[bool], last: int | None, span: int) -> int:
    """The first scan that is accepted after that time."""
    first = 0 if last is None else bisect_left(times, last + span)
    return next((i for i in range(first) if forced[i]), first)


def _steps(batches: Iterator[pa.RecordBatch], span: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What a segment makes of the last accepted time before it: up to each time less the span, the time it leaves."""
    for batch in batches:
        ups, lasts = [], []
        for times, forced in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            after, leaves = _following(times, forced, span), [0] * len(times)
            for i in reversed(range(len(times))):
                leaves[i] = times[i] if after[i] == len(times) else leaves[after[i]]
            # Up to the first forced scan, which is entered from any time; beyond a span after the first nothing is entered.
            end = next((i for i, f in enumerate(forced) if f), None)
            most = min(len(times), bisect_left(times, times[0] + span) + 1)
            up, last = [], []
            for i in range(most if end is None else min(most, end + 1)):
                at = _FOREVER if i == end else times[i]
                if last and last[-1] == leaves[i]:
                    up[-1] = at
                else:
                    up.append(at)
                    last.append(leaves[i])
            ups.append(up)
            lasts.append(last)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ups, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.int64()))], names=names)


def _carried(batches: Iterator[pa.RecordBatch], span: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last accepted time before each segment, of segments sorted by key; one number is carried."""
    before, last = object(), None
    for batch in batches:
        found = []
        for key, ups, lasts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if key != before:
                before, last = key, None
            found.append(last)
            at = 0 if last is None else bisect_left(ups, last + span)
            last = lasts[at] if at < len(lasts) else last
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=names)


def _accepted(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        taken = []
        for times, forced, last in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            after, ok = _following(times, forced, span), [False] * len(times)
            i = _entered(times, forced, last, span)
            while i < len(times):
                ok[i] = True
                i = after[i]
            taken.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(taken, pa.list_(pa.bool_()))], names=["__rows", "__taken"])


def cooldown(scans: DataFrame, key: str, ts: str, seconds: int, tie: str, forced: Column | None = None) -> DataFrame:
    """Scans with accepted: at least so long after the key's last accepted scan, or forced (ST1).

    Scans are sorted by key and time over all tasks and cut into segments. A segment is summarised as a step function
    of the last accepted time before it; these are applied in order, carrying one number, and then each segment is
    decided by itself. No task holds a key's scans; only the steps of a key pass through one task.
    """
    span, names = seconds * 1_000_000, scans.columns
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    force = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    timed = scans.withColumn("__t", F.coalesce(micros, F.lit(-_FOREVER))).withColumn("__force", force | micros.isNull())
    ordered = timed.repartitionByRange(key, "__t", tie).sortWithinPartitions(key, "__t", tie)
    longs, head = T.ArrayType(T.LongType()), lambda: T.StructType([T.StructField("__key", scans.schema[key].dataType), T.StructField("__chunk", T.LongType())])
    split = head().add("__times", longs).add("__forced", T.ArrayType(T.BooleanType())).add("__rows", T.ArrayType(scans.schema))
    stepped, started = head().add("__up", longs).add("__last", longs), head().add("__start", "long")
    at = names.index(key)
    segments = materialised(ordered.mapInArrow(lambda b: _segments(b, at, split.names), split), "segments")
    steps = segments.select("__key", "__chunk", "__times", "__forced").mapInArrow(lambda b: _steps(b, span, stepped.names), stepped)
    starts = steps.repartition("__key").sortWithinPartitions("__key", "__chunk").mapInArrow(lambda b: _carried(b, span, started.names), started)
    starts = starts.select(F.col("__key").alias("__key2"), F.col("__chunk").alias("__chunk2"), "__start")
    both = segments.join(starts, F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__chunk") == F.col("__chunk2"))).select("__times", "__forced", "__start", "__rows")
    decided = T.StructType().add("__rows", T.ArrayType(scans.schema)).add("__taken", T.ArrayType(T.BooleanType()))
    pairs = both.mapInArrow(lambda b: _accepted(b, span), decided).select(F.explode(F.arrays_zip("__rows", "__taken")).alias("p"))
    return pairs.select("p.__rows.*", F.col("p.__taken").alias("accepted"))


def cooldown_stream(scans: DataFrame, key: str, ts: str, seconds: int, tie: str, buckets: int = 4096) -> DataFrame:
    """The accepted scans of a stream (key, ts, tie); one number per key is kept as state (ST1).

    Keys are dealt into buckets, whose state is the last accepted time of each of its keys, so a micro-batch calls for Python once a
    bucket, however many keys there are. Scans of a micro-batch are taken in order; one that is older than the last accepted is not accepted.
    """
    schema = scans.select(key, ts, tie).schema
    names, span = [key, ts, tie], seconds * 1_000_000

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([ts, tie], kind="stable")
        taken = []
        for name, at in zip(rows["__name"].tolist(), rows[ts].to_numpy().astype("datetime64[us]").astype("int64").tolist(), strict=True):
            last = known.get(name)
            ok = last is None or at - last >= span
            if ok:
                known[name] = at
            taken.append(ok)
        state.update((list(known), list(known.values())))
        yield rows[taken][names]

    # Null keys are a bucket of their own, for pandas has no integers beside them.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    dealt = scans.select(*names, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__name"), bucket.alias("__bucket"))
    return dealt.groupBy("__bucket").applyInPandasWithState(keep, schema, "names array<string>, lasts array<long>", "append", GroupStateTimeout.NoTimeout)


def unique_boxes_stream(scans: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """The first scan of each box within a watermark (M9)."""
    return scans.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is now, written as Parquet (ST6, ST7)."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def debounce(changes: DataFrame, key: str, ts: str, value: str, millis: int, tie: str, chunk: int = 65_536) -> DataFrame:
    """The last value of every burst, once nothing has changed for so long (ST9).

    Changes are numbered in the order of key and time over all tasks and cut into chunks of equal size. A change meets the next one
    of its chunk, and the last of a chunk the first of the next chunk; no task holds more of a key than a chunk.
    """
    columns = [key, ts, value, tie]
    here = F.struct(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    numbered = ranked(changes.select(*dict.fromkeys(columns)), [key, ts, tie], "__place").withColumn("__chunk", F.floor((F.col("__place") - 1) / chunk)).withColumn("__here", here)
    firsts = numbered.groupBy("__chunk").agg(F.min_by("__here", "__place").alias("__beyond")).withColumn("__chunk", F.col("__chunk") - 1)
    within = F.lead("__here").over(Window.partitionBy("__chunk").orderBy("__place"))
    met = numbered.withColumn("__within", within).join(firsts, "__chunk", "left").withColumn("__next", F.coalesce("__within", "__beyond"))
    same = F.col("__next").isNotNull() & F.col("__next.key").eqNullSafe(F.col("__here.key"))
    after = F.when(same, F.col("__next.at") - F.col("__here.at"))
    return met.filter(F.coalesce(after >= millis * 1000, F.lit(True))).select(*columns)


def debounce_stream(changes: DataFrame, key: str, ts: str, value: str, gap: str, lateness: str) -> DataFrame:
    """The same for a stream, with session windows."""
    return changes.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).drop("session_window")


def recent(scans: DataFrame, key: str, item: str, ts: str, tie: str, capacity: int = 3, seconds: int = 15) -> DataFrame:
    """Per key: the newest scans of distinct items within a time of the key's last, newest first (ST4)."""
    latest = scans.groupBy(key, item).agg(F.max(F.struct(ts, tie)).alias("__at")).select(key, item, F.col(f"__at.{ts}").alias(ts), F.col(f"__at.{tie}").alias(tie))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    top = latest.withColumn("place", rank).filter(F.col("place") <= capacity)
    newest = latest.groupBy(key).agg(F.max(ts).alias("__newest"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return top.join(newest, key).filter(micros("__newest") - micros(ts) <= seconds * 1_000_000).drop("__newest")


def has_repeats(x: str) -> Column:
    """Whether a group holds a value twice (ST5), as an aggregate."""
    return F.count(x) != F.count_distinct(x)


def decide(readable: Column, known: Column, accepted: Column, duplicate: Column, restock: Column) -> Column:
    """Outcome of a scan from what is known of it (ST2, ST3)."""
    return (
        F.when(~readable, "warning")
        .when(~accepted, "ignored")
        .when(~known, "not_found")
        .when(duplicate, F.when(restock, "duplicate").otherwise("ignored"))
        .when(restock, "added")
        .otherwise("success")
    )
