"""Queries over streams that decide scans and keep tables and views up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apotheca.plans.events import _stream
from apotheca.plans.registry import Tables, query
from apotheca.sources.store import shared_folder
from apotheca.sources.versions import BucketedTable
from apotheca.streaming import decisions, scans, upserts

RULES = decisions.Rules(cooldown=21600, lifetime=86400, delay=43200, capacity=3, remember=864000, slot=3600, together=240)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value >= 2 AS known, event_type = 'purchase' AS restock, event_id % 10 = 0 AS forced, json_extract_string(props, '$.k') AS box,
  CAST(floor(value * 60) AS BIGINT) * 1000000 AS busy_for, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS t, NULL::BIGINT AS last, NULL::BIGINT AS busy, []::STRUCT(b VARCHAR, a BIGINT)[] AS boxes, []::STRUCT(i VARCHAR, a BIGINT)[] AS recent, NULL::VARCHAR AS decision FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, k, event_id, t, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN t + busy_for ELSE busy END,
  CASE WHEN decision = 'added' AND box IS NOT NULL THEN list_append(list_filter(boxes, lambda x: x.b <> box), {'b': box, 'a': t}) ELSE boxes END,
  CASE WHEN decision IN ('success', 'replaced') THEN list_concat([{'i': event_type, 'a': t}], list_filter(others, lambda x, n: n <> 3 OR len(list_filter(others, lambda y: t - y.a < 86400000000)) < 3)) WHEN ok THEN held ELSE recent END, decision
FROM (SELECT *, list_filter(held, lambda x: x.i <> event_type) AS others, CASE WHEN event_type = 'error' THEN 'warning' WHEN NOT ok THEN 'ignored' WHEN NOT restock AND listed AND NOT forced THEN 'ignored' WHEN NOT known THEN 'not_found'
    WHEN restock THEN CASE WHEN len(list_filter(boxes, lambda x: x.b = box AND t - x.a < 864000000000)) > 0 THEN 'duplicate' ELSE 'added' END WHEN listed THEN 'replaced' ELSE 'success' END AS decision
  FROM (SELECT *, len(list_filter(held, lambda x: x.i = event_type)) > 0 AS listed
    FROM (SELECT o.*, f.last, f.busy, f.boxes, f.recent, list_filter(f.recent, lambda x: o.t - x.a < 129600000000) AS held,
      o.event_type <> 'error' AND (o.forced OR ((f.busy IS NULL OR o.t >= f.busy) AND (f.last IS NULL OR o.t - f.last >= 21600000000))) AS ok FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1))))
SELECT user_id, event_id, decision FROM f WHERE k > 0 AND (t // 3600000000 + 1) * 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""")
def scan_decisions_streamed(t: Tables) -> DataFrame:
    """ST1 to ST4 over several micro-batches: force, scans in flight, boxes, the recent list and its delayed release."""
    source, place = _stream(t, "event_id", "user_id", "ts", "event_type", "value", "props")
    rows = source.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), (F.col("event_type") != "error").alias("readable"), (F.col("value") >= 2).alias("known"), (F.col("event_type") == "purchase").alias("restock"),
        (F.col("event_id") % 10 == 0).alias("forced"), F.col("event_type").alias("item"), F.get_json_object("props", "$.k").alias("box"), F.floor(F.col("value") * 60).cast("long").alias("busy_seconds"),
    )
    with rocksdb(t.spark):
        scans.run_stream(decisions.decide_stream(rows, "user_id", "1 hour", RULES), f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").select("user_id", F.col("tie").alias("event_id"), "decision")


@query("""SELECT user_id, sum(CAST(floor(value) AS BIGINT)) AS stock_count, arg_min(event_type, (ts, event_id)) AS event_type, max(ts) AS updated_at FROM events GROUP BY 1""")
def restock_streamed(t: Tables) -> DataFrame:
    """M3 from a stream: each micro-batch is merged once into a versioned table."""
    source, place = _stream(t, "event_id", "user_id", "ts", "event_type", "value")
    kind = source.schema["ts"].dataType.simpleString()
    table = BucketedTable(t.spark, f"{place}/stock", f"user_id long, stock_count long, event_type string, updated_at {kind}, first_at struct<ts:{kind},event_id:long>", ["user_id"])
    stock = upserts.Stock(table, "user_id", "amount", ["ts", "event_id"], ["event_type"])
    upserts.follow(source.withColumn("amount", F.floor("value").cast("long")), stock.merge, f"{place}/state")
    table.vacuum(1)
    return table.read().select("user_id", "stock_count", "event_type", "updated_at")


@query("""SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS stock_count FROM events GROUP BY 1 HAVING count(json_extract_string(props, '$.k')) > 0""")
def unique_box_stock_streamed(t: Tables) -> DataFrame:
    """M10 from a stream."""
    source, place = _stream(t, "user_id", "ts", "props")
    table = BucketedTable(t.spark, f"{place}/boxes", "user_id long, box string", ["user_id", "box"])
    upserts.follow(source.select("user_id", F.get_json_object("props", "$.k").alias("box")).filter("box is not null"), upserts.Boxes(table).merge, f"{place}/state")
    table.vacuum(1)
    return table.read().groupBy("user_id").agg(F.count("*").alias("stock_count"))


@query("""SELECT l_partkey, count(*) AS members, min(price) AS lowest, max(price) AS highest FROM (SELECT l_partkey, l_extendedprice * CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS price FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber % 2 = 0) GROUP BY 1""")
def cluster_view_upkeep(t: Tables) -> DataFrame:
    """A view per part after three batches: line items come, returned ones of odd lines go, prices of every third line change."""
    view = upserts.ClusterView(t.spark, f"{shared_folder(t.spark)}/view-{uuid.uuid4().hex}", "l_partkey", "long", "double")
    rows = t.lineitem.select("l_partkey", F.col("l_extendedprice").alias("value"), "l_linenumber", "l_returnflag")
    signed = lambda df, sign: df.select("l_partkey", "value", F.lit(sign).alias("sign"))
    stays = F.expr("l_returnflag <> 'R' OR l_linenumber % 2 = 0")
    changed = rows.filter(stays & (F.col("l_linenumber") % 3 == 0))
    view.merge(signed(rows, 1), 0)
    view.merge(signed(rows.filter(~stays), -1), 1)
    view.merge(signed(changed, -1).unionByName(signed(changed.withColumn("value", F.col("value") * 2), 1)), 2)
    view.values.vacuum(1)
    view.view.vacuum(1)
    return view.view.read()
