"""Queries that write the tables' rows as raw lines and read them back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.plans.registry import Tables, query
from apotheca.sources import tsv


def _lines(rows: DataFrame, pos: str, *cells: Column | str) -> DataFrame:
    return rows.select(F.col(pos).alias("pos"), F.array_join(F.array(*(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells)), "\t").alias("value"))


@query("""SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS cis, p_name || ' 5 mg, ' || p_type AS name, upper(p_name) || ' 5 MG' AS clean_name, p_type AS shape, p_brand AS lab, p_size % 2 = 0 AS is_watched, p_size % 9 = 0 AS is_homeopathic FROM part WHERE p_size <> 13 AND p_size <> 14""")
def scan_products(t: Tables) -> DataFrame:
    """Size 13 has too short a key, size 14 too few cells."""
    key = F.when(F.col("p_size") == 13, F.lit("x")).otherwise(F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    name = F.concat(F.lit(" "), "p_name", F.lit(" 5 mg, "), "p_type", F.when(F.col("p_size") % 9 == 0, " dilution").otherwise(""))
    blank = [F.lit("")] * 6
    full = _lines(t.part.filter("p_size <> 14"), "p_partkey", key, name, "p_type", *blank, F.lit(""), "p_brand", F.when(F.col("p_size") % 2 == 0, "Oui").otherwise("Non"))
    short = _lines(t.part.filter("p_size = 14"), "p_partkey", key, name)
    found = tsv.products(full.unionByName(short)).rows
    return found.select("cis", F.regexp_replace("name", " dilution$", "").alias("name"), "clean_name", "shape", "lab", "is_watched", "is_homeopathic")


@query("SELECT CAST(count(*) FILTER (p_size NOT IN (13, 14)) AS BIGINT) AS taken, CAST(count(*) FILTER (p_size = 13) AS BIGINT) AS rejected FROM part")
def scan_rejects(t: Tables) -> DataFrame:
    """P20: taken and rejected lines of the same input; those with too few cells are neither."""
    key = F.when(F.col("p_size") == 13, F.lit("x")).otherwise(F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    full = _lines(t.part.filter("p_size <> 14"), "p_partkey", key, "p_name", *[F.lit("")] * 9)
    return tsv.products(full.unionByName(_lines(t.part.filter("p_size = 14"), "p_partkey", key))).counts()


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS group_id, 'group ' || l_orderkey AS label, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS cis, l_returnflag AS type, CASE WHEN l_linenumber = 7 THEN 999 ELSE l_linenumber END AS sort_order FROM lineitem""")
def scan_members(t: Tables) -> DataFrame:
    """S2, D8f."""
    order = F.when(F.col("l_linenumber") == 7, F.lit("?")).otherwise(F.col("l_linenumber").cast("string"))
    lines = _lines(t.lineitem, "l_orderkey", "l_orderkey", F.concat(F.lit("group "), F.col("l_orderkey").cast("string")), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), "l_returnflag", order, F.lit("extra"))
    return tsv.members(lines).rows.select("group_id", "label", "cis", "type", "sort_order")


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cis, '34009' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS cip13, o_orderpriority AS refund, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderpriority <> '5-LOW'""")
def scan_packages(t: Tables) -> DataFrame:
    """Low priorities have an unreadable price, pending ones none."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", "free").when(F.col("o_orderstatus") == "P", "").otherwise(F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")))
    blank = [F.lit("")] * 4
    lines = _lines(t.orders, "o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("1234567"), *blank, F.concat(F.lit("34009"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), F.lit("oui"), "o_orderpriority", price, *[F.lit("")] * 3)
    return tsv.packages(lines).rows.select("cis", "cip13", "refund", "price")


@query("""SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS cis, lpad(CAST(l_partkey AS VARCHAR), 4, '0') AS code, l_returnflag AS nature, CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS link FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def scan_compositions(t: Tables) -> DataFrame:
    """S4 with its semi join (J6): lines of the finished orders only."""
    from apotheca.operators import profiles

    key = F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    link = F.when(F.col("l_linenumber") == 1, F.lit("0")).otherwise(F.col("l_linenumber").cast("string"))
    lines = _lines(t.lineitem, "l_orderkey", key, F.lit("element"), F.lpad(F.col("l_partkey").cast("string"), 4, "0"), F.lit("substance"), F.lit(""), F.lit(""), "l_returnflag", link)
    wanted = t.orders.filter("o_orderstatus = 'F'").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("cis"))
    return profiles.of_products(tsv.compositions(lines).rows, wanted).select("cis", "code", "nature", "link")


@query("""SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS region, c_name || chr(9) || c_nationkey AS _raw FROM customer WHERE c_custkey % 7 <> 3""")
def scan_records(t: Tables) -> DataFrame:
    """Exact arity; some customers' lines have a cell too many."""
    exact = _lines(t.customer.filter("c_custkey % 7 <> 3"), "c_custkey", "c_name", "c_nationkey")
    wrong = _lines(t.customer.filter("c_custkey % 7 = 3"), "c_custkey", "c_name", "c_nationkey", F.lit("x"))
    return tsv.records(exact.unionByName(wrong), ["name", "region"], raw=True).rows.select("name", "region", "_raw")
