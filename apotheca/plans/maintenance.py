"""Queries over the engine's own upkeep: the batch job from files, full refresh, schema, integrity, ad-hoc SQL and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.plans import etl
from apotheca.plans.registry import Tables, query
from apotheca.plans.relational import MEMBERS, PRODUCTS, PROFILES, members
from apotheca.sources import store

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def _lines(rows: DataFrame, *cells) -> DataFrame:
    return rows.select(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), "\t").alias("value"))


def _write_files(t: Tables, folder: str) -> None:
    """The four raw files, with blank lines and lines of too few cells among them; one is gzipped."""
    key, blank = F.lpad(F.col("p_partkey").cast("string"), 8, "0"), [F.lit("")] * 3
    holder = F.when(F.col("p_size") > 48, "BOIRON").otherwise(F.col("p_brand"))
    status = F.when(F.col("p_size") <= 40, "Autorisation active").otherwise("Abrogée")
    products = _lines(t.part, key, F.concat_ws(" ", "p_name", "p_brand"), F.lit("comprimé"), F.lit("orale"), status, *blank, F.lit(""), F.lit(""), holder)
    products.unionByName(t.region.select(F.when(F.col("r_regionkey") % 2 == 0, " ").otherwise("short\tline").alias("value"))).write.text(f"{folder}/products.tsv")
    group = members(t).orderBy("group_id", "sort_order", "pos")
    _lines(group, *map(F.col, ("group_id", "label", "cis", "type", "sort_order"))).write.option("compression", "gzip").text(f"{folder}/members.tsv")
    part = t.lineitem.select("l_partkey").distinct().select(F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("cis"))
    code = F.concat(F.lit("34009"), "cis")
    _lines(part, F.col("cis"), F.lit("1234567"), *blank, F.lit(""), code, F.lit("oui"), F.lit("65%"), F.lit("1,50"), *blank).write.text(f"{folder}/packages.tsv")
    words = t.part.select(key.alias("cis"), F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    _lines(words, F.col("cis"), F.lit("comprimé"), F.upper("word"), F.upper("word"), F.lit(""), F.lit(""), F.lit("SA"), F.lit("0")).write.text(f"{folder}/composition.tsv")


@query(f"""WITH {PRODUCTS}, {MEMBERS}, {PROFILES}, own AS (SELECT cis, chemical_id FROM profiles JOIN products USING (cis) WHERE NOT is_homeopathic),
counted AS (SELECT group_id, chemical_id, count(*) AS votes, min((sort_order, pos)) AS first FROM members JOIN own USING (cis) GROUP BY ALL),
voted AS (SELECT group_id, chemical_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, first) AS k FROM counted) WHERE k = 1),
kept AS (SELECT DISTINCT cis FROM members JOIN voted USING (group_id)), orphans AS (SELECT cis FROM products WHERE NOT is_homeopathic AND cis NOT IN (SELECT cis FROM kept)),
joined AS (SELECT DISTINCT chemical_id, cis FROM members JOIN voted USING (group_id) UNION ALL SELECT chemical_id, cis FROM orphans JOIN own USING (cis))
SELECT 'products' AS table_name, count(*) AS n FROM products UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'packages', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'elections', count(DISTINCT group_id) FROM members UNION ALL SELECT 'placed', count(*) FROM orphans UNION ALL SELECT 'clusters', count(DISTINCT chemical_id) FROM joined UNION ALL SELECT 'cluster_members', count(*) FROM joined""")
def batch_job(t: Tables) -> DataFrame:
    """S1-S6, S14 and every phase after: files are written, read, built, judged by the quality gate, and written out."""
    folder = f"{store.shared_folder(t.spark)}/job-{uuid.uuid4().hex}"
    _write_files(t, folder)
    etl.run(t.spark, folder, f"{folder}/out", limits={"suspect_name_rate": 1.0, "no_profile_rate": 1.0})
    return store.row_counts({name: t.spark.read.parquet(f"{folder}/out/{name}") for name in ("products", "members", "packages", "elections", "placed", "clusters", "cluster_members")})


@query("""SELECT p_brand AS cluster_id, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1""")
def full_refresh(t: Tables) -> DataFrame:
    """A table refreshed twice; what is read is the last version, whole."""
    place = f"{store.shared_folder(t.spark)}/refresh-{uuid.uuid4().hex}"
    rows = t.part.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    store.refresh(rows.filter("n > 1000000000"), place)
    store.refresh(rows, place)
    return store.current(t.spark, place)


#: A union over the tables, and the non-null values of each of their columns.
COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES)
FILLED = " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, filled FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {n}) ON COLUMNS(*) INTO NAME column_name VALUE filled)" for n in TABLES)


@query(f"""SELECT table_name, column_name, CAST(ordinal_position - 1 AS INTEGER) AS position, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' OR data_type LIKE 'DECIMAL%' THEN 'double' ELSE 'String' END AS app_type, filled
FROM information_schema.columns JOIN ({FILLED}) USING (table_name, column_name)""")
def schema_catalog(t: Tables) -> DataFrame:
    """Columns of all tables, and how many values they hold."""
    return store.schema_report({name: getattr(t, name) for name in TABLES}).select("table_name", "column_name", "position", "app_type", "filled")


@query(f"""SELECT name AS table_name, n, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'ready' END AS state FROM (VALUES {', '.join(f"('{n}')" for n in (*store.REFERENCE_TABLES, *store.VIEW_TABLES, *TABLES))}) v(name) LEFT JOIN ({COUNTS}) c ON name = table_name""")
def integrity_check(t: Tables) -> DataFrame:
    """All tables that are asked for, counted; the catalogue's own are missing in this folder."""
    return store.check_integrity(store.opened(t.spark, t.folder, (*store.REFERENCE_TABLES, *store.VIEW_TABLES, *TABLES)))


@query("SELECT p_brand, count(*) AS n, sum(o_totalprice) > 0 AS sold FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def adhoc_sql(t: Tables) -> DataFrame:
    """SQL over the tables as a text."""
    sql = "SELECT p_brand, count(*) AS n, sum(o_totalprice) > 0 AS sold FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY p_brand"
    return store.run_query(t.spark, sql, part=t.part, lineitem=t.lineitem, orders=t.orders)


@query("SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    """Rows written as JSON lines and read back."""
    place = f"{store.shared_folder(t.spark)}/json-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    store.write_json(rows, place)
    return t.spark.read.schema(rows.schema).json(place)
