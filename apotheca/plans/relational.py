"""Queries over the relational tables: the catalogue's operators on parts, orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.functions.numbers import rounded
from apotheca.operators import catalogue, clusters, elections, groupview, integration, profiles, quality, stock, strategies
from apotheca.plans.registry import Tables, query
from apotheca.sources import store

#: A part stands for a product, an order for a group, a line item for a membership, a word of a name for a substance.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("cis"), "p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.upper(F.col("p_name")).alias("clean_name"),
        F.when(F.col("p_size") <= 40, "Autorisation active").otherwise("Abrogée").alias("status"), F.lit("").alias("commercial"), F.col("p_partkey").alias("pos"), (F.col("p_size") > 48).alias("is_homeopathic"), "p_brand", "p_type",
    )


PRODUCTS = """products AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS cis, p_partkey, p_name || ' ' || p_brand AS name, upper(p_name) AS clean_name,
  p_size <= 40 AS active, p_partkey AS pos, p_size > 48 AS is_homeopathic, p_name, p_brand, p_type FROM part)"""


def members(t: Tables) -> DataFrame:
    """One membership per order and part, the one that comes first."""
    grouped = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct(*LINE_ORDER, "l_returnflag")).alias("m"))
    return grouped.select(
        F.col("l_orderkey").alias("group_id"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("cis"), F.when(F.col("m.l_returnflag") == "R", "0").otherwise("1").alias("type"),
        F.col("m.l_linenumber").alias("sort_order"), F.col("l_partkey").alias("pos"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("label"),
    )


MEMBERS = """members AS (SELECT l_orderkey AS group_id, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS cis, CASE WHEN l_returnflag = 'R' THEN '0' ELSE '1' END AS type, l_linenumber AS sort_order, l_partkey AS pos,
  'order ' || l_orderkey AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS k FROM lineitem) WHERE k = 1)"""


def profiled(t: Tables) -> DataFrame:
    rows = t.part.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("cis"), F.posexplode(F.split("p_name", " ")).alias("pos", "code"))
    return profiles.signatures(rows.select("cis", F.upper("code").alias("code"), F.upper("code").alias("substance"), F.lit("").alias("dosage"), "pos"))


PROFILES = """words AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS cis, upper(unnest(string_split(p_name, ' '))) AS code FROM part),
profiles AS (SELECT cis, string_agg(code, '+' ORDER BY code) AS chemical_id FROM words GROUP BY cis)"""

VOTES = """counted AS (SELECT group_id, chemical_id, count(*) AS votes, min(pos) AS first FROM members JOIN profiles USING (cis) GROUP BY ALL),
votes AS (SELECT group_id, chemical_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, first) AS k FROM counted) WHERE k = 1)"""


@query("""SELECT p_brand AS cluster_id, 'Brand ' || p_brand AS title, bool_or(p_size > 45) AS any_flag, count(p_partkey) AS variant_count, min(p_partkey) AS representative_cis FROM part GROUP BY p_brand""")
def explorer_list(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("cluster_id")).distinct().withColumn("title", F.concat(F.lit("Brand "), "cluster_id"))
    return catalogue.explorer_list(brands, t.part.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("cis"), (F.col("p_size") > 45).alias("flag")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS cis, l_suppkey AS lab_id, l_extendedprice AS price, p_name AS name, coalesce(s_name, 'unknown') AS lab_name
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def scan_cache(t: Tables) -> DataFrame:
    packages = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("cis"), F.col("l_suppkey").alias("lab_id"), F.col("l_extendedprice").alias("price"))
    labs = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"))
    return catalogue.scan_cache(packages, t.part.select(F.col("p_partkey").alias("cis"), F.col("p_name").alias("name")), labs)


@query("""SELECT o_orderkey, c_name, coalesce(n_name, 'unknown') AS n_name, r_name, strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def restock_view(t: Tables) -> DataFrame:
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", F.coalesce("n_name", F.lit("unknown")).alias("n_name"), "r_name", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem ANTI JOIN (SELECT * FROM part WHERE p_size <= 40) ON l_partkey = p_partkey")
def ghost_members(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("cis"), "l_linenumber", "l_quantity")
    return elections.ghosts(rows, t.part.filter("p_size <= 40").select(F.col("p_partkey").alias("cis"))).select("l_orderkey", F.col("cis").alias("l_partkey"), "l_linenumber", "l_quantity")


@query(f"""WITH {PRODUCTS}, {MEMBERS}, {PROFILES}, few AS (SELECT * FROM members WHERE type = '0' AND sort_order = 1),
few_groups AS (SELECT DISTINCT group_id FROM few), few_counted AS (SELECT group_id, chemical_id, count(*) AS votes, min(pos) AS first FROM few JOIN profiles USING (cis) GROUP BY ALL),
known AS (SELECT DISTINCT chemical_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, first) AS k FROM few_counted) WHERE k = 1)
SELECT p.cis, c.chemical_id, CASE WHEN c.chemical_id IS NULL THEN 'NO_PROFILE' WHEN k.chemical_id IS NULL THEN 'PROMOTED' ELSE 'ATTACHED' END AS fate
FROM (SELECT * FROM products WHERE NOT is_homeopathic AND cis NOT IN (SELECT cis FROM few)) p LEFT JOIN profiles c USING (cis) LEFT JOIN known k ON c.chemical_id = k.chemical_id""")
def orphan_partition(t: Tables) -> DataFrame:
    """Only returned first lines count as members, so that some parts are in no group."""
    few, profile = members(t).filter("type = '0' and sort_order = 1"), profiled(t)
    votes = clusters.majority_vote(few, profile)
    known = votes.select("chemical_id").distinct().withColumn("cluster_id", F.col("chemical_id"))
    placed = integration.place_orphans(integration.orphans(products(t), few, votes), profile, known)
    return placed.select("cis", "chemical_id", "fate")


@query(f"""WITH {PROFILES} SELECT a.cis AS group_id, a.chemical_id AS composition, n.others, n.first_group FROM profiles a
JOIN (SELECT chemical_id, count(*) - 1 AS others, min(cis) AS first_group FROM profiles GROUP BY 1) n USING (chemical_id)""")
def same_composition_counts(t: Tables) -> DataFrame:
    return catalogue.composition_sizes(profiled(t).select(F.col("cis").alias("group_id"), F.col("chemical_id").alias("composition")))


@query("""WITH names AS (SELECT o_custkey AS group_id, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS composition FROM orders GROUP BY 1)
SELECT composition, count(*) AS groups, min(group_id) AS first_group, max(group_id) AS last_group FROM names GROUP BY 1 HAVING count(*) > 1""")
def same_composition_groups(t: Tables) -> DataFrame:
    """Customers by the priorities that they order with, of which there are few, so groups are large."""
    return catalogue.same_composition(_compositions(t))


@query("""WITH names AS (SELECT o_custkey AS group_id, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS composition FROM orders GROUP BY 1)
SELECT group_id, composition, count(*) OVER (PARTITION BY composition) - 1 AS others, min(group_id) OVER (PARTITION BY composition) AS first_group FROM names""")
def same_composition_members(t: Tables) -> DataFrame:
    return catalogue.composition_sizes(_compositions(t))


def _compositions(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("group_id")).agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "+").alias("composition"))


@query("""WITH sets AS (SELECT CAST(user_id AS VARCHAR) AS id, list_distinct(list(event_type)) AS e FROM events GROUP BY 1),
targets AS (SELECT p_type AS id, list_distinct(list(CASE WHEN p_size % 5 = 0 THEN 'click' WHEN p_size % 5 = 1 THEN 'view' ELSE 'error' END)) AS e FROM part GROUP BY 1)
SELECT t.id AS target_id, s.id AS candidate_id, CAST(len(s.e) AS INTEGER) AS candidate_size FROM targets t, sets s WHERE len(s.e) > len(t.e) AND list_has_all(s.e, t.e) AND t.id <> s.id""")
def related_supersets(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, "click").when(F.col("p_size") % 5 == 1, "view").otherwise("error")
    targets = t.part.groupBy(F.col("p_type").alias("id")).agg(F.collect_set(kind).alias("elements"))
    return catalogue.supersets(targets, t.events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.collect_set("event_type").alias("elements")))


@query(f"""WITH {PRODUCTS}, {MEMBERS}, refs AS (SELECT group_id, min(cis) AS reference_cis FROM members WHERE type = '0' GROUP BY 1),
packages AS (SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS cis, min(l_extendedprice) AS lowest FROM lineitem GROUP BY 1)
SELECT m.group_id, m.cis, m.type, r.reference_cis, q.name AS reference_name, coalesce(p.name, q.name, '') AS shown_name, k.lowest
FROM members m LEFT JOIN refs r USING (group_id) LEFT JOIN products q ON r.reference_cis = q.cis LEFT JOIN products p ON m.cis = p.cis LEFT JOIN packages k ON m.cis = k.cis""")
def group_detail_view(t: Tables) -> DataFrame:
    packages = t.lineitem.groupBy(F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("cis")).agg(F.min("l_extendedprice").alias("lowest"))
    out = catalogue.group_details(members(t), products(t).select("cis", "name"), packages)
    return out.select("group_id", "cis", "type", "reference_cis", "reference_name", "shown_name", "lowest")


@query("""WITH packs AS (SELECT '34009' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '0' AS cip13, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS cip7, p_partkey AS cis FROM part),
asked AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '34009' || lpad(CAST(event_id AS VARCHAR), 7, '0') || '0' WHEN event_id % 3 = 1 THEN lpad(CAST(event_id AS VARCHAR), 7, '0') ELSE 'x' || event_id END AS code FROM events)
SELECT event_id, code, f.cis AS cis_full, s.cis AS cis_short, coalesce(f.cis, s.cis) AS cis, CASE WHEN f.cis IS NOT NULL THEN 'full' WHEN s.cis IS NOT NULL THEN 'short' END AS matched_by
FROM asked LEFT JOIN packs f ON code = f.cip13 LEFT JOIN packs s ON (CASE WHEN length(code) = 7 THEN code WHEN length(code) = 13 AND starts_with(code, '34009') THEN substr(code, 6, 7) END) = s.cip7""")
def lookup_with_fallback(t: Tables) -> DataFrame:
    from apotheca.functions import codes

    seven = lambda c: F.lpad(F.col(c).cast("string"), 7, "0")
    packs = t.part.select(F.concat(F.lit("34009"), seven("p_partkey"), F.lit("0")).alias("cip13"), seven("p_partkey").alias("cip7"), F.col("p_partkey").alias("cis"))
    kind = F.col("event_id") % 3
    asked = t.events.select("event_id", F.when(kind == 0, F.concat(F.lit("34009"), seven("event_id"), F.lit("0"))).when(kind == 1, seven("event_id")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("code"))
    return catalogue.lookup(asked.withColumn("short_code", codes.short_code("code")), packs).drop("short_code")


@query("""WITH v AS (SELECT p_brand AS code, upper(CASE WHEN p_size % 4 = 0 THEN p_name || ' (' || p_type || ')' ELSE p_name END) AS name, min(p_partkey) AS first FROM part GROUP BY 1, 2),
b AS (SELECT code, count(*) AS n, arg_min(name, (length(name), first)) AS shortest, bool_or(strpos(name, '(') > 1) AS has_b FROM v GROUP BY 1),
p AS (SELECT code, arg_min(name, (length(name), first)) AS nested FROM v WHERE strpos(name, '(') > 1 GROUP BY 1)
SELECT code, CASE WHEN n > 1 AND has_b THEN nested ELSE shortest END AS canonical, CASE WHEN n = 1 THEN 'UNIQUE' WHEN has_b THEN 'PARENTHESIS' ELSE 'SHORTEST' END AS strategy, n AS variants FROM b LEFT JOIN p USING (code)""")
def canonical_name_vote(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    found = profiles.substance_names(t.part.select(F.col("p_brand").alias("code"), name.alias("substance"), F.col("p_partkey").alias("pos")))
    return found.select("code", "canonical", "strategy", F.size("variants").cast("long").alias("variants"))


@query("""WITH rows AS (SELECT l_orderkey AS cis, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey % 5 AS VARCHAR) END AS link, CASE WHEN l_returnflag = 'R' THEN 'FT' ELSE 'SA' END AS nature, l_partkey AS code,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cis, link ORDER BY nature = 'FT' DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM rows WHERE link <> '')
SELECT cis, link, nature, code FROM rows WHERE link = '' UNION ALL SELECT cis, link, nature, code FROM ranked WHERE k = 1""")
def ft_over_sa_resolution(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("cis"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise((F.col("l_suppkey") % 5).cast("string")).alias("link"), F.when(F.col("l_returnflag") == "R", "FT").otherwise("SA").alias("nature"), F.col("l_partkey").alias("code"), F.struct(*LINE_ORDER).alias("pos"))
    return profiles.resolve_links(rows).select("cis", "link", "nature", "code")


@query("""SELECT count(*) FILTER (n > 1) AS conflicts FROM (SELECT count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY l_orderkey, l_suppkey % 5)""")
def link_conflicts(t: Tables) -> DataFrame:
    return profiles.conflicts(t.lineitem.select(F.col("l_orderkey").alias("cis"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise((F.col("l_suppkey") % 5).cast("string")).alias("link")))


@query(f"WITH {PROFILES} SELECT cis, chemical_id FROM profiles")
def chemical_signature(t: Tables) -> DataFrame:
    return profiled(t).select("cis", "chemical_id")


RUNNERS = "runners AS (SELECT m.group_id, m.cis, m.sort_order, p.clean_name AS name, row_number() OVER (PARTITION BY m.group_id ORDER BY sort_order, m.pos) AS k FROM members m JOIN products p USING (cis) WHERE m.type = '0' AND p.active)"


@query(f"""WITH {PRODUCTS}, {MEMBERS}, {RUNNERS}
SELECT g.group_id, r.cis AS winner_cis, coalesce(r.name, upper(g.label)) AS winner_name, coalesce(s.runners, 0) AS runners, g.candidates, CASE WHEN r.cis IS NULL THEN 'LABEL_FALLBACK' ELSE 'ACTIVE_PRINCEPS' END AS method
FROM (SELECT group_id, count(*) FILTER (type = '0') AS candidates, min(label) AS label FROM members GROUP BY 1) g LEFT JOIN (SELECT * FROM runners WHERE k = 1) r USING (group_id)
LEFT JOIN (SELECT group_id, count(*) AS runners FROM runners GROUP BY 1) s USING (group_id)""")
def princeps_election(t: Tables) -> DataFrame:
    return elections.elect(members(t), products(t))


@query(f"""WITH {PRODUCTS}, {MEMBERS}, {RUNNERS} SELECT group_id, cis, sort_order, name FROM runners WHERE k > 1""")
def princeps_secondaries(t: Tables) -> DataFrame:
    """The runners that didn't win, as rows."""
    rows, parts = members(t), products(t)
    return elections.secondaries(rows, parts, elections.elect(rows, parts)).select("group_id", "cis", "sort_order", "name")


@query(f"WITH {MEMBERS}, {PROFILES}, {VOTES} SELECT group_id, chemical_id, votes FROM votes")
def majority_vote(t: Tables) -> DataFrame:
    return clusters.majority_vote(members(t), profiled(t))


@query(f"""WITH {MEMBERS}, {PROFILES}, {VOTES}, v AS (SELECT * FROM members JOIN votes USING (group_id)), r AS (SELECT chemical_id, 'group' AS kind, CAST(group_id AS VARCHAR) AS id, pos FROM v UNION ALL SELECT chemical_id, 'product', cis, pos FROM v)
SELECT chemical_id, kind, id, min(pos) AS pos, 'SCL_' || upper(substr(md5(chemical_id), 1, 12)) AS cluster_id FROM r GROUP BY 1, 2, 3""")
def super_clusters(t: Tables) -> DataFrame:
    """Clusters as rows of their members."""
    rows = members(t)
    return clusters.memberships(rows, clusters.majority_vote(rows, profiled(t)))


@query(f"""WITH {PRODUCTS}, {PROFILES} SELECT chemical_id, 'ORPH_' || upper(substr(md5(chemical_id), 1, 12)) AS cluster_id, upper(arg_min(name, pos)) AS display_name, count(*) AS products
FROM products JOIN profiles USING (cis) WHERE NOT is_homeopathic GROUP BY chemical_id""")
def promoted_orphans(t: Tables) -> DataFrame:
    return integration.promoted_names(_promoted(t))


@query(f"""WITH {PRODUCTS}, {PROFILES} SELECT chemical_id, 'ORPH_' || upper(substr(md5(chemical_id), 1, 12)) AS cluster_id, cis, pos FROM products JOIN profiles USING (cis) WHERE NOT is_homeopathic""")
def promoted_members(t: Tables) -> DataFrame:
    return integration.promoted_members(_promoted(t))


def _promoted(t: Tables) -> DataFrame:
    return products(t).filter("not is_homeopathic").join(profiled(t).select("cis", "chemical_id"), "cis").withColumn("fate", F.lit("PROMOTED"))


@query("""WITH d AS (SELECT p_brand AS cluster_id, p_type || ' ' || p_name AS name, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
f AS (SELECT cluster_id, string_split(name, ' ')[1] AS word, min(pos) AS pos, list(name ORDER BY pos) AS names FROM d GROUP BY 1, 2),
c AS (SELECT cluster_id, pos, CASE WHEN len(names) = 1 THEN names[1] WHEN list_aggregate(list_transform(names, lambda n: string_split(n, ' ')[2]), 'min') = list_aggregate(list_transform(names, lambda n: string_split(n, ' ')[2]), 'max') THEN word || ' ' || upper(string_split(names[1], ' ')[2]) ELSE word END AS brand FROM f)
SELECT cluster_id, brand, min(pos) AS pos FROM c GROUP BY 1, 2""")
def secondary_consolidation(t: Tables) -> DataFrame:
    """Names begin with the part's type, so a family is a type, and what its names share is at least that."""
    rows = t.part.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return integration.consolidate(rows).select("cluster_id", "brand", "pos")


@query()
def lcs_naming(t: Tables) -> DataFrame:
    """Names of clusters of whole part names; SQL has no regular expression of a column's words, tests hold it to brute force."""
    names = t.part.select(F.col("p_brand").alias("chemical_id"), "p_size", F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    found = clusters.common_runs(names, ["chemical_id", "p_size"])
    display, method = text.agreed_name("common", "first_name", "names", "chemical_id")
    return found.select("chemical_id", "p_size", display.alias("display_name"), method.alias("naming_method"))


@query("SELECT p_brand AS lab_name, row_number() OVER (ORDER BY p_brand) AS lab_id FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'unknown', 0")
def lab_dimension(t: Tables) -> DataFrame:
    """Dense ids from 1, and 0 for what has no laboratory."""
    return catalogue.dimension(t.part, "p_brand", "lab_name", "lab_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1""")
def first_write_dedup(t: Tables) -> DataFrame:
    return store.first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1""")
def last_write_dedup(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return store.last_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("""WITH base AS (SELECT p_partkey AS id, p_name AS name, p_size AS v FROM part), ch AS (SELECT l_partkey AS id, l_returnflag AS name, l_linenumber AS v, l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
last AS (SELECT id, name, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_orderkey DESC, v DESC, name DESC) AS k FROM ch) WHERE k = 1)
SELECT id, name, v FROM last UNION ALL SELECT id, name, v FROM base WHERE id NOT IN (SELECT id FROM last)""")
def upsert_overwrite(t: Tables) -> DataFrame:
    base = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("v"))
    changes = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("v"), "l_orderkey")
    return store.upsert(base, changes, ["id"], ["l_orderkey", "v", "name"])


@query("""SELECT count(*) AS total, count(*) FILTER (p_size > 40) AS princeps, count(*) FILTER (p_size <= 40) AS generics, count(DISTINCT p_name) AS principles,
CASE WHEN count(DISTINCT p_name) > 0 THEN round(count(*) FILTER (p_size <= 40) / count(DISTINCT p_name), 6) ELSE 0 END AS ratio FROM part""")
def ui_stats(t: Tables) -> DataFrame:
    counts = t.part.agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 40).alias("princeps"), F.count_if(F.col("p_size") <= 40).alias("generics"), F.count_distinct("p_name").alias("principles"))
    return counts.withColumn("ratio", rounded(quality.ratio(F.col("generics"), F.col("principles")), 6))


@query("""SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1""")
def group_concat_audit(t: Tables) -> DataFrame:
    return groupview.concat_distinct(t.part, "p_brand", types="p_type", sizes="p_size")


@query("""SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ', ' ORDER BY CAST(p_size AS VARCHAR)) AS dosages, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS forms, min(p_name) AS title FROM part GROUP BY 1""")
def group_header(t: Tables) -> DataFrame:
    return groupview.header(t.part.withColumn("dosage", F.col("p_size").cast("string")).withColumn("blank", F.lit(" ")), "p_brand", "dosage", "p_type", "blank", "p_name")


@query("""SELECT l_partkey, CASE WHEN abs(max(l_discount) - min(l_discount)) < 0.005 THEN replace(printf('%.2f', min(l_discount)), '.', ',') || ' €'
ELSE replace(printf('%.2f', min(l_discount)), '.', ',') || ' € – ' || replace(printf('%.2f', max(l_discount)), '.', ',') || ' €' END AS price_label FROM lineitem GROUP BY 1""")
def price_range(t: Tables) -> DataFrame:
    return groupview.price_range(t.lineitem, "l_partkey", "l_discount")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS x, min((o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(x, ' • ' ORDER BY first) AS rates FROM f GROUP BY 1""")
def refund_rates(t: Tables) -> DataFrame:
    return groupview.in_first_seen_order(t.orders, "o_custkey", "o_orderpriority", F.struct("o_orderdate", "o_orderkey"), "rates")


@query("""WITH p AS (SELECT o_custkey, trim(unnest(string_split(o_orderpriority || ';' || o_orderstatus || '; ', ';'))) AS part FROM orders) SELECT o_custkey, string_agg(DISTINCT part, ', ' ORDER BY part) AS parts FROM p WHERE part <> '' GROUP BY 1""")
def conditions_split(t: Tables) -> DataFrame:
    return groupview.split_sorted(t.orders.withColumn("c", F.concat_ws(";", "o_orderpriority", "o_orderstatus", F.lit(" "))), "o_custkey", "c")


@query("""SELECT p_brand, list, CAST(p_partkey AS VARCHAR) AS value, row_number() OVER (PARTITION BY p_brand, list ORDER BY p_partkey) AS place FROM (SELECT *, CASE WHEN p_size > 25 THEN 'flagged' ELSE 'others' END AS list FROM part)""")
def partition_lists(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", (F.col("p_size") > 25).alias("flag"), F.col("p_partkey").cast("string").alias("value"), F.col("p_partkey").alias("at"))
    return groupview.two_lists(rows, "p_brand", "flag", "value", "at")


@query("""SELECT p_brand, arg_min(p_name, p_partkey) FILTER (p_size > 48) AS first_value FROM part GROUP BY 1""")
def first_match(t: Tables) -> DataFrame:
    return groupview.first_match(t.part, "p_brand", F.col("p_size") > 48, "p_name", "p_partkey")


@query("""WITH r AS (SELECT upper(substr(p_name, 1, 1)) AS letter, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS place FROM part) SELECT letter, min(place) AS first_at FROM r WHERE letter NOT IN ('I', 'O', 'Q') GROUP BY 1""")
def letter_index(t: Tables) -> DataFrame:
    return catalogue.letter_index(t.part.withColumnRenamed("p_partkey", "id"), "p_name")


@query("SELECT CASE WHEN regexp_matches(substr(x, 1, 1), '[A-Za-z]') THEN upper(substr(x, 1, 1)) ELSE '#' END AS letter, count(*) AS n FROM (SELECT p_name AS x FROM part UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1")
def letter_groups(t: Tables) -> DataFrame:
    return groupview.letter_groups(t.part.select(F.col("p_name").alias("x")).unionByName(t.orders.select(F.col("o_orderpriority").alias("x"))), "x")


@query("""WITH i AS (SELECT DISTINCT upper(substr(p_name, 1, 1)) AS target FROM part), l AS (SELECT DISTINCT upper(substr(r_name, 1, 1)) AS letter FROM region UNION SELECT DISTINCT substr(c_mktsegment, 1, 1) FROM customer)
SELECT letter, (SELECT min(target) FROM i WHERE target >= letter) AS target FROM l""")
def letter_successor(t: Tables) -> DataFrame:
    index = catalogue.letter_index(t.part.withColumnRenamed("p_partkey", "id"), "p_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").select("letter")
    letters = t.region.select(F.upper(F.col("r_name").substr(1, 1)).alias("letter")).union(t.customer.select(F.col("c_mktsegment").substr(1, 1))).distinct()
    return catalogue.letter_successor(index, letters)


@query("""WITH a AS (SELECT 'type' AS kind, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2)
SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS k FROM a) WHERE k <= 20""")
def distributions_topn(t: Tables) -> DataFrame:
    parts = (("type", t.part, "p_type"), ("brand", t.part, "p_brand"), ("status", t.orders, "o_orderstatus"))
    return catalogue.union_all(*(quality.distribution(df, c).select(F.lit(kind).alias("kind"), "value", "n") for kind, df, c in parts))


@query("""WITH n AS (SELECT p_partkey, p_size % 2 = 0 AS comma, p_size % 3 <> 0 AS known, p_size > 25 AS grouped, p_size % 7 = 0 AS dosed, p_size % 11 <> 0 AS shaped FROM part),
m AS (SELECT unnest([{'s': 'form_subtraction', 'm': 'form_subtraction', 'c': CASE WHEN shaped THEN 0.7 ELSE 0.4 END}, {'s': 'brand_extraction', 'm': 'brand_extraction', 'c': CASE WHEN dosed THEN 0.9 ELSE 0.6 END}, {'s': 'composition_lookup', 'm': 'composition_lookup', 'c': CASE WHEN known THEN 0.95 ELSE 0.5 END},
{'s': 'comma_split', 'm': 'comma_split', 'c': CASE WHEN comma THEN 0.8 ELSE 0.5 END}, {'s': 'composition_based', 'm': CASE WHEN known THEN 'composition_full' ELSE 'composition_fallback' END, 'c': CASE WHEN known THEN 0.95 ELSE 0.6 END},
{'s': 'hybrid', 'm': CASE WHEN known THEN 'hybrid_full' ELSE 'hybrid_comma_only' END, 'c': CASE WHEN known THEN 0.9 ELSE 0.8 END},
{'s': 'princeps_based', 'm': CASE WHEN grouped THEN 'princeps_canonical' ELSE 'comma_split' END, 'c': CASE WHEN NOT grouped THEN CASE WHEN comma THEN 0.8 ELSE 0.5 END WHEN known THEN 0.98 ELSE 0.85 END},
{'s': 'advanced_multiphase', 'm': CASE WHEN known THEN 'advanced_full' ELSE 'advanced_partial' END, 'c': CASE WHEN known AND grouped AND comma THEN 0.98 WHEN known AND comma THEN 0.95 WHEN known THEN 0.9 WHEN grouped THEN 0.85 WHEN comma THEN 0.8 ELSE 0.5 END}]) AS r FROM n)
SELECT r.s AS strategy, r.m AS method, count(*) AS n, round(CAST(sum(CAST(r.c AS DECIMAL(9, 2))) AS DOUBLE) / count(*), 4) AS mean_confidence FROM m GROUP BY 1, 2""")
def strategy_scores(t: Tables) -> DataFrame:
    """Names with and without a comma, two thirds with a composition, half in a group of their own."""
    name = F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " 2.5 mg").otherwise(""), F.when(F.col("p_size") % 2 == 0, ", ").otherwise(" "), F.lower("p_type"))
    shape = F.when(F.col("p_size") % 11 != 0, F.lower("p_type")).when(F.col("p_size") > 25, "")
    rows = t.part.select(F.col("p_partkey").alias("cis"), name.alias("name"), shape.alias("shape"), "p_size")
    composition = rows.filter("p_size % 3 <> 0").select("cis", F.lit("SA").alias("nature"), F.col("name").alias("substance"), F.lit("un comprimé").alias("reference"), F.lit(0).alias("pos"))
    own = rows.filter("p_size > 25")
    scored = strategies.score(rows.drop("p_size"), composition, own.select("cis", F.col("cis").alias("group_id"), F.lit(0).alias("pos")), own.select(F.col("cis").alias("group_id"), F.col("cis").alias("reference_cis"), F.col("name").alias("reference_name")))
    return catalogue.union_all(*(quality.strategy_summary(scored, s).select(F.lit(s).alias("strategy"), "method", "n", "mean_confidence") for s in scored.columns if s != "cis"))


@query("""SELECT p_partkey AS cis, upper(p_name) || ' 500 MG' AS subtracted, p_name AS brand, CASE WHEN p_size % 3 = 0 THEN p_name ELSE upper(p_name) END AS generic FROM part""")
def strategy_first_set(t: Tables) -> DataFrame:
    """What the first set of strategies takes for brand and substance."""
    scored = _scored_by_composition(t)
    return scored.select("cis", F.col("form_subtraction.brand").alias("subtracted"), "brand_extraction.brand", "composition_lookup.generic")


@query("""SELECT p_partkey AS cis, p_name AS brand, CASE WHEN p_size % 3 = 0 THEN p_name ELSE upper(p_name) END AS generic, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE 'comprimé' END AS form FROM part""")
def strategy_multiphase(t: Tables) -> DataFrame:
    return _scored_by_composition(t).select("cis", "advanced_multiphase.brand", "advanced_multiphase.generic", "advanced_multiphase.form")


def _scored_by_composition(t: Tables) -> DataFrame:
    """Dosed names, two thirds with a composition, none in a group."""
    rows = t.part.select(F.col("p_partkey").alias("cis"), F.concat("p_name", F.lit(" 500 mg, "), F.lower("p_type")).alias("name"), F.lower("p_type").alias("shape"), "p_name", "p_size")
    composition = rows.filter("p_size % 3 <> 0").select("cis", F.lit("SA").alias("nature"), F.concat(F.lit("Chlorhydrate de "), "p_name").alias("substance"), F.lit("un comprimé").alias("reference"), F.lit(0).alias("pos"))
    none = rows.limit(0)
    return strategies.score(rows.select("cis", "name", "shape"), composition, none.select("cis", F.col("cis").alias("group_id"), F.lit(0).alias("pos")), none.select(F.col("cis").alias("group_id"), F.col("cis").alias("reference_cis"), F.col("name").alias("reference_name")))


@query("""SELECT round(avg(CASE WHEN p_size > 48 THEN 1.0 ELSE 0 END), 6) AS homeopathic_rate, round(avg(CASE WHEN p_size <= 40 THEN 1.0 ELSE 0 END), 6) AS active_rate, count(DISTINCT p_name) AS names,
(SELECT round(avg(CASE WHEN l_discount IS NULL OR l_discount = 0 THEN 1.0 ELSE 0 END), 6) FROM lineitem) AS undiscounted_rate FROM part""")
def quality_rates(t: Tables) -> DataFrame:
    parts = t.part.agg(rounded(quality.rate(F.col("p_size") > 48), 6).alias("homeopathic_rate"), rounded(quality.rate(F.col("p_size") <= 40), 6).alias("active_rate"), F.count_distinct("p_name").alias("names"))
    return parts.crossJoin(t.lineitem.agg(rounded(quality.rate(F.col("l_discount").isNull() | (F.col("l_discount") == 0)), 6).alias("undiscounted_rate")))


@query("SELECT p_name, count(DISTINCT p_brand) AS clusters FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def split_cluster_audit(t: Tables) -> DataFrame:
    return quality.split_substances(t.part, "p_name", "p_brand")


@query("SELECT p_name, count(*) AS n, arg_min(p_brand, p_partkey) AS example FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def missing_topk(t: Tables) -> DataFrame:
    return quality.top_missing(t.part, "p_name", "p_brand", "p_partkey")


@query("""WITH {m} SELECT group_id, arg_max(cis, (sort_order, cis)) AS reference_cis FROM members WHERE type = '0' GROUP BY 1""".replace("{m}", MEMBERS))
def reference_of_group(t: Tables) -> DataFrame:
    return quality.reference_of_group(members(t), ["sort_order", "cis"])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40, p_size < 5, p_name, p_partkey) AS rank FROM part")
def smart_order(t: Tables) -> DataFrame:
    order = groupview.smart_order(F.col("p_size") > 40, F.col("p_size") < 5, "p_name")
    return catalogue.ranked(t.part, [*order, "p_partkey"], within=["p_brand"]).select("p_partkey", "rank")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey) AS rank FROM orders""")
def updated_order(t: Tables) -> DataFrame:
    """Newest change first."""
    return catalogue.ranked(t.orders.withColumn("updated_at", F.date_trunc("second", "o_orderdate")), [F.desc("updated_at"), "o_orderkey"]).select("o_orderkey", "rank")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN upper(p_name) END, p_type) AS title FROM part ORDER BY lower(coalesce(CASE WHEN p_size % 3 > 0 THEN upper(p_name) END, p_type)), p_partkey LIMIT 1000""")
def coalesced_order(t: Tables) -> DataFrame:
    """The first thousand by the first title there is, without case."""
    title = F.coalesce(F.when(F.col("p_size") % 3 > 0, F.upper("p_name")), F.col("p_type"))
    return catalogue.page(t.part.select("p_partkey", title.alias("title")), [catalogue.nocase("title"), "p_partkey"], 0, 1000)


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_name DESC) AS rank FROM customer")
def nocase_order(t: Tables) -> DataFrame:
    return catalogue.ranked(t.customer, [catalogue.nocase("c_mktsegment"), F.desc("c_name")]).select("c_custkey", "rank")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY upper(CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END), p_partkey) AS rank FROM part")
def preferred_order(t: Tables) -> DataFrame:
    rows = t.part.withColumn("main", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit(" ")))
    return catalogue.ranked(rows, [groupview.preferred_key("princeps", "main", F.col("p_type"), F.col("p_type")), "p_partkey"], within=["p_brand"]).select("p_partkey", "rank")


@query("SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def paged_list(t: Tables) -> DataFrame:
    return catalogue.page(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_partkey"], 100, 50)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100")
def topk_title(t: Tables) -> DataFrame:
    return catalogue.page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 0, 100)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('0:' || p_partkey), p_partkey LIMIT 200")
def random_sample(t: Tables) -> DataFrame:
    """200 rows in an order that a seed repeats."""
    return catalogue.sample(t.part, "p_partkey", 200).select("p_partkey", "p_name")


@query("""SELECT DISTINCT trim(x) AS part FROM (SELECT unnest(string_split(o_orderpriority || '; ' || o_orderstatus || ';;', ';')) AS x FROM orders) WHERE trim(x) <> ''""")
def distinct_routes(t: Tables) -> DataFrame:
    return catalogue.distinct_parts(t.orders.withColumn("c", F.concat("o_orderpriority", F.lit("; "), "o_orderstatus", F.lit(";;"))), "c")


@query("""SELECT l_partkey, arg_max(l_returnflag = 'R', (l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag)) AS flag FROM lineitem GROUP BY 1""")
def hospital_flag_last_wins(t: Tables) -> DataFrame:
    return stock.last_flag(t.lineitem, "l_partkey", F.col("l_returnflag") == "R", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"])


@query("""WITH last AS (SELECT l_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_returnflag)) AS f FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey, coalesce(f, p_type) AS p_type FROM part LEFT JOIN last ON p_partkey = l_partkey""")
def update_last_cluster_wins(t: Tables) -> DataFrame:
    changes = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("p_type"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").alias("at"))
    return stock.update_from(t.part.select("p_partkey", "p_type"), changes, "p_partkey", "p_type", "at")


@query("""SELECT 'duplicate line keys' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS broken
UNION ALL SELECT 'lines without order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'lines without part', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'orders without customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'statuses', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))""")
def fk_assertions(t: Tables) -> DataFrame:
    return catalogue.union_all(
        store.assertion("duplicate line keys", store.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])),
        store.assertion("lines without order", store.broken_references(t.lineitem, "l_orderkey", t.orders, "o_orderkey")),
        store.assertion("lines without part", store.broken_references(t.lineitem, "l_partkey", t.part, "p_partkey")),
        store.assertion("orders without customer", store.broken_references(t.orders, "o_custkey", t.customer, "c_custkey")),
        store.assertion("statuses", t.orders.filter(~F.col("o_orderstatus").isin("O", "F"))),
    )


@query("""SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def table_row_counts(t: Tables) -> DataFrame:
    return store.row_counts({"part": t.part, "orders": t.orders, "lineitem": t.lineitem, "events": t.events})


@query("""WITH asked AS (SELECT DISTINCT p_brand AS cluster_id FROM part UNION SELECT 'Brand#' || n_nationkey || 'x' FROM nation), c AS (SELECT p_brand AS cluster_id, min(p_name) AS title, count(*) AS members FROM part WHERE p_size > 1 GROUP BY 1)
SELECT cluster_id, title, coalesce(members, 0) AS members, CASE WHEN title IS NULL THEN 'not found' ELSE 'found' END AS state FROM asked LEFT JOIN c USING (cluster_id)""")
def inspect_clusters(t: Tables) -> DataFrame:
    asked = t.part.select(F.col("p_brand").alias("cluster_id")).union(t.nation.select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"), F.lit("x")))).distinct()
    rows = t.part.filter("p_size > 1").select(F.col("p_brand").alias("cluster_id"), "p_name")
    return catalogue.inspect(asked, rows.groupBy("cluster_id").agg(F.min("p_name").alias("title")), rows).select("cluster_id", "title", "members", "state")


@query("""SELECT p_brand, list_aggregate(list_sort(list_distinct(list(p_type))), 'string_agg', ',') AS parts_list, CAST(count(DISTINCT p_type) AS INTEGER) AS n FROM part GROUP BY 1""")
def json_group_array(t: Tables) -> DataFrame:
    """Distinct trimmed parts as a JSON list, and back."""
    packed = t.part.groupBy("p_brand").agg(F.to_json(F.sort_array(F.collect_set(F.trim("p_type")))).alias("json"))
    back = F.from_json("json", "array<string>")
    return packed.select("p_brand", F.array_join(back, ",").alias("parts_list"), F.json_array_length("json").alias("n"))


@query("""SELECT count(*) AS total_clusters, round(avg(CASE WHEN starts_with(n, 'ORPH_') THEN 1.0 ELSE 0 END), 6) AS orphan_rate, round(avg(CASE WHEN p <> '' THEN 1.0 ELSE 0 END), 6) AS princeps_coverage,
count(*) FILTER (length(coalesce(nullif(p, ''), n)) < 4 AND upper(coalesce(nullif(p, ''), n)) NOT IN ('ZINC', 'FER', 'EAU', 'GEL', 'AIR', 'SEL')) AS short_name_alerts
FROM (SELECT CASE WHEN p_size > 40 THEN 'ORPH_' || p_partkey ELSE p_name END AS n, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'gel' WHEN 2 THEN 'abc' ELSE p_name END AS p FROM part)""")
def cluster_metrics(t: Tables) -> DataFrame:
    brand = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "gel").when(F.col("p_size") % 4 == 2, "abc").otherwise(F.col("p_name"))
    name = F.when(F.col("p_size") > 40, F.concat(F.lit("ORPH_"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return quality.cluster_metrics(t.part.select(name.alias("cluster_name"), brand.alias("cluster_princeps")))


@query("SELECT (SELECT count(*) > 0 FROM part WHERE p_size > 49) AS large, (SELECT count(*) > 0 FROM part WHERE p_size > 1000) AS huge")
def existence(t: Tables) -> DataFrame:
    large = quality.exists(t.part, F.col("p_size") > 49).withColumnRenamed("found", "large")
    return large.crossJoin(quality.exists(t.part, F.col("p_size") > 1000).withColumnRenamed("found", "huge"))


@query("""SELECT DISTINCT s.l_orderkey, s.l_linenumber, s.l_suppkey FROM lineitem s JOIN (SELECT DISTINCT l_partkey, l_partkey || '_' || l_orderkey AS label FROM lineitem WHERE l_returnflag = 'R') b ON s.l_partkey = b.l_partkey AND contains(b.label, '_' || s.l_suppkey)""")
def containment_duplicates(t: Tables) -> DataFrame:
    boxes = t.lineitem.filter("l_returnflag = 'R'").select("l_partkey", F.concat_ws("_", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string")).alias("label")).distinct()
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.concat(F.lit("_"), F.col("l_suppkey").cast("string")).alias("serial"))
    return catalogue.contained_duplicates(rows, boxes, "l_partkey", "serial", "label").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()


@query("SELECT p_brand AS id, min(p_name) AS cluster_name, max(p_type) AS cluster_princeps, count(*) AS products FROM part GROUP BY 1")
def audit_view(t: Tables) -> DataFrame:
    return catalogue.audit_view(t.part.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.min("p_name").alias("title"), F.max("p_type").alias("subtitle"), F.count("*").alias("count_products")))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 480000))
SELECT 'packages' AS kind, count(*) AS n FROM c UNION ALL SELECT 'products', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM c) UNION ALL SELECT 'composition', 2 * count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM c)""")
def fixture_extraction(t: Tables) -> DataFrame:
    packages = t.lineitem.select(F.col("l_orderkey").alias("cip13"), F.col("l_partkey").alias("cis"))
    composition = t.part.select(F.col("p_partkey").alias("cis"), F.explode(F.split("p_name", " ")).alias("word"))
    parts = catalogue.extract_fixture(t.orders.filter("o_totalprice > 480000").select(F.col("o_orderkey").alias("cip13")), packages, t.part.select(F.col("p_partkey").alias("cis")), composition)
    return store.row_counts(dict(zip(("packages", "products", "composition"), parts, strict=True))).withColumnRenamed("table_name", "kind")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 3 THEN true ELSE CAST(o_orderdate AS DATE) < DATE '1998-01-01' END AS available FROM orders""")
def update_check(t: Tables) -> DataFrame:
    local = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 3, "old").otherwise(F.concat(F.lit("db-"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return store.update_available(t.orders.select("o_orderkey", local.alias("local"), F.lit("db-1998-01-01").alias("remote")), "local", "remote").select("o_orderkey", "available")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS group_id, l_suppkey AS cis FROM orders JOIN lineitem ON o_orderkey = l_orderkey), p AS (SELECT DISTINCT s_suppkey AS cis, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE 'S' || s_suppkey END AS cip_code FROM supplier)
SELECT group_id, cis, cip_code FROM m JOIN p USING (cis)""")
def package_expansion(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("group_id"), F.col("l_suppkey").alias("cis")).distinct()
    packs = t.supplier.select(F.col("s_suppkey").alias("cis"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("").alias("cip13"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("cip7"))
    return catalogue.expand_packages(rows, packs).select("group_id", "cis", "cip_code")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS k FROM part) WHERE k = 1")
def first_lookup(t: Tables) -> DataFrame:
    return catalogue.first_of(t.part, "p_brand", ["p_name", "p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("SELECT p_brand AS cluster_id, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k <= 5 GROUP BY 1")
def sample_names(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return clusters.first_names(rows).select("cluster_id", F.array_join("sample_names", "|").alias("names"))


@query("SELECT p_type, p_partkey, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) WHERE k <= 100")
def head_per_form(t: Tables) -> DataFrame:
    return catalogue.head_per_group(t.part, "p_type", ["p_partkey"], 100).select("p_type", "p_partkey", "place")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%house%'")
def like_nocase(t: Tables) -> DataFrame:
    return t.customer.filter(catalogue.like_nocase("c_mktsegment", "%House%")).select("c_custkey", "c_mktsegment")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, coalesce(CASE WHEN l_tax > 0.02 THEN l_returnflag = 'R' END AND nullif(l_discount, 0.05) = 0, false) AS hospital FROM lineitem""")
def hospital_predicate(t: Tables) -> DataFrame:
    agreement = F.when(F.col("l_tax") > 0.02, F.when(F.col("l_returnflag") == "R", "oui").otherwise("non"))
    price = F.when(F.col("l_discount") == 0.05, 1.0).otherwise(F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", catalogue.hospital_only(agreement, F.lit(None).cast("string"), price).alias("hospital"))


@query("""SELECT p_partkey, p_size > 40 AS narcotic, p_type = 'PROMO' AS otc, false AS dental FROM part""")
def regulatory_flags(t: Tables) -> DataFrame:
    from apotheca.functions import labels

    flags = labels.flag_map(narcotic=F.when(F.col("p_size") > 40, 1), otc=F.col("p_type") == "PROMO", dental=F.lit(None).cast("int"))
    return t.part.select("p_partkey", flags.alias("f")).select("p_partkey", *(F.col("f")[k].alias(k) for k in ("narcotic", "otc", "dental")))


@query("""SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def last_values_first_position(t: Tables) -> DataFrame:
    """The last row's values at the first row's position."""
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    last = rows.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "at").alias("o_orderstatus"), F.min("o_orderkey").alias("o_orderkey"))
    return last.select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS title FROM part")
def title_fallback(t: Tables) -> DataFrame:
    """The first title that isn't blank."""
    return t.part.select("p_partkey", text.first_nonblank(F.lit(None).cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(" "), "p_brand").alias("title"))


@query("""SELECT p_partkey, p_size > 45 OR (p_size <= 5) AS stopped, p_size BETWEEN 6 AND 20 AS watched, p_size % 2 = 0 AS active FROM part""")
def product_predicates(t: Tables) -> DataFrame:
    """P5, P10, P11."""
    from apotheca.functions import labels

    size = F.col("p_size")
    stopped = labels.is_stopped(F.when(size > 45, "Non commercialisée").otherwise("x"), F.lit(1), F.when(size <= 5, 0).otherwise(2))
    watched = labels.is_watched(F.when(size.between(6, 12), " oui ").when(size.between(13, 20), "Surveillance renforcée").otherwise("Non"))
    active = labels.is_active(F.lit("Autorisation abrogée"), F.when(size % 2 == 0, "Commercialisée").otherwise("Non commercialisée"))
    return t.part.select("p_partkey", stopped.alias("stopped"), watched.alias("watched"), active.alias("active"))
