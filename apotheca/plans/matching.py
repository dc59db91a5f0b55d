"""Queries that match names by likeness and by common words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.functions import codes, labels, text
from apotheca.functions.numbers import rounded
from apotheca.operators import aliases, clusters, distinct, fulltext, quality, similarity, subclusters
from apotheca.plans.registry import Tables, query
from apotheca.sources import tsv
from apotheca.sources.store import shared_folder

#: An order's first part gives an ungrouped product: its name without one letter, and a dosage.
LETTER = "o_orderkey % length(p_name)"


@query("""WITH f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p_partkey FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS id, substr(p_name, 1, o_orderkey % length(p_name)) || substr(p_name, o_orderkey % length(p_name) + 2) || ' ' || o_orderkey % 7 * 50 || ' mg' AS name, p_type AS form FROM orders JOIN f ON o_orderkey = l_orderkey JOIN part USING (p_partkey)),
g AS (SELECT min(p_partkey) AS group_id, p_name || CASE WHEN p_size > 25 THEN ' fort' ELSE '' END AS name, p_type AS form FROM part GROUP BY 2, 3),
n AS (SELECT DISTINCT name, form FROM o), t AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(name), 1) + 1), lambda i: substr(' ' || lower(name) || ' ', i, 3))) AS grams FROM (SELECT name FROM n UNION SELECT name FROM g)),
p AS MATERIALIZED (SELECT a.name AS left_name, b.name AS right_name, jaro_winkler_similarity(a.name, b.name) AS name_score FROM (SELECT DISTINCT name, grams FROM n JOIN t USING (name)) a, (SELECT DISTINCT name, grams FROM g JOIN t USING (name)) b
  WHERE len(list_intersect(a.grams, b.grams)) >= 0.3 * (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) - 1e-9),
s AS (SELECT n.name, n.form, g.group_id, round(name_score * 0.7 + jaro_winkler_similarity(n.form, g.form) * (1 - 0.7), 6) AS score FROM n JOIN p ON n.name = left_name JOIN g ON g.name = right_name),
b AS (SELECT name, form, group_id, score FROM s WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY name, form ORDER BY score DESC, group_id) = 1)
SELECT id, group_id, score FROM o LEFT JOIN b ON o.name = b.name AND o.form IS NOT DISTINCT FROM b.form""")
def fuzzy_orphans(t: Tables) -> DataFrame:
    """Products of orders, spelt with a letter missing, attached to the sub-clusters of parts that they are most like."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("p_partkey"))
    at = (F.col("o_orderkey") % F.length("p_name")).cast("int")
    short = F.concat(F.col("p_name").substr(F.lit(1), at), F.col("p_name").substr(at + 2, F.length("p_name")))
    name = F.concat(short, F.lit(" "), (F.col("o_orderkey") % 7 * 50).cast("string"), F.lit(" mg"))
    orphans = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, "p_partkey").select(F.col("o_orderkey").alias("id"), name.alias("name"), F.col("p_type").alias("form"))
    titled = t.part.withColumn("name", F.concat("p_name", F.when(F.col("p_size") > 25, " fort").otherwise("")))
    groups = titled.groupBy("name", F.col("p_type").alias("form")).agg(F.min("p_partkey").alias("group_id"))
    return similarity.attach(orphans, groups).select("id", "group_id", "score")


@query(r"""WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'third' WHEN p_size % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS grp, upper(p_type || ', ' || CASE p_partkey % 2 WHEN 0 THEN 'des ' ELSE '' END || p_name || ' 12.5 mg') AS name, p_partkey AS pos FROM part),
d AS (SELECT grp, name, max(pos) AS pos, list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '([0-9])[.,]([0-9])', '\1DECIMAL\2', 'g'), '[\s\-,.()]+'), lambda t: replace(t, 'DECIMAL', ',')), lambda t: t <> '') AS ws FROM n GROUP BY 1, 2),
s AS (SELECT grp, arg_min(ws, (len(ws), -pos)) AS ws, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT grp, n, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: {'k': -k, 'i': i, 'run': array_to_string(ws[i:i + k - 1], ' ')})))) AS r FROM s),
h AS (SELECT grp, r FROM r JOIN d USING (grp) WHERE regexp_matches(d.name, '\b' || regexp_escape(r.run) || '\b') GROUP BY grp, r, n HAVING count(*) = n)
SELECT grp, (SELECT count(*) FROM n WHERE n.grp = s.grp) AS names, CASE WHEN (SELECT count(*) FROM n WHERE n.grp = s.grp) = 1 THEN (SELECT min(name) FROM n WHERE n.grp = s.grp) ELSE coalesce((SELECT arg_min(r.run, r) FROM h WHERE h.grp = s.grp), '') END AS common FROM s""")
def common_word_runs(t: Tables) -> DataFrame:
    """T11 on rows: the words that all names of a group share; a third of all parts are one group."""
    group = F.when(F.col("p_partkey") % 3 == 0, "third").when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1))
    name = F.upper(F.concat("p_type", F.lit(", "), F.when(F.col("p_partkey") % 2 == 0, "des ").otherwise(""), "p_name", F.lit(" 12.5 mg")))
    rows = t.part.select(group.alias("grp"), name.alias("name"), F.col("p_partkey").alias("pos"))
    return clusters.common_runs(rows, ["grp"]).select("grp", "names", "common")


@query("""SELECT event_id, '340093' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS gtin, CASE event_id % 5 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE 'L' || user_id END AS lot,
CASE event_id % 5 WHEN 3 THEN NULL ELSE event_type || event_id END AS serial, CASE event_id % 5 WHEN 2 THEN DATE '2027-02-28' END AS expires FROM events""")
def gs1_separators(t: Tables) -> DataFrame:
    """D1f where it is odd: empty lots, no-break spaces and tabs as separators, fields that nothing can read, repeated ones."""
    code = F.concat(F.lit("010340093"), F.lpad(F.col("event_id").cast("string"), 7, "0"))
    lot, serial = F.concat(F.lit("L"), F.col("user_id").cast("string")), F.concat("event_type", F.col("event_id").cast("string"))
    kinds = (
        F.concat(code, F.lit("10\x1d21"), serial), F.concat(code, F.lit("\u00a010"), lot, F.lit("\u202f\t21"), serial), F.concat(code, F.lit("17270200"), F.lit("10"), lot, F.lit(" 21"), serial),
        F.concat(code, F.lit("9910"), lot, F.lit("\x1d21"), serial), F.concat(F.lit("21old\x1d10"), lot, F.lit("\x1d"), code, F.lit("10\x1d21"), serial, F.lit("\x1d21")),
    )
    raw = F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", codes.parse_gs1(raw).alias("g")).select("event_id", "g.gtin", "g.lot", "g.serial", "g.expires")


#: Texts, whether each is a form only, and whether it describes a formulation.
FORMS = (
    ("Comprimé à croquer", False, False), ("gélule L.P", True, True), ("poudre pour {}", False, True), ("{}", False, False), ("Sans sucre, {} édulcorée", False, True), ("en solution, {}", False, False),
    ("{} POUR UNE TRÈS LONGUE DESCRIPTION DE CE PRODUIT-LÀ ET DE SES EMPLOIS", False, True), ("comprimés pelliculés", True, True), ("Gel-crème", True, True), ("a b", True, True), ("", False, False), ("Solution buvable {}", False, False),
    ("arôme gel", False, True), ("Arôme gel", False, False),
)


@query(f"""SELECT p_partkey, only_form, formulation FROM part JOIN (VALUES {", ".join(f"({i}, {only}, {either})" for i, (_, only, either) in enumerate(FORMS))}) f(i, only_form, formulation) ON p_partkey % {len(FORMS)} = i""")
def form_descriptions(t: Tables) -> DataFrame:
    """Texts that are forms only, and texts that describe a formulation."""
    pattern = F.element_at(F.array(*(F.lit(p) for p, _, _ in FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    label = F.replace(pattern, F.lit("{}"), F.upper("p_brand"))
    return t.part.select("p_partkey", labels.is_form_only(label).alias("only_form"), labels.is_formulation(label).alias("formulation"))


@query("""SELECT p_partkey, upper(p_name) || ' ' || replace(upper(p_brand), '#', ' ') || ' AUTRE ' || upper(p_name) || ' ' || upper(p_type) || ' POUR ENFANT' AS keywords,
CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '')) WHEN 2 THEN '' ELSE 'a  b ' END AS prefix FROM part""")
def keyword_vectors(t: Tables) -> DataFrame:
    """T16 with stop words, dosages and repeated entries; T17 without case, with the condensed spelling, and of one text."""
    name, brand, kind = F.col("name"), F.col("brand"), F.col("kind")
    one = F.array(F.lit("autré"), name, F.lit("Autré"), F.lit(""))
    keywords = text.keyword_vector(name, brand, F.filter(one, lambda x: x == "autré"), F.concat(name, F.lit(" comprimé 500 mg, "), kind, F.lit(" 5+ ,")), F.array(F.lit("  "), F.lit("pour enfant base"), F.lit(None).cast("string")))
    first = F.substring_index(name, " ", 1)
    dense = F.upper(F.replace(name, F.lit(" "), F.lit("")))
    kinds = (
        F.array(F.concat(name, F.lit(" 500")), F.concat(F.upper(name), F.lit("  1000 mg"))), F.array(F.concat(first, F.lit("-"), F.substring_index(name, " ", -1), F.lit(" 500")), F.concat(dense, F.lit("1000"))),
        F.array(F.lit("x y"), name), F.array(F.lit("a  b ")),
    )
    parts = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    found = distinct.once_each(parts, {"name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type")}, {"keywords": keywords})
    found = distinct.once_each(found, {"name": F.col("p_name"), "number": F.col("p_size") % 4}, {"prefix": text.common_word_prefix(F.element_at(F.array(*kinds), F.col("number") + 1))})
    return found.select("p_partkey", "keywords", "prefix")


#: A part's name ends in a dosage of one of its line items, spelt in one of four ways, of no line item, or in none.
ENDS = ("{} mg", "{}mg", "{},0 mg", "1{} MG ", " {}.0 mg")


@query("""WITH d AS (SELECT l_partkey AS cis, CAST(l_quantity AS BIGINT) AS q, l_orderkey, l_linenumber FROM lineitem), f AS (SELECT cis, arg_min(q, (l_orderkey, l_linenumber)) AS q FROM d GROUP BY 1),
p AS (SELECT p_partkey AS cis, p_brand AS chemical_id, lower(p_type) AS form, upper(split_part(p_name, ' ', 2)) || coalesce(CASE p_partkey % 6 WHEN 0 THEN ' ' || q || ' mg' WHEN 1 THEN ' ' || q || 'mg' WHEN 2 THEN ' ' || q || ',0 mg' WHEN 3 THEN ' 1' || q || ' MG ' WHEN 4 THEN '  ' || q || '.0 mg' END, '') AS name FROM part LEFT JOIN f ON p_partkey = cis),
m AS (SELECT DISTINCT chemical_id, form, q FROM p JOIN d USING (cis)), v AS (SELECT chemical_id, form, unnest([q || ' mg', q || 'mg', q || ',0 mg', q || ',0mg', q || '.0 mg', q || '.0mg']) AS v FROM m),
n AS (SELECT DISTINCT chemical_id, form, name FROM p), h AS (SELECT chemical_id, form, name, max(length(v)) AS cut FROM n JOIN v USING (chemical_id, form) WHERE ends_with(' ' || lower(trim(name)), ' ' || v) GROUP BY 1, 2, 3),
c AS (SELECT p.*, CASE WHEN cut IS NULL THEN trim(name) ELSE trim(left(trim(name), length(trim(name)) - cut)) END AS brand FROM p LEFT JOIN h USING (chemical_id, form, name)),
w AS (SELECT chemical_id, form, brand, count(*) AS votes, min(cis) AS pos FROM c GROUP BY 1, 2, 3), b AS (SELECT chemical_id, form, arg_max(brand, (votes, -pos)) AS brand, max(votes) AS votes FROM w GROUP BY 1, 2)
SELECT chemical_id, form, brand, votes, count(*) OVER (PARTITION BY chemical_id, brand) AS merged_forms FROM b""")
def form_subclusters(t: Tables) -> DataFrame:
    """Brands of parts by form without the dosages of their line items, and the forms that one brand joins."""
    quantity = F.col("l_quantity").cast("long").cast("string")
    lines = t.lineitem.select(F.col("l_partkey").alias("cis"), quantity.alias("q"), "l_orderkey", "l_linenumber")
    first = lines.groupBy("cis").agg(F.min_by("q", F.struct("l_orderkey", "l_linenumber")).alias("q"))
    ends = F.element_at(F.array(*(F.lit(f" {e}") for e in ENDS), F.lit("")), (F.col("cis") % (len(ENDS) + 1) + 1).cast("int"))
    stem = F.upper(F.element_at(F.split("p_name", " "), 2))
    parts = t.part.select(F.col("p_partkey").alias("cis"), F.col("p_brand").alias("chemical_id"), F.col("p_type").alias("shape"), "p_name").join(first, "cis", "left")
    named = parts.withColumn("name", F.concat(stem, F.coalesce(F.replace(ends, F.lit("{}"), F.col("q")), F.lit(""))))
    placed = subclusters.by_form(named.select("cis", "shape", "name"), named.select("cis", "chemical_id"))
    mask = subclusters.dosage_mask(placed, lines.select("cis", F.concat("q", F.lit(" mg")).alias("dosage")))
    chosen = subclusters.representatives(placed.select("chemical_id", "subcluster_id", "name", F.col("cis").alias("pos")), subclusters.without_dosages(placed, mask))
    forms = placed.select("subcluster_id", "form").distinct()
    return subclusters.merged(chosen).join(forms, "subcluster_id").select("chemical_id", "form", "brand", "votes", "merged_forms")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN ['SYSTEMIC'] WHEN 1 THEN ['LOCAL'] WHEN 2 THEN ['EXTERNAL'] ELSE ['SYSTEMIC', 'LOCAL'] END AS routes, [chr(CAST(65 + p_partkey % 2 AS INTEGER)) || '0' || p_partkey % 3, 'C0' || p_size % 5 || CASE WHEN p_size > 9 THEN 'AB' ELSE '' END] AS atc, p_partkey % 7 = 1 AS bridged FROM part),
a AS (SELECT id AS alias, CASE WHEN id < 6 THEN (id + 1) % 6 ELSE id // 2 END AS target FROM c WHERE id % 11 <> 7),
l AS (SELECT alias, target FROM a JOIN c s ON alias = s.id JOIN c e ON target = e.id WHERE alias < 6 OR ((list_has_any(s.routes, e.routes) OR (list_has_any(s.routes, ['SYSTEMIC', 'EXTERNAL']) AND list_contains(e.routes, 'LOCAL')) OR (list_contains(s.routes, 'LOCAL') AND list_contains(e.routes, 'SYSTEMIC')))
  AND (list_has_any(list_transform(s.atc, lambda x: x[:3]), list_transform(e.atc, lambda x: x[:3])) OR (e.bridged AND len(list_filter(list_concat(s.atc, e.atc), lambda x: x[1] NOT IN ('A', 'C'))) = 0)))),
w AS (SELECT alias, target AS stop FROM l UNION SELECT w.alias, l.target FROM w JOIN l ON w.stop = l.alias), r AS (SELECT w.alias, coalesce(min(stop) FILTER (l.alias IS NULL), min(stop)) AS root FROM w LEFT JOIN l ON w.stop = l.alias GROUP BY 1)
SELECT p_partkey, coalesce(root, p_partkey) AS cluster FROM part LEFT JOIN r ON alias = p_partkey""")
def cluster_aliases(t: Tables) -> DataFrame:
    """Parts that are other parts by chains of renames, one of them a cycle, where routes and codes let each pair merge."""
    routes = F.element_at(F.array(F.array(F.lit("orale")), F.array(F.lit("nasale")), F.array(F.lit("inhalation")), F.array(F.lit("rectale"))), F.col("p_size") % 4 + 1)
    code = F.concat(F.chr(F.lit(65) + F.col("p_partkey") % 2), F.lit("0"), (F.col("p_partkey") % 3).cast("string"))
    low = F.concat(F.lit("C0"), (F.col("p_size") % 5).cast("string"), F.when(F.col("p_size") > 9, "AB").otherwise(""))
    bridges = F.when(F.col("p_partkey") % 7 == 1, F.array(F.lit("A"), F.lit("C")))
    known = t.part.select(F.col("p_partkey").alias("cluster_id"), aliases.route_groups(F.array_join(routes, " ; ")).alias("routes"), F.array(code, low).alias("atc"), bridges.alias("bridges"))
    id_ = F.col("p_partkey")
    renames = t.part.filter(id_ % 11 != 7).select(id_.alias("alias"), F.when(id_ < 6, (id_ + 1) % 6).otherwise(F.floor(id_ / 2)).alias("target"))
    merges = renames.filter("alias < 6").unionByName(aliases.allowed(renames.filter("alias >= 6"), known))
    return aliases.canonical(t.part.select("p_partkey", id_.alias("cluster")), aliases.resolve(merges), "cluster")


#: Conditions of prescription, and the flags that they set.
CONDITIONS = (
    ("liste I", "LIST_1"), ("Liste  II", "LIST_2"), ("STUPÉFIANTS, liste I", "LIST_1,NARCOTIC"), ("usage hospitalier", "HOSPITAL"), ("cabinet dentaire ; médicament d'exception", "DENTAL,EXCEPTION"),
    ("prescription restreinte", "RESTRICTED"), ("listes i", ""), ("", ""),
)


def _conditions(t: Tables) -> DataFrame:
    """Line items' parts with a condition that hangs on the order, from lines of the file of conditions."""
    condition = F.element_at(F.array(*(F.lit(c) for c, _ in CONDITIONS)), (F.least(F.col("l_orderkey") % 61, F.lit(len(CONDITIONS) - 1)) + 1).cast("int"))
    cells = F.array(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), condition)
    return tsv.conditions(t.lineitem.select(F.col("l_orderkey").alias("pos"), F.array_join(cells, "\t").alias("value"))).rows


@query(f"""WITH f(i, flags) AS (VALUES {", ".join(f"({i}, '{flags}')" for i, (_, flags) in enumerate(CONDITIONS))}), s AS (SELECT DISTINCT l_partkey, unnest(string_split(flags, ',')) AS flag FROM lineitem JOIN f ON least(l_orderkey % 61, {len(CONDITIONS) - 1}) = i),
g AS (SELECT p_brand || p_type AS cluster_id, flag, count(*) AS products FROM part JOIN s ON p_partkey = l_partkey WHERE flag <> '' GROUP BY ALL)
SELECT cluster_id, flag, products FROM g""")
def prescription_flags(t: Tables) -> DataFrame:
    """Flags of conditions of prescription; one product's flag is its whole cluster's."""
    placed = t.part.select(F.concat("p_brand", "p_type").alias("cluster_id"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("cis"))
    return quality.cluster_flags(placed, _conditions(t))


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '0') ELSE '' END AS cis, CASE WHEN o_orderkey % 3 = 0 THEN '34009' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ELSE '' END AS cip13, left(o_orderpriority, 1) AS code, o_orderdate FROM orders WHERE o_orderkey % 5 <> 0)
SELECT cis, cip13, arg_max(CASE code WHEN '1' THEN 'Rupture de stock' WHEN '2' THEN 'Tension d''approvisionnement' WHEN '3' THEN 'Arrêt de commercialisation' WHEN '4' THEN 'Remise à disposition' ELSE 'own words' END, o_orderkey) AS state, arg_max(strftime(o_orderdate, '%d/%m/%Y'), o_orderkey) AS since FROM a GROUP BY 1, 2""")
def availability_states(t: Tables) -> DataFrame:
    """The last state of availability of each product or package, from lines of the file of shortages; others name neither."""
    asked = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3)
    cis, cip = F.when(asked != 0, F.lpad(F.col("o_custkey").cast("string"), 8, "0")), F.when(asked == 0, F.concat(F.lit("34009"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")))
    cells = [F.coalesce(c, F.lit("")) for c in (cis, cip, F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)), F.lit("own words"), F.date_format("o_orderdate", "dd/MM/yyyy"))]
    lines = t.orders.select(F.col("o_orderkey").alias("pos"), F.array_join(F.array(*cells), "\t").alias("value"))
    last = F.max_by(F.struct("state", "since"), "pos").alias("a")
    return tsv.availability(lines).rows.groupBy("cis", "cip13").agg(last).select("cis", "cip13", "a.state", "a.since")


WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)"


def _text_index(t: Tables, *held: str) -> fulltext.TextIndex:
    """All documents, appended in two segments, with what the query's search reads."""
    index = fulltext.TextIndex(t.spark, f"{shared_folder(t.spark)}/texts-{uuid.uuid4().hex}", size=128, files=4, held=held)
    for batch in range(2):
        index.append(t.documents.filter(F.pmod(F.col("doc_id"), F.lit(2)) == batch), "doc_id", "text", batch)
    return index


@query(f"""WITH {WORDS} SELECT doc_id FROM w WHERE (list_contains(ws, 'thanedble') OR list_contains(ws, 'eriner')) AND list_contains(ws, 'the') AND NOT contains(' ' || array_to_string(ws, ' ') || ' ', ' is the ') AND len(list_filter(ws, lambda x: starts_with(x, 'att'))) > 0""")
def search_grammar(t: Tables) -> DataFrame:
    """alternatives, a phrase that must not stand, and a prefix, from the postings alone."""
    return _text_index(t, "postings").find('(Thanedble OR eriner) AND the NOT "is the" att*').select(F.col("key").alias("doc_id"))


@query(f"""WITH {WORDS}, n AS (SELECT count(*) AS docs, sum(len(ws)) / count(*) AS mean_length FROM w), h AS (SELECT doc_id, len(ws) AS length, x AS word, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS x FROM w) WHERE x IN ('eriner', 'thanedble', 'the') GROUP BY doc_id, len(ws), x), f AS (SELECT word, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT doc_id, round(-sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM h JOIN f USING (word), n GROUP BY 1)
SELECT score, count(*) AS texts FROM (SELECT score FROM s ORDER BY score LIMIT 20) GROUP BY 1""")
def search_top(t: Tables) -> DataFrame:
    """F3, O14 from the postings, with blocks passed over: the scores of the first twenty, for texts of equal scores are many."""
    return _text_index(t, "postings").top(["Eriner", "thanedble", "the"], 20).groupBy(rounded(F.col("score"), 6).alias("score")).agg(F.count("*").alias("texts"))


@query("""SELECT doc_id, length(text) AS letters FROM documents WHERE contains(lower(text), 'hanedb') AND contains(lower(text), 'rine') ORDER BY doc_id LIMIT 50""")
def search_pruned(t: Tables) -> DataFrame:
    """substrings through trigrams, reading only row groups that hold candidates."""
    return _text_index(t, "grams").containing("haNEdb at rine").select(F.col("key").alias("doc_id"), F.length("text").cast("long").alias("letters"))
