"""Queries over texts, codes and the event stream: search, normalisers, barcodes, stock and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apotheca.functions import codes, labels, text, words
from apotheca.functions.numbers import rounded
from apotheca.operators import catalogue, distinct, search, stock
from apotheca.plans.registry import Tables, query
from apotheca.sources import tsv
from apotheca.sources.store import shared_folder
from apotheca.streaming import scans

#: Hours stand for the seconds of the original cooldown, for the events of a user lie hours apart.
COOLDOWN = 6 * 3600

# Texts of documents as DuckDB folds them: ligatures, then marks.
FOLD = "strip_accents(replace(replace(replace(replace(replace({x}, 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'))"
WHITE = r"[\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower({FOLD.format(x='text')}), '[^a-z0-9' || '{WHITE[1:-1]}' || ']', ' ', 'g'), '{WHITE}+', ' ', 'g'), '^ | $', '', 'g')) AS normal FROM documents""")
def text_normalise_search(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.normalise_search("text")).alias("normal"))


@query("""SELECT p_partkey, upper(p_name) || ' 500 MG' AS subtracted, upper(string_split(p_name, ' ')[1]) AS brand, upper(p_name) AS fallback, upper(p_name) || ' ' || upper(p_type) AS product FROM part""")
def text_normalise_names(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" 500 mg "), F.lower("p_type"), F.lit(" (SE)"))
    return t.part.select(
        "p_partkey",
        text.subtract_shape(name, F.lower("p_type")).alias("subtracted"),
        text.brand_name(name).alias("brand"),
        text.clean_fallback_label(F.concat(F.lit("molecule - "), "p_name", F.lit(" comprimé "), "p_type")).alias("fallback"),
        text.normalise_product(F.concat_ws("  ", F.lit(" "), "p_name", "p_type", F.lit("(SE)"))).alias("product"),
    )


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) || ', ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS principles, upper(p_name) AS maker, p_name AS label, p_brand AS holder, p_name AS masked,
upper(p_name) AS key, list_aggregate(list_sort(list_distinct([upper(p_name), p_type])), 'string_agg', ' ') AS common, p_name AS princeps, upper(substr(p_name, 1, 1)) AS letter FROM part""")
def text_labels(t: Tables) -> DataFrame:
    name, kind, brand = F.col("name"), F.col("kind"), F.col("brand")
    results = {
        "principles": text.format_principles(F.concat(name, F.lit(" ,,"), kind)),
        "maker": labels.maker_name(F.concat(F.lit("Laboratoires "), name, F.lit(" SA"))),
        "label": labels.product_label(F.concat(F.lit("12345678 "), name, F.lit(",.-"))),
        "holder": labels.main_holder(F.concat(F.lit(" ;"), brand, F.lit(" SAS; other"))),
        "masked": labels.masked_label(F.concat(name, F.lit(", comprimé")), F.lit("Comprimé")),
        "key": labels.grouping_key(F.concat(name, F.lit(" 500 mg pour 5 ml (x) - brand"))),
        "common": text.common_principles(F.concat(name, F.lit("+"), kind, F.lit("+"), name)),
        "princeps": text.princeps_label(F.concat(kind, F.lit(" - "), name)),
        "letter": text.initial(name),
    }
    rows = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    return distinct.once_each(rows, {"name": F.col("p_name"), "kind": F.col("p_type"), "brand": F.col("p_brand")}, results).select("p_partkey", *results)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 AND p_size % 3 = 0 THEN 'CHLORURE DE SODIUM' WHEN p_partkey % 3 = 2 AND p_size % 3 = 1 THEN '' ELSE upper(p_name) END AS substance FROM part""")
def salt_strip(t: Tables) -> DataFrame:
    """Every salt prefix and suffix of the lists before or after a part's name, and what is no name and salt."""
    prefixes, suffixes = F.array(*map(F.lit, words.SALT_PREFIXES)), F.array(*map(F.lit, words.SALT_SUFFIXES))
    at = F.floor(F.col("p_partkey") / 3).cast("int")
    prefix, suffix = F.element_at(prefixes, at % len(words.SALT_PREFIXES) + 1), F.element_at(suffixes, at % len(words.SALT_SUFFIXES) + 1)
    other = F.when(F.col("p_size") % 3 == 0, F.lit("Chlorure de sodium")).when(F.col("p_size") % 3 == 1, " ").otherwise(F.concat("p_name", F.lit(" sodique dihydraté (sulfate de) ")))
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(prefix, F.when(F.endswith(prefix, F.lit("'")), "").otherwise(" "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", suffix)).otherwise(other)
    return t.part.select("p_partkey", text.substance_name(F.lower(label)).alias("substance"))


#: A principle in many spellings, {} being a name, and what the index holds for it.
SPELLINGS = (
    ("Sodium ({} de)", "{}"), ("{} (chlorhydrate de)", "{}"), ("(R)-{}", "{}"), ("( S ) - {}", "{}"), ("Omega 3 {}", "OMEGA-3"), ("{} omega-3", "OMEGA-3"), ("Solution de {}", "{}"), ("Concentrat de solution de {}", "{}"),
    ("{} concentrat de x", "{} X"), ("Magnésium de {}", "{}"), ("{} de potassium", "{}"), ("{} d'zinc", "{}"), ("{} maléate dihydraté", "{}"), ("{} dihydraté maléate", "{} DIHYDRATE"), ("{}, forme pulvérulente", "{}"),
    ("{} liquide", "{}"), ("Acide {}", "{}"), ("Chlorhydrate de {}", "{}"), ("acétate d'{}", "{}"), ("{} betadex-clathrate", "{}"), ("{} carbocysteine", "{} CARBOCISTEINE"), ("clavulanate de {}", "CLAVULANIQUE"),
    ("{} acide valproique", "{} ACIDE VALPROATE"), ("calcitonine {} de saumon", "CALCITONINE"), ("{} tryptophane L", "{} TRYPTOPHANE"), ("{} , ", "{}"), ("{} (sulfate)", "{}"), ("{} tert-butylamine", "{}"),
)


@query(f"""SELECT p_partkey, replace(([{', '.join("'" + e + "'" for _, e in SPELLINGS)}])[p_partkey % {len(SPELLINGS)} + 1], '{{}}', upper(p_name)) AS principle FROM part""")
def index_principles(t: Tables) -> DataFrame:
    spelled = F.element_at(F.array(*(F.lit(x) for x, _ in SPELLINGS)), (F.col("p_partkey") % len(SPELLINGS) + 1).cast("int"))
    principle = F.replace(spelled, F.lit("{}"), F.col("p_name"))
    return distinct.once_each(t.part.select("p_partkey", "p_name"), {"spelling": principle}, {"principle": text.index_principle("spelling")}).select("p_partkey", "principle")


@query("""WITH f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Comprimé' WHEN 1 THEN 'solution INJECTable' WHEN 2 THEN 'sirop' WHEN 3 THEN 'crème' ELSE p_type END AS form FROM part)
SELECT p_partkey, CASE form WHEN 'Comprimé' THEN 'ORAL_SOLID' WHEN 'sirop' THEN 'ORAL_LIQUID' WHEN 'solution INJECTable' THEN 'INJECTABLE' WHEN 'crème' THEN 'DERMAL' ELSE 'OTHER' END AS galenic,
CASE form WHEN 'Comprimé' THEN 'solid' WHEN 'sirop' THEN 'liquid' WHEN 'solution INJECTable' THEN 'liquid' WHEN 'crème' THEN 'semiSolid' ELSE 'other' END AS kind, form = 'Comprimé' OR form = 'sirop' OR form = 'crème' OR form = 'solution INJECTable' AS only_form FROM f""")
def galenic_category(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 5
    form = F.when(kind == 0, "Comprimé").when(kind == 1, "solution INJECTable").when(kind == 2, "sirop").when(kind == 3, "crème").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", labels.galenic_class(form).alias("galenic"), labels.form_kind(form).alias("kind"), labels.is_form_only(form).alias("only_form"))


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' Actif ' WHEN 'view' THEN 'abrogé' WHEN 'error' THEN 'n/a' WHEN 'signup' THEN 'NON COMMERCIALISÉ' ELSE NULL END AS x FROM events)
SELECT event_id, CASE trim(x) WHEN 'Actif' THEN 'active' WHEN 'abrogé' THEN 'revoked' WHEN 'NON COMMERCIALISÉ' THEN 'not_marketed' ELSE 'unknown' END AS state, CASE trim(x) WHEN 'Actif' THEN 'En cours' WHEN 'abrogé' THEN 'Abrogé' WHEN 'NON COMMERCIALISÉ' THEN 'Non commercialisé' ELSE 'Inconnu' END AS label,
CASE WHEN x IS NULL OR x = 'n/a' THEN '' ELSE trim(x) END AS known, x IS NOT NULL AS truth, coalesce(x = 'abrogé', false) AS revoked, coalesce(x = 'NON COMMERCIALISÉ', false) AS unmarketed FROM s""")
def status_canon(t: Tables) -> DataFrame:
    kinds = {"click": " Actif ", "view": "abrogé", "error": "n/a", "signup": "NON COMMERCIALISÉ"}
    x = F.create_map(*(F.lit(v) for pair in kinds.items() for v in pair))[F.col("event_type")]
    x = F.when(F.col("event_type").isin(*kinds), x)
    state = labels.commercial_state(x)
    return t.events.select("event_id", state.alias("state"), labels.state_label(state).alias("label"), labels.known(x).alias("known"), labels.truth(x).alias("truth"), labels.is_revoked_label(x).alias("revoked"), labels.is_unmarketed_label(x).alias("unmarketed"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'revoked' END, CASE WHEN value > 50 THEN 'shortage' END, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'expired' END) AS flags FROM events""")
def status_flag_sets(t: Tables) -> DataFrame:
    flags = labels.status_flags(F.when(F.col("event_type") == "view", "Abrogé"), F.when(F.col("value") > 50, "rupture").otherwise(" "), "ts", F.expr("timestamp_ntz'2024-01-10'"))
    return t.events.select("event_id", F.array_join(flags, ",").alias("flags"))


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS homeopathic, CASE WHEN s_suppkey % 3 = 0 THEN 'LAB' WHEN s_suppkey % 5 = 0 THEN 'KEYWORD' END AS reason, s_suppkey % 7 = 0 AS wide FROM supplier""")
def homeopathy_flags(t: Tables) -> DataFrame:
    reason = labels.homeopathy_reason(F.when(F.col("s_suppkey") % 3 == 0, "Laboratoires Boiron").otherwise(F.col("s_name")), F.when(F.col("s_suppkey") % 5 == 0, "x dilution y").otherwise("plain"))
    wide = labels.is_homeopathic(F.when(F.col("s_suppkey") % 7 == 0, "ARNICA 9CH").otherwise("PLAIN 500 MG"))
    return t.supplier.select("s_suppkey", reason.isNotNull().alias("homeopathic"), reason.alias("reason"), wide.alias("wide"))


@query("""SELECT event_id, lpad(CAST(event_id AS VARCHAR), 13, '3400900000000') AS gtin, CASE WHEN starts_with(lpad(CAST(event_id AS VARCHAR), 13, '3400900000000'), '34009') THEN substr(lpad(CAST(event_id AS VARCHAR), 13, '3400900000000'), 6, 7) END AS short_code,
'S' || user_id AS serial, 'L' || event_type AS lot, CAST(ts AS DATE) AS expires, CAST(NULL AS DATE) AS made FROM events""")
def gs1_parse(t: Tables) -> DataFrame:
    """Barcodes are built from the events' fields and parsed back to them."""
    raw = codes.build_gs1(F.lpad(F.col("event_id").cast("string"), 13, "3400900000000"), F.to_date("ts"), F.concat(F.lit("L"), "event_type"), F.concat(F.lit("S"), F.col("user_id").cast("string")))
    return t.events.select("event_id", codes.parse_gs1(raw).alias("g")).select("event_id", "g.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE p_size % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 0.001 WHEN 2 THEN p_size * 1000000.0 ELSE CAST(p_size AS DOUBLE) END AS mg,
CASE WHEN p_size % 7 = 0 THEN 999 ELSE p_size END AS whole, CASE WHEN p_size % 7 = 0 THEN 'a' ELSE replace(printf('%.2f', p_retailprice), '.', ',') || ' €' END AS shown FROM part""")
def price_parse(t: Tables) -> DataFrame:
    bad = F.col("p_size") % 7 == 0
    written = F.when(bad, "").otherwise(F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")))
    unit = F.element_at(F.array(*map(F.lit, ("g", "mcg", "kg", "mg"))), F.col("p_size") % 4 + 1)
    return t.part.select(
        "p_partkey", codes.price(written).alias("price"), codes.dosage_mg(F.col("p_size").cast("double"), unit).cast("double").alias("mg"),
        codes.whole_number(F.when(bad, "x").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))), 999).alias("whole"), F.when(bad, "a").otherwise(text.euro("p_retailprice")).alias("shown"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_array_length('["' || event_type || '", "' || user_id || '"]') AS INTEGER) AS n, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || user_id ELSE event_type END AS items, event_id % 3 <> 0 AS valid FROM events""")
def json_ops(t: Tables) -> DataFrame:
    listed = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    either = F.when(F.col("event_id") % 2 == 0, listed).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ,")))
    maybe = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}x"))).otherwise(F.col("props"))
    return t.events.select(
        "event_id", codes.setting(F.encode("props", "UTF-8"), "map")["k"].cast("int").alias("k"), F.json_array_length(listed).alias("n"), F.array_join(codes.text_list(either), "|").alias("items"), codes.is_json(maybe).alias("valid")
    )


@query("""SELECT event_id, user_id, ts, label FROM (SELECT event_id, user_id, ts, coalesce(c_name, 'user ' || user_id) AS label FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 ORDER BY ts DESC, event_id DESC LIMIT 500)""")
def scan_history(t: Tables) -> DataFrame:
    events = t.events.withColumn("place_id", (F.col("event_id") % 25).cast("int"))
    names = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return catalogue.history(events, names, t.nation.select(F.col("n_nationkey").alias("place_id"), "n_name"), 9999).select("event_id", "user_id", "ts", "label")


@query("""SELECT doc_id, substr(text, 1, 0) || lang AS lang FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version') ORDER BY doc_id LIMIT 50""")
def search_substring(t: Tables) -> DataFrame:
    return search.search(t.documents, "text", "LICENSE of Version", "doc_id").select("doc_id", "lang")


@query(f"""SELECT doc_id, lang FROM documents WHERE contains(lower({FOLD.format(x='text')}), 'tion') AND contains(lower({FOLD.format(x='text')}), 'eaux')""")
def search_folded(t: Tables) -> DataFrame:
    """All documents that hold every word, without accents and in any order."""
    return t.documents.filter(search.matches("text", "Éaux tion éaux".replace("Éaux", "EAUX").replace("éaux", "eaux"), fold=True)).select("doc_id", "lang")


@query("""SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100""")
def search_empty(t: Tables) -> DataFrame:
    """an empty query lists all by title."""
    return search.search(t.part, "p_name", "  ", "p_partkey").select("p_partkey", "p_name")


@query("""SELECT trigram, p_partkey, count(*) AS n FROM (SELECT p_partkey, lower(substr(p_name, i, 3)) AS trigram FROM part, generate_series(1, 64) s(i) WHERE i <= length(p_name) - 2) GROUP BY 1, 2""")
def trigram_postings(t: Tables) -> DataFrame:
    return search.trigrams(t.part, "p_partkey", "p_name")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'olt') AND contains(lower(p_name), 'blu') ORDER BY p_partkey LIMIT 50""")
def search_indexed(t: Tables) -> DataFrame:
    """through the trigram postings, written once."""
    place = f"{shared_folder(t.spark)}/trigrams-{uuid.uuid4().hex}"
    search.write_index(t.part, "p_partkey", "p_name", place)
    return search.search_index(t.spark.read.parquet(place), t.part, "p_partkey", "p_name", "OLT of bLu", "p_partkey").select("p_partkey", "p_name")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents), n AS (SELECT count(*) AS docs, avg(len(ws)) AS mean_length FROM w),
h AS (SELECT doc_id, len(ws) AS length, x AS word, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS x FROM w) WHERE x IN ('license', 'version', 'the') GROUP BY doc_id, len(ws), x), f AS (SELECT word, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(-sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM h JOIN f USING (word), n GROUP BY 1""")
def search_bm25(t: Tables) -> DataFrame:
    return search.bm25(t.documents, "doc_id", "text", ["License", "version", "the"]).select("doc_id", rounded(F.col("score"), 6).alias("score"))


@query("""SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS BIGINT) AS stock_count, arg_min(event_type, (ts, event_id)) AS event_type, max(ts) AS updated_at FROM events GROUP BY 1""")
def restock_accumulate(t: Tables) -> DataFrame:
    rows = t.events.withColumn("amount", F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long"))
    return stock.accumulate(rows, "user_id", "amount", ["ts", "event_id"], ["event_type"])


@query("""WITH RECURSIVE d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE -1 END AS delta FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS quantity, CAST(0 AS BIGINT) AS deletions FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, d.k, CASE WHEN f.quantity + d.delta <= 0 THEN 0 ELSE f.quantity + d.delta END, f.deletions + CASE WHEN f.quantity + d.delta <= 0 THEN 1 ELSE 0 END FROM f JOIN d ON d.user_id = f.user_id AND d.k = f.k + 1)
SELECT user_id, arg_max(quantity, k) AS quantity, max(deletions) AS deletions FROM f GROUP BY 1""")
def quantity_fold(t: Tables) -> DataFrame:
    rows = t.events.withColumn("delta", F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(-1))
    return stock.fold_quantity(rows, "user_id", "delta", ["ts", "event_id"])


@query("""SELECT user_id, quantity FROM (SELECT user_id, arg_max(CAST(floor(value) AS BIGINT) - 5, (ts, event_id)) AS quantity FROM events GROUP BY 1) WHERE quantity >= 0""")
def quantity_set(t: Tables) -> DataFrame:
    return stock.set_quantity(t.events.withColumn("quantity", F.floor("value") - 5), "user_id", "quantity", ["ts", "event_id"])


@query("SELECT user_id, count(*) % 2 = 1 AS checked FROM events GROUP BY 1")
def toggle_parity(t: Tables) -> DataFrame:
    return stock.toggled(t.events, "user_id")


@query("""SELECT event_id, user_id, user_id || '_' || json_extract_string(props, '$.k') AS box, CASE WHEN row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) = 1 THEN 'added' ELSE 'duplicate' END AS outcome FROM events""")
def unique_box(t: Tables) -> DataFrame:
    rows = t.events.withColumn("box", codes.box_label(F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), F.lit("")))
    return stock.mark_duplicates(rows, ["box"], ["ts", "event_id"]).select("event_id", "user_id", "box", "outcome")


@query("""SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS stock_count FROM events GROUP BY 1""")
def unique_box_stock(t: Tables) -> DataFrame:
    return stock.add_unique_boxes(t.events.withColumn("box", F.get_json_object("props", "$.k")), ["box"], "user_id", ["ts"])


@query("""SELECT 'items' AS kind, user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250) AND event_type = 'purchase' GROUP BY 2
UNION ALL SELECT 'scans', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250) AND event_type <> 'purchase' GROUP BY 2""")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.events.filter("value > 250").select("user_id").distinct()
    items, others = stock.delete_cascade(t.events.filter("event_type = 'purchase'"), t.events.filter("event_type <> 'purchase'"), gone, "user_id")
    return catalogue.union_all(*(df.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "user_id", "n") for kind, df in (("items", items), ("scans", others))))


COOLED = f"""RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, event_id, ts AS last, true AS accepted FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) >= {COOLDOWN}::BIGINT * 1000000 THEN o.ts ELSE f.last END, epoch_us(o.ts) - epoch_us(f.last) >= {COOLDOWN}::BIGINT * 1000000 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)"""


@query(f"WITH {COOLED} SELECT user_id, event_id, accepted FROM f")
def cooldown_filter(t: Tables) -> DataFrame:
    return scans.cooldown(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", COOLDOWN, "event_id").select("user_id", "event_id", "accepted")


@query(f"WITH {COOLED} SELECT user_id, event_id FROM f WHERE accepted")
def cooldown_streamed(t: Tables) -> DataFrame:
    """The same filter as a stream with state per user, over several batches, to the end of what there is."""
    source, place = _stream(t, "user_id", "ts", "event_id")
    scans.run_stream(scans.cooldown_stream(source, "user_id", "ts", COOLDOWN, "event_id"), f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").select("user_id", "event_id")


def _stream(t: Tables, *columns: str, slices: int = 3, files: int = 4) -> tuple[DataFrame, str]:
    """A stream of the events, a slice of time for each batch, and its folder; slices are written one after the other."""
    place = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    rows = t.events.select(*columns)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    ends = [first + (last - first) * (k + 1) / slices for k in range(slices - 1)] if first else []
    number = sum((F.when(F.col("ts") > F.lit(e).cast(rows.schema["ts"].dataType), 1).otherwise(0) for e in ends), F.lit(0))
    for k in range(len(ends) + 1):
        rows.filter(number == k).repartition(files).write.mode("append").parquet(f"{place}/in")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in"), place


@query("SELECT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL GROUP BY ALL")
def unique_box_streamed(t: Tables) -> DataFrame:
    """M9: boxes by user and label, each emitted once, in the batch that has it first; state lasts as long as the events do."""
    source, place = _stream(t, "user_id", "ts", "props")
    boxes = scans.unique_boxes_stream(source.withColumn("k", F.get_json_object("props", "$.k")).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "k"], "ts", "3650 days")
    scans.run_stream(boxes, f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").select("user_id", "k")


@query("""WITH l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), e AS (SELECT * FROM l WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) > 21600::BIGINT * 1000000),
w AS (SELECT max(ts) AS newest FROM events) SELECT user_id, ts FROM e, w WHERE epoch_us(ts) + 21600::BIGINT * 1000000 < epoch_us(newest) - 3600::BIGINT * 1000000""")
def debounce_streamed(t: Tables) -> DataFrame:
    """ST9 with session windows: the end of every burst of six hours that the watermark has passed."""
    source, place = _stream(t, "user_id", "ts", "event_type")
    bursts = scans.debounce_stream(source.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_type", "6 hours", "1 hour")
    scans.run_stream(bursts, f"{place}/out", f"{place}/state")
    return t.spark.read.parquet(f"{place}/out").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {COOLED}, s AS (SELECT f.event_id, f.user_id, f.accepted, e.event_type, e.value, row_number() OVER (PARTITION BY f.user_id, json_extract_string(e.props, '$.k') ORDER BY e.ts, f.event_id) > 1 AS dup FROM f JOIN events e USING (event_id))
SELECT event_id, CASE WHEN event_type = 'error' THEN 'warning' WHEN NOT accepted THEN 'ignored' WHEN value < 2 THEN 'not_found' WHEN dup THEN CASE WHEN event_type = 'purchase' THEN 'duplicate' ELSE 'ignored' END WHEN event_type = 'purchase' THEN 'added' ELSE 'success' END AS decision FROM s""")
def scan_decisions(t: Tables) -> DataFrame:
    rows = t.events.withColumn("box", F.get_json_object("props", "$.k"))
    cooled = scans.cooldown(rows, "user_id", "ts", COOLDOWN, "event_id")
    marked = stock.mark_duplicates(cooled, ["user_id", "box"], ["ts", "event_id"])
    decision = scans.decide(F.col("event_type") != "error", F.col("value") >= 2, F.col("accepted"), F.col("outcome") == "duplicate", F.col("event_type") == "purchase")
    return marked.select("event_id", decision.alias("decision"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR epoch_us(next) - epoch_us(ts) >= 3600::BIGINT * 1000000""")
def debounce_sessions(t: Tables) -> DataFrame:
    return scans.debounce(t.events, "user_id", "ts", "event_type", 3_600_000, "event_id").select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS m FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS place, max(m[1]) OVER (PARTITION BY user_id) AS newest FROM l)
SELECT user_id, event_type, m[2] AS event_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3 AND epoch_us(newest) - epoch_us(m[1]) <= 86400::BIGINT * 1000000""")
def recent_list(t: Tables) -> DataFrame:
    return scans.recent(t.events, "user_id", "event_type", "ts", "event_id", 3, 86_400).select("user_id", "event_type", "event_id", "place")


@query("SELECT user_id, count(json_extract_string(props, '$.k')) <> count(DISTINCT json_extract_string(props, '$.k')) AS repeats FROM events GROUP BY 1")
def repeat_detector(t: Tables) -> DataFrame:
    return t.events.withColumn("k", F.get_json_object("props", "$.k")).groupBy("user_id").agg(scans.has_repeats("k").alias("repeats"))


@query("""SELECT key, value FROM (SELECT 'u' || user_id || '.' || event_type AS key, arg_max((CASE WHEN value > 80 THEN NULL ELSE json_extract_string(props, '$.k') END,), (ts, event_id))[1] AS value FROM events GROUP BY 1) WHERE value IS NOT NULL""")
def settings_kv(t: Tables) -> DataFrame:
    log = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("."), "event_type").alias("key"), F.when(~(F.col("value") > 80), F.get_json_object("props", "$.k")).alias("value"), "ts", "event_id")
    return stock.settings(log, "key", "value", ["ts", "event_id"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN epoch_us(ts) + 7 * 86400::BIGINT * 1000000 <= epoch_us(TIMESTAMP '2024-01-20') ELSE epoch_us(ts) + 86400::BIGINT * 1000000 <= epoch_us(TIMESTAMP '2024-01-20') END AS due FROM events""")
def sync_due(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    last, days = F.when(kind != 1, F.col("ts")), F.when(kind == 0, 0).when(kind == 3, 1).otherwise(7)
    return t.events.select("event_id", F.coalesce(codes.due(last, days, F.expr("timestamp_ntz'2024-01-20'")), F.lit(False)).alias("due"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, lower(p_name), p_partkey) AS rank FROM part""")
def natural_order(t: Tables) -> DataFrame:
    rows = t.part.withColumn("title", F.concat(F.lit("Part "), F.col("p_size").cast("string"), F.lit(" "), "p_name"))
    return catalogue.ranked(rows, [text.natural_key("title"), "p_partkey"], within=["p_brand"]).select("p_partkey", "rank")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Anti-infectieux' WHEN 1 THEN 'Divers' END AS atc, '"' || p_name || '"' AS phrase, 'CIP ' || p_partkey AS code_line, p_name || ' • ' || p_partkey AS subtitle,
CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'MOL' END AS title FROM part""")
def display_labels(t: Tables) -> DataFrame:
    code = F.element_at(F.array(F.lit("J01"), F.lit(" v03"), F.lit("X")), (F.col("p_partkey") % 3 + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    title = labels.display_title(F.col("p_partkey") % 2 == 0, F.lit("g"), F.concat(F.lit("mol - "), "p_name"), F.lit("MOL - brand"))
    return t.part.select("p_partkey", labels.atc_label(code).alias("atc"), labels.quoted_phrase(F.concat("p_name", F.lit(" "))).alias("phrase"), labels.code_line(key).alias("code_line"), labels.subtitle("p_name", F.lit(" "), key).alias("subtitle"), title.alias("title"))


CARDS = """cards AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, p_size % 2 = 0 AS princeps, CASE WHEN p_size % 3 > 0 THEN p_brand END AS group_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Brand' ELSE p_brand END AS brand,
CASE p_partkey % 5 WHEN 0 THEN 'Inconnu' WHEN 1 THEN '' ELSE p_brand || ' fort' END AS reference FROM part), known AS (SELECT *, NOT princeps AND group_id IS NOT NULL AND reference NOT IN ('', 'Inconnu') AS generic FROM cards)"""


@query(f"""WITH {CARDS} SELECT p_partkey, CASE WHEN princeps OR generic THEN CASE WHEN brand <> '' THEN brand ELSE reference END WHEN group_id IS NOT NULL THEN p_name ELSE p_name || ' - ' || p_type END AS hero,
CASE WHEN NOT princeps THEN p_name WHEN brand NOT IN ('', 'Brand') THEN brand ELSE reference END AS shown, concat_ws('|', CASE WHEN generic THEN p_name || ' - ' || p_type END, CASE WHEN p_size % 4 > 0 THEN p_type || ' • ' || p_size ELSE p_type END) AS lines,
CASE WHEN p_size % 4 > 0 THEN p_brand || ' • CIP ' || p_partkey ELSE 'CIP ' || p_partkey END AS code_line FROM known""")
def card_labels(t: Tables) -> DataFrame:
    """Hero label, display name, subtitle lines and code line of references, generics and products of no group."""
    group, size = F.when(F.col("p_size") % 3 > 0, F.col("p_brand")), F.col("p_size").cast("string")
    brand = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "Brand").otherwise(F.col("p_brand"))
    reference = F.when(F.col("p_partkey") % 5 == 0, "Inconnu").when(F.col("p_partkey") % 5 == 1, "").otherwise(F.concat("p_brand", F.lit(" fort")))
    rows = t.part.select("p_partkey", "p_type", "p_brand", (F.col("p_size") % 2 == 0).alias("princeps"), group.alias("group_id"), brand.alias("brand"), reference.alias("reference"), F.concat_ws(" - ", "p_name", "p_type").alias("canonical"), F.when(F.col("p_size") % 4 > 0, size).alias("dosage"))
    holder = F.when(F.col("dosage").isNotNull(), F.concat(F.lit(" "), "p_brand"))
    lines = labels.subtitle_lines("princeps", "group_id", "reference", "canonical", F.concat("p_type", F.lit(" ")), "dosage")
    return rows.select("p_partkey", labels.hero_label("princeps", "group_id", "brand", "reference", "canonical").alias("hero"), labels.display_name("princeps", "brand", "reference", "canonical").alias("shown"), F.array_join(lines, "|").alias("lines"), labels.code_line(F.col("p_partkey").cast("string"), holder).alias("code_line"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def scan_seconds(t: Tables) -> DataFrame:
    """D6f: moments as texts, some of them unreadable, cut to the second."""
    written = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("soon")
    return t.events.select("event_id", codes.second(written).alias("at"))


@query("""SELECT p_partkey, p_partkey % 4 IN (1, 3) AS suspect FROM part""")
def suspect_names(t: Tables) -> DataFrame:
    """T5: names with a comma or bracket that cleaning left whole, empty ones, well-cleaned ones and plain ones."""
    kind = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(kind == 1, " (fort)").when(kind == 2, ", gel").otherwise(""))
    clean = F.when(kind == 3, "").otherwise(text.normalise_product(F.when(kind == 2, F.col("p_name")).otherwise(F.col("name"))))
    rows = t.part.select("p_partkey", "p_name", name.alias("name")).withColumn("clean_name", clean)
    return rows.select("p_partkey", tsv.cleaning_is_suspect("name", "clean_name").alias("suspect"))


@query("""SELECT p_partkey, upper(p_name || ' A ' || p_size) AS vector, upper(p_name) || ' A POUR' AS keywords, p_name AS prefix FROM part""")
def search_vectors(t: Tables) -> DataFrame:
    names = F.array(F.concat("name", F.lit(" one")), F.concat("name", F.lit(" two")))
    results = {"keywords": text.keyword_vector("name", F.lit("a pour"), F.array(F.lit("a pour")), F.lit(""), F.array(F.lit("base"))), "prefix": text.common_word_prefix(names)}
    found = distinct.once_each(t.part.select("p_partkey", "p_name", "p_size"), {"name": F.col("p_name")}, results)
    return found.select("p_partkey", text.search_vector("p_name", F.lit("a"), F.col("p_size").cast("string")).alias("vector"), *results)
