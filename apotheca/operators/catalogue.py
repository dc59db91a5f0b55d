"""Catalogue queries: lookups, composition search, explorer lists, scan cache, history, and orderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.operators.skew import with_group
from apotheca.sources.store import materialised


def explorer_list(clusters: DataFrame, products: DataFrame) -> DataFrame:
    """Per cluster: flag of any member, number of members, smallest member.

    Members are summed up, on the map side first, before the clusters are joined.
    """
    sums = products.groupBy("cluster_id").agg(F.max("flag").alias("any_flag"), F.count("cis").alias("variant_count"), F.min("cis").alias("representative_cis"))
    return clusters.join(sums, "cluster_id").select("cluster_id", "title", "any_flag", "variant_count", "representative_cis")


def scan_cache(packages: DataFrame, summaries: DataFrame, labs: DataFrame) -> DataFrame:
    """Packages with their product and laboratory; only products that exist, laboratories if known."""
    joined = packages.join(summaries, "cis").join(labs, "lab_id", "left")
    return joined.withColumn("lab_name", F.coalesce("lab_name", F.lit("unknown")))


def lookup(requests: DataFrame, packages: DataFrame, code: str = "code") -> DataFrame:
    """Requests with the package of their full code, else the first package of their short code."""
    full = packages.select(F.col("cip13").alias(code), F.col("cis").alias("cis_full"))
    short = packages.groupBy("cip7").agg(F.min_by("cis", "cip13").alias("cis_short"))
    out = requests.join(full, code, "left").join(short, requests["short_code"] == short["cip7"], "left").drop("cip7")
    return out.withColumn("cis", F.coalesce("cis_full", "cis_short")).withColumn("matched_by", F.when(F.col("cis_full").isNotNull(), "full").when(F.col("cis_short").isNotNull(), "short"))


def same_composition(groups: DataFrame) -> DataFrame:
    """A row per composition that several groups have: how many, the first and the last of them.

    Who has which composition is ``composition_sizes``; the two say what all pairs would, without making them.
    """
    known = groups.filter(F.coalesce("composition", F.lit("")) != "").select("group_id", "composition").distinct()
    return known.groupBy("composition").agg(F.count("*").alias("groups"), F.min("group_id").alias("first_group"), F.max("group_id").alias("last_group")).filter("groups > 1")


def composition_sizes(groups: DataFrame) -> DataFrame:
    """Each group with its composition, how many others have it and the first that has."""
    known = materialised(groups.filter(F.coalesce("composition", F.lit("")) != "").select("group_id", "composition").distinct(), "compositions")
    sizes = materialised(known.groupBy("composition").agg(F.count("*").alias("n"), F.min("group_id").alias("first_group")), "composition_sizes")
    return with_group(known, sizes, ["composition"], "n").select("group_id", "composition", (F.col("n") - 1).alias("others"), "first_group")


def supersets(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """target_id and candidate_id where the candidate's set holds the target's and more.

    Relational division over distinct sets: equal sets are one row, so a common element is met once per set and not
    once per row that holds it. Owners are joined back to the sets that fit. Columns: id, elements (array of texts).
    """
    sets = lambda rows, name: rows.select(F.col("id").alias(f"{name}_id"), F.array_sort(F.array_distinct("elements")).alias(name))
    t, c = sets(targets, "target"), sets(candidates, "candidate")
    asked, held = t.select("target").distinct(), c.select("candidate").distinct()
    left = asked.select("target", F.explode("target").alias("element"))
    right = held.select("candidate", F.explode("candidate").alias("element"))
    larger = F.size("candidate") > F.size("target")
    fitting = left.join(right, "element").filter(larger).groupBy("target", "candidate").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("target"))
    found = fitting.select("target", "candidate").join(t, "target").join(c, "candidate")
    return found.filter("target_id <> candidate_id").select("target_id", "candidate_id", F.size("candidate").alias("candidate_size"))


def group_details(members: DataFrame, products: DataFrame, packages: DataFrame) -> DataFrame:
    """Members with their group's reference product, chosen once per group instead of by a subquery per row."""
    reference = members.filter("type = '0'").groupBy("group_id").agg(F.min("cis").alias("reference_cis"))
    named = products.select(F.col("cis").alias("reference_cis"), F.col("name").alias("reference_name"))
    out = members.join(reference, "group_id", "left").join(named, "reference_cis", "left").join(products, "cis", "left").join(packages, "cis", "left")
    return out.withColumn("shown_name", F.coalesce("name", "reference_name", F.lit("")))


def history(scans: DataFrame, names: DataFrame, places: DataFrame, n: int = 100) -> DataFrame:
    """The last n scans with what is known of them, newest first (J4, P12, O5); n is held to 1 ... 500.

    The scans are cut to n before they meet the other tables.
    """
    last = scans.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(500, n)))
    return last.join(names, "user_id", "left").join(places, "place_id", "left").withColumn("label", F.coalesce("name", F.concat(F.lit("user "), F.col("user_id").cast("string"))))


def first_of(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row per key instead of a lookup per row."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def inspect(ids: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Asked ids with their cluster and number of members, "not found" for the others."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("members"))
    out = ids.join(clusters, "cluster_id", "left").join(sizes, "cluster_id", "left")
    return out.withColumn("state", F.when(F.col("title").isNull(), "not found").otherwise("found")).withColumn("members", F.coalesce("members", F.lit(0)))


def distinct_parts(rows: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """The distinct parts of a delimited column that aren't blank (D13f, A35)."""
    return rows.select(F.explode(F.split(column, separator)).alias("part")).select(text.nonblank("part").alias("part")).filter("part is not null").distinct()


# Orders, as ranks, so that they survive any later shuffle


def ranked(rows: DataFrame, order: list[Column | str], rank: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Rows with their place in an order, per group if asked for.

    No task sees a whole group: rows are sorted by ranges of (group, order) and numbered throughout, and
    a group's places begin at the least number it has.
    """
    if not within:
        return _numbered(rows, order, rank)
    numbered = _numbered(rows, [*within, *order], rank)
    firsts = materialised(numbered.groupBy(*within).agg(F.min(rank).alias("__first"), F.count("*").alias("__members")), "firsts")
    placed = with_group(numbered, firsts, within, "__members")
    return placed.withColumn(rank, F.col(rank) - F.col("__first") + 1).select(*rows.columns, rank)


def _numbered(rows: DataFrame, order: list[Column | str], rank: str) -> DataFrame:
    """A global rank: the place in a part of a range sort, which the id of the row holds, after the rows of earlier parts.

    The sorted parts are written once, for a range sort that runs twice may cut its parts at other places.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = materialised(parts, "ranked").withColumn("__part", F.shiftright("__at", 33))
    sizes = written.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return written.join(F.broadcast(before), "__part").select(*rows.columns, place.alias(rank))


def dimension(rows: DataFrame, column: str, name: str, key: str, unknown: str = "unknown") -> DataFrame:
    """Distinct values with dense ids from 1 in order, and id 0 for unknown."""
    known = ranked(rows.select(text.nonblank(column).alias(name)).filter(F.col(name).isNotNull()).distinct(), [name], key)
    return known.unionByName(rows.sparkSession.range(1).select(F.lit(unknown).alias(name), F.lit(0).cast("long").alias(key)))


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """LIMIT and OFFSET after a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in random order that a seed repeats (O7); tasks pass on no more than n rows each."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def nocase(column: str) -> Column:
    """Order without ASCII case (O3)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_index(rows: DataFrame, column: str, letters: str = "ABCDEFGHJKLMNPRSTUVWXYZ") -> DataFrame:
    """letter and the 0-based rank of its first row, # for digits, for allowed letters only."""
    letter = F.upper(F.col(column).substr(1, 1))
    tag = F.when(F.regexp_like(letter, F.lit("[0-9]")), "#").when(F.length(letter) == 1, letter)
    return ranked(rows, [column, "id"]).select(tag.alias("letter"), (F.col("rank") - 1).alias("at")).filter(F.col("letter").isin("#", *letters)).groupBy("letter").agg(F.min("at").alias("first_at"))


def letter_successor(index: DataFrame, letters: DataFrame) -> DataFrame:
    """For each letter asked for, itself if it is in the index, else the next greater one there is.

    The index holds a row per letter, so it is small by nature.
    """
    return letters.join(F.broadcast(index.withColumnRenamed("letter", "target")), F.expr("target >= letter"), "left").groupBy("letter").agg(F.min("target").alias("target"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Beginnings of serials, with their lengths, that are broadcast.
BEGINNINGS = 10_000


def contained_duplicates(scans: DataFrame, boxes: DataFrame, key: str, serial: str, label: str) -> DataFrame:
    """Scans whose serial is part of a known label of the same key (J16): the looser of the two duplicate tests.

    A label's substrings meet serials by equality, so a key with very many labels is no group that has to meet. Only substrings that
    begin as serials do, and go on as long as serials that begin so, are made: the beginnings, as long as the shortest serial, are
    broadcast where they are at most ``BEGINNINGS``, and are joined by key otherwise. An empty serial is part of any label.
    """
    least = scans.filter(F.length(serial) > 0).agg(F.min(F.length(serial))).first()[0]
    empty = scans.filter(F.length(serial) == 0).join(boxes.filter(F.col(label).isNotNull()).select(key).distinct(), key, "left_semi").select(*scans.columns)
    if least is None:
        return empty
    begin = F.substring(serial, 1, least).alias("__begin")
    begun = scans.filter(F.length(serial) > 0).select(key, begin, F.length(serial).alias("__size"))
    known = begun.select("__begin", "__size").distinct()
    few = known.limit(BEGINNINGS + 1).count() <= BEGINNINGS
    sizes = F.broadcast(known.groupBy("__begin").agg(F.collect_set("__size").alias("__sizes"))) if few else begun.groupBy(key, "__begin").agg(F.collect_set("__size").alias("__sizes"))
    # A label shorter than the shortest serial has no places.
    places = F.when(F.length(label) >= least, F.sequence(F.lit(1), F.length(label) - least + 1)).otherwise(F.array().cast("array<int>"))
    starts = boxes.select(key, label, F.explode(places).alias("__from")).withColumn("__begin", F.col(label).substr(F.col("__from"), F.lit(least)))
    parts = starts.join(sizes, "__begin" if few else [key, "__begin"]).select(key, label, "__from", F.explode("__sizes").alias("__size"))
    parts = parts.filter(F.col("__from") + F.col("__size") - 1 <= F.length(label)).select(key, F.col(label).substr(F.col("__from"), F.col("__size")).alias(serial)).distinct()
    return scans.join(parts, [key, serial], "left_semi").select(*scans.columns).unionByName(empty)


def audit_view(clusters: DataFrame) -> DataFrame:
    """Clusters under the names of the audit export."""
    return clusters.select(F.col("cluster_id").alias("id"), F.col("title").alias("cluster_name"), F.col("subtitle").alias("cluster_princeps"), F.col("count_products").alias("products"))


def extract_fixture(codes: DataFrame, packages: DataFrame, products: DataFrame, composition: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of three tables that belong to some package codes."""
    chosen = packages.join(codes, "cip13", "left_semi")
    ids = chosen.select("cis").distinct()
    return chosen, products.join(ids, "cis", "left_semi"), composition.join(ids, "cis", "left_semi")


def expand_packages(members: DataFrame, packages: DataFrame) -> DataFrame:
    """A row per membership and package of its product, under the full code or else the short one."""
    coded = packages.select("cis", F.coalesce(F.nullif("cip13", F.lit("")), F.col("cip7")).alias("cip_code")).distinct()
    return members.join(coded, "cis")


def head_per_group(rows: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group (O12); the cut runs before the shuffle too."""
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n)


def like_nocase(column: str, pattern: str) -> Column:
    """LIKE without ASCII case."""
    return nocase(column).like(pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def hospital_only(agreement: Column, refund: Column, price: Column) -> Column:
    """Agreed for hospitals, and neither refunded nor priced; null counts as unknown, and unknown as no."""
    return F.coalesce((agreement == "oui") & (refund.isNull() | (refund == "")) & (price.isNull() | (price == 0)), F.lit(False))
