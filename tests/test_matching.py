"""Sub-clusters, aliases and conditions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from apotheca.functions import labels
from apotheca.operators import aliases, subclusters
from apotheca.sources import tsv


def plain_roots(pairs):
    to = {}
    for alias, target in pairs:
        if alias is not None and target is not None and alias != target:
            to[alias] = min(to.get(alias, target), target)
    roots = {}
    for alias in to:
        seen, at = [], alias
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        roots[alias] = at if at not in to else min(seen[seen.index(at) :])
    return roots


@pytest.mark.parametrize("seed", range(3))
def test_resolve(spark, seed):
    """Long chains, cycles that tails lead into, several targets, a target that a third of all aliases share."""
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(70)] + [(70, 64)] + [(200 + i, 30) for i in range(90)] + [(400, 401), (401, 400), (402, 401), (500, 500), (None, 1), (2, None), (600, 700)]
    pairs += [(1000 + i, 1000 + rng.randrange(60)) for i in range(80)] + [(1005, 1001), (1005, 1090)]
    found = aliases.resolve(spark.createDataFrame(pairs, "alias long, target long"))
    assert {r.alias: r.root for r in found.collect()} == plain_roots(pairs)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_resolve_of_ends_and_nothing(spark):
    assert aliases.resolve(spark.createDataFrame([], "alias string, target string")).collect() == []
    assert aliases.resolve(spark.createDataFrame([("a", "b")], "alias string, target string")).collect() == [("a", "b")]
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, root int")
    roots = aliases.resolve(spark.createDataFrame([("a", "b")], "alias string, target string"))
    assert sorted(aliases.canonical(rows.withColumnRenamed("root", "n"), roots, "c").collect(), key=str) == [("b", 1), ("b", 2), (None, 3)]


def test_compatibility(spark):
    rows = [
        ("orale", "intraveineuse", ["J01"], ["J01CA"], None, True), ("inhalation", "nasale", ["R03"], ["R03"], None, True), ("nasale", "inhalation", ["R03"], ["R03"], None, False),
        ("inhalation", "orale", ["R03"], ["R03"], None, False), ("rectale; inhalation", "cutanée;CUTANEE", ["D"], ["D01AB"], None, True), ("", "orale", [], ["J01"], None, True), (None, None, None, None, None, True),
        ("orale", "orale", ["A03"], ["S01"], None, False), ("orale", "orale", ["A03"], ["S01"], ["A03", "S01"], True), ("orale", "orale", ["A03", "N01"], ["S01"], ["A03", "S01"], False), ("orale", "orale", ["A03BA"], ["A03AX"], None, True),
        ("orale", "orale", ["", None], ["S01"], None, True),
    ]
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "i int, a string, b string, x array<string>, y array<string>, z array<string>")
    fits = aliases.routes_fit(aliases.route_groups(F.col("a")), aliases.route_groups(F.col("b"))) & aliases.atc_fits(F.col("x"), F.col("y"), F.col("z"))
    assert [r.ok for r in df.select("i", fits.alias("ok")).orderBy("i").collect()] == [r[-1] for r in rows]


def test_merges_stop_at_clusters_that_do_not_fit(spark):
    known = spark.createDataFrame([("a", ["SYSTEMIC"], ["J01"], None), ("b", ["SYSTEMIC"], ["J01CA"], None), ("c", ["EXTERNAL"], ["J01"], None), ("d", [], [], None)], "cluster_id string, routes array<string>, atc array<string>, bridges array<string>")
    renames = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "name")], "alias string, target string")
    found = aliases.resolve(aliases.allowed(renames, known))
    assert {tuple(r) for r in found.collect()} == {("a", "b"), ("c", "name"), ("d", "name")}


def test_dosage_spellings(spark):
    rows = ["500 mg", " 1,5  G", "0.5 mg/ml", "1 000 UI", "un sachet", "", None, "5%", "500"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "i int, d string")
    found = [set(r.s) for r in df.select("i", subclusters.dosage_spellings(F.col("d")).alias("s")).orderBy("i").collect()]
    assert found[0] == {"500 mg", "500mg", "500,0 mg", "500,0mg", "500.0 mg", "500.0mg"} and found[1] == {"1,5 g", "1,5g", "1.5 g", "1.5g"}
    assert {"0,5 mg/ml", "0.5mg/ml"} <= found[2] and found[3] == {"1 000 ui"} and found[4] == {"un sachet"} and found[5] == found[6] == set() and "5 %" in found[7] and found[8] == {"500"}


def test_names_lose_the_longest_dosage_of_their_own_sub_cluster(spark):
    mask = spark.createDataFrame([("s", d) for d in ("50 mg", "500 mg", "1 g", "1 g/50 mg", "0 mg")] + [("t", "2 g")], "subcluster_id string, suffix string")
    cases = {
        ("s", "CLAMOXYL 500 mg"): "CLAMOXYL", ("s", "CLAMOXYL 150 mg"): "CLAMOXYL 150 mg", ("s", "X 0,50 mg"): "X 0,50 mg", ("s", "X 1 G/50 MG  "): "X", ("s", "X 2 g"): "X 2 g", ("t", "X 2 g"): "X",
        ("s", "500 mg"): "500 mg", ("s", " 1 g"): "1 g", ("s", ""): "", ("s", "A"): "A", ("s", "PRÉ-1 g"): "PRÉ-", ("none", "Y 1 g"): "Y 1 g",
    }
    names = spark.createDataFrame([*cases, *cases, ("s", None), (None, "Z 1 g")], "subcluster_id string, name string")
    found = subclusters.without_dosages(names, mask).collect()
    assert {(r.subcluster_id, r.name): r.clean for r in found} == cases and len(found) == len(cases)


def test_hot_suffix(spark):
    """One suffix of most names of one sub-cluster."""
    names = spark.range(5000).select(F.lit("s").alias("subcluster_id"), F.concat(F.lit("N"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, " 2 g").otherwise(" 1 g")).alias("name"))
    mask = spark.createDataFrame([("s", "1 g"), ("s", "g")], "subcluster_id string, suffix string")
    found = subclusters.without_dosages(names, mask)
    assert found.filter("clean = split(name, ' ')[0]").count() == 4000 and found.filter("clean rlike ' 2$'").count() == 1000


def test_sub_clusters_of_other_brands_stay_apart(spark):
    products = spark.createDataFrame([("1", "Gélule LP", "OMIX LP 1 mg"), ("2", " gélule lp", "OMIX LP 2 mg"), ("3", "comprimé", "MECIR 1 mg"), ("4", "sirop", "omix LP"), ("5", None, "NO PROFILE")], "cis string, shape string, name string")
    profiles = spark.createDataFrame([("1", "T"), ("2", "T"), ("3", "T"), ("4", "T"), ("5", None)], "cis string, chemical_id string")
    placed = subclusters.by_form(products, profiles)
    mask = subclusters.dosage_mask(placed, spark.createDataFrame([("1", "1 mg"), ("2", "2 mg"), ("3", "1 mg"), ("4", None)], "cis string, dosage string"))
    chosen = subclusters.representatives(placed.withColumn("pos", F.col("cis").cast("long")), subclusters.without_dosages(placed, mask))
    found = subclusters.merged(chosen).collect()
    assert sorted((r.brand, r.votes, r.merged_forms) for r in found) == [("MECIR", 1, 1), ("OMIX LP", 2, 2), ("omix LP", 1, 2)]
    assert len({r.cluster_id for r in found}) == 2


def test_conditions_and_availability(spark):
    lines = ["10000001\tListe I", "10000001\tliste ii, STUPÉFIANT", "x\tListe I", "10000002", "10000003\t"]
    found = tsv.conditions(spark.createDataFrame(list(enumerate(lines)), "pos long, value string"))
    flags = found.rows.select("pos", labels.prescription_flags("condition").alias("f")).orderBy("pos").collect()
    assert [r.f for r in flags] == [["LIST_1"], ["LIST_2", "NARCOTIC"], []] and [r.pos for r in found.rejects.collect()] == [2]
    lines = ["10000001\t\t1\tx\t01/01/2024", "\t3400912345678\t 4 \tx", "\t\t2\tx", "10000001\t\t9\town words\t\t", "10000001\t\t1"]
    found = tsv.availability(spark.createDataFrame(list(enumerate(lines)), "pos long, value string"))
    assert [(r.pos, r.state) for r in found.rows.orderBy("pos").collect()] == [(0, "Rupture de stock"), (1, "Remise à disposition"), (3, "own words")]
    assert [r.pos for r in found.rejects.collect()] == [2]
