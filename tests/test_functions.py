"""Golden values of the scalar functions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from apotheca.operators import clusters
from apotheca.functions import codes, labels, text

SALTS = {
    "CHLORHYDRATE DE TRAMADOL": "TRAMADOL",
    "CHLORHYDRATE D'AMBROXOL": "AMBROXOL",
    "SULFATE DE ZINC": "SULFATE DE ZINC",
    "PHOSPHATE DE CODÉINE HÉMIHYDRATÉ": "CODEINE",
    "ACÉTATE D'ULIPRISTAL": "ULIPRISTAL",
    "PHOSPHATE MONOPOTASSIQUE": "PHOSPHATE MONOPOTASSIQUE",
    "FUMARATE DE FORMOTÉROL DIHYDRATÉ": "FORMOTEROL",
    "DICLOFÉNAC DE SODIUM": "DICLOFENAC",
    "ATORVASTATINE CALCIQUE": "ATORVASTATINE",
    "METFORMINE (CHLORHYDRATE DE)": "METFORMINE",
    "": "",
}


def one(spark, column, *values):
    names = [f"x{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*names).alias("v")).first()["v"]


@pytest.mark.parametrize("label", SALTS)
def test_substance(spark, label):
    assert one(spark, text.substance_name, label) == SALTS[label]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("01034009303026132132780924334799\x1d10MA00614A\x1d17270430", ("3400930302613", "3030261", "32780924334799", "MA00614A", datetime.date(2027, 4, 30))),
        ("INVALID_BARCODE_DATA", (None,) * 5),
        ("0103400930302613" + "10\x1d21ABC", ("3400930302613", "3030261", "ABC", None, None)),
        ("0103400930302613" + "17251300\u00a021S9", ("3400930302613", "3030261", "S9", None, None)),
        ("0103400930302613" + "17171225\u00a021S9\u202f10L 1", ("3400930302613", "3030261", "S9", "L", datetime.date(2017, 12, 25))),
        ("01340093", (None,) * 5),
    ],
)
def test_barcode(spark, raw, expected):
    found = one(spark, codes.parse_gs1, raw)
    assert (found.gtin, found.short_code, found.serial, found.lot, found.expires) == expected


@pytest.mark.parametrize(("x", "expected"), [("250200", "2025-02-28"), ("240200", "2024-02-29"), ("490115", "2049-01-15"), ("500115", "1950-01-15"), ("991399", None), ("250231", "2025-03-03")])
def test_barcode_date(spark, x, expected):
    found = one(spark, codes.gs1_date, x)
    assert (found and str(found)) == expected


@pytest.mark.parametrize(("x", "expected"), [("24,34", 24.34), ("", None), ("abc", None), (" 5.1x", 5.1), ("1,2,3", 1.2)])
def test_price(spark, x, expected):
    assert one(spark, codes.price, x) == expected


@pytest.mark.parametrize(
    ("name", "shape", "expected"),
    [("ALPHA 500 mg, comprimé", "comprimé", "ALPHA 500 MG"), ("ALPHA (SE) 500 mg comprimé", "comprimé", "ALPHA 500 MG"), ("BETA solution pour X.", "solution injectable", "BETA"), ("solution", "solution", ""), ("X", "", "X")],
)
def test_subtract_shape(spark, name, shape, expected):
    assert one(spark, text.subtract_shape, name, shape) == expected


@pytest.mark.parametrize(
    ("names", "expected"),
    [(["TIMOPTOL 0,25 %", "TIMOPTOL 0,50 %"], "TIMOPTOL"), (["A B C D", "X B C"], "B C"), (["ONE"], "ONE"), ([], ""), (["AB", "CD"], ""), (["Doliprane 500 mg", "DOLIPRANE 1 g enfant", "Doliprane"], "DOLIPRANE")],
)
def test_common_words(spark, names, expected):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(text.longest_common_words("n")).first()[0] == expected


@pytest.mark.parametrize(
    ("function", "x", "expected"),
    [
        (text.normalise_search, "Amoxicilline/Acide clavulanique", "amoxicilline acide clavulanique"),
        (text.normalise_search, "Cœur DOLIPRANE® ", "coeur doliprane"),
        (text.normalise_search, None, ""),
        (text.index_principle, "SODIUM (VALPROATE DE)", "VALPROATE"),
        (labels.grouping_key, "0,03 mg", ""),
        (labels.main_holder, "; LABO XYZ SAS / B", "LABO XYZ"),
        (labels.main_holder, None, "Laboratoire inconnu"),
        (labels.known, " N/A ", ""),
        (labels.galenic_class, "solution injectable", "INJECTABLE"),
        (labels.atc_label, "n02", "Système nerveux"),
        (codes.is_json, '{"a": 1}}', False),
        (codes.is_json, '{"a": 1}', True),
    ],
)
def test_scalars(spark, function, x, expected):
    assert one(spark, function, x) == expected


#: Golden values, each for a step of the chain or for the order of two.
PRINCIPLES = {
    "  acide Ursodésoxycholique ": "URSODEOXYCHOLIQUE",
    "(R) - Salbutamol": "SALBUTAMOL",
    "SODIUM (CHLORURE DE)": "CHLORURE",
    "CUIVRE (GLUCONATE DE)": "GLUCONATE",
    "MORPHINE (CHLORHYDRATE DE)": "MORPHINE",
    "Chlorure  de sodium": "CHLORURE DE SODIUM",
    "MAGNESIUM": "MAGNESIUM",
    "SOLUTION DE DIGLUCONATE": "DIGLUCONATE",
    "CONCENTRAT DE SOLUTION DE X": "X",
    "X CONCENTRAT DE Y": "X Y",
    "VITAMINE A, FORME PULVERULENTE": "VITAMINE A",
    "PARAFFINE LIQUIDE": "PARAFFINE",
    "DINOPROSTONE BETADEX-CLATHRATE": "DINOPROSTONE",
    "LATANOPROST PROPYLENE GLYCOLATE": "LATANOPROST",
    "NICOTINE (RESINATE)": "NICOTINE",
    "ACETATE D'HYDROCORTISONE": "HYDROCORTISONE",
    "CHLORHYDRATE DIHYDRATE DE X": "X",
    "CITRATE": "CITRATE",
    "MAGNESIUM DE PIDOLATE": "PIDOLATE",
    "PIDOLATE DE MAGNESIUM": "PIDOLATE",
    "PERINDOPRIL TERT-BUTYLAMINE": "PERINDOPRIL",
    "X MALEATE DIHYDRATE": "X",
    "X DIHYDRATE MALEATE": "X DIHYDRATE",
    "ESOMEPRAZOLE MAGNESIQUE DIHYDRATE": "ESOMEPRAZOLE",
    "X MONOSODIQUE ANHYDRE": "X",
    "HUILE RICHE EN OMEGA 3 ET AUTRES": "OMEGA-3",
    "CALCITONINE SYNTHETIQUE DE SAUMON": "CALCITONINE",
    "CARBOCYSTEINE": "CARBOCISTEINE",
    "SEVORANE": "SEVOFLURANE",
    "COLECALCIFEROL": "CHOLECALCIFEROL",
    "CONCENTRAT DE COLECALCIFEROL": "CHOLECALCIFEROL",
    "CLAVULANATE DE POTASSIUM DILUE": "CLAVULANIQUE",
    "AMOXICILLINE CLAVULANATE": "AMOXICILLINE CLAVULANIQUE",
    "CYAMEPROMAZINE": "CYAMEMAZINE",
    "REMIFENTANYL": "REMIFENTANIL",
    "ACIDE VALPROIQUE": "VALPROATE",
    "TRYPTOPHANE L": "TRYPTOPHANE",
    "ALCOOL DICHLORO-2,4 BENZYLIQUE": "ALCOOL DICHLOROBENZYLIQUE",
    "PHOSPHATE MONOSODIQUE": "PHOSPHATE MONOSODIQUE",
    "X, , ": "X",
    "": "",
}


def test_index_principles(spark):
    df = spark.createDataFrame(list(PRINCIPLES.items()), "x string, expected string")
    assert {r.x: r.got for r in df.select("x", text.index_principle("x").alias("got")).collect()} == PRINCIPLES
    assert one(spark, text.common_principles, "Morphine (chlorhydrate de)+ ACIDE VALPROIQUE+morphine") == "MORPHINE VALPROATE"


def test_natural_order(spark):
    names = ["a10", "a9", "B1", "a9 x"]
    df = spark.createDataFrame([(n,) for n in names], "x string").orderBy(text.natural_key("x"))
    assert [r.x for r in df.collect()] == ["a9", "a9 x", "a10", "B1"]


def test_settings_decode(spark):
    row = spark.createDataFrame([("12", "true", "x")], "a string, b string, c string").select(
        codes.setting(F.encode("a", "UTF-8"), "int").alias("a"), codes.setting(F.encode("b", "UTF-8"), "boolean").alias("b"), codes.setting(F.encode("c", "UTF-8"), "double").alias("c")
    )
    assert tuple(row.first()) == (12, True, None)


def common_words(names):
    """The longest run of the shortest name's words that all names hold, longest first, then leftmost."""
    split = [n.upper().split() for n in names]
    shortest = min(split, key=len)
    for size in range(len(shortest), 0, -1):
        for start in range(len(shortest) - size + 1):
            run = shortest[start : start + size]
            if all(any(words[i : i + size] == run for i in range(len(words))) for words in split):
                return " ".join(run)
    return ""


def test_lcs_naming_by_brute_force(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    groups = {}
    for r in spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").collect():
        groups.setdefault((r.p_brand, r.p_size), []).append(r.p_name)
    found = {(r.chemical_id, r.p_size): (r.display_name, r.naming_method) for r in contract.queries()["lcs_naming"](spark, folder).collect()}
    assert set(found) == set(groups)
    for key, names in groups.items():
        common = common_words(names)
        if len(names) == 1:
            expected = (names[0].upper(), "SINGLE_SOURCE")
        elif len(common) >= 3:
            expected = (common, "LCS_CONSENSUS")
        else:
            expected = (names[0].upper().split()[0], "BRAND_EXTRACTION_FALLBACK")
        assert found[key] == expected, names


def names_of(spark, names):
    return spark.createDataFrame([(names,)], "n array<string>")


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["Doliprane 500", "DOLIPRANE 1000"], "Doliprane"), (["CO-APROVEL", "COAPROVEL"], "CO-APROVEL"), (["a  b"], "a  b"), ([], ""), (["CLAMOXYL 1 g", "clamoxyl 1 g poudre"], "CLAMOXYL 1 g"),
        (["CO-APROVEL 150", "COAPROVEL 300"], "COAPROVEL"), (["AB 1", "AC 2"], ""), (["", "x"], ""), (["ab cd", "AB ce"], "ABC"), (["xy z", "XY Z"], "xy z"),
    ],
)
def test_common_word_prefix(spark, names, expected):
    assert names_of(spark, names).select(text.common_word_prefix("n")).first()[0] == expected


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        (("paracetamol comprime 500 mg base", None, None, None, None), "PARACETAMOL 500"), (("Paracétamol", "DOLIPRANE", ["EFFERALGAN", "DOLIPRANE"], "PARACETAMOL 500 mg + CODEINE, ", ["Doliprane 1000 mg", " "]), "PARACETAMOL DOLIPRANE EFFERALGAN PARACETAMOL CODEINE DOLIPRANE 1000"),
        (("A", "POUR", [], "", None), "A POUR"), (("DOSES", "DOSE", None, None, None), "DOSES"), (("x-ml", None, None, "a 1,b", None), "X A B"),
    ],
)
def test_keyword_vector(spark, parts, expected):
    df = spark.createDataFrame([parts], "a string, b string, c array<string>, d string, e array<string>")
    assert df.select(text.keyword_vector("a", "b", "c", "d", "e")).first()[0] == expected


def test_common_runs_of_a_hot_group(spark):
    """A third of all names are of one group; runs and counts are as those of the names put together."""
    rng = random.Random(3)
    words = ["DOLI", "12,5", "12.5", "mg", "DES", "É-X", "a.b", "(x)"]
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(60)}", " ".join(["Base", *(rng.choice(words) for _ in range(rng.randrange(4)))]), i) for i in range(900)] + [("one", "Un nom ", 1000), ("none", None, 1001), ("none", "", 1002), (None, "x", 1003), ("none", " - ", 1004)]
    found = {r.grp: (r.names, r.first_name, r.common) for r in clusters.common_runs(spark.createDataFrame(rows, "grp string, name string, pos long"), ["grp"]).collect()}
    for grp in {r[0] for r in rows if r[0] is not None}:
        names = [n for g, n, _ in rows if g == grp and n is not None]
        want = names_of(spark, names).select(text.longest_common_words("n")).first()[0] if grp in ("hot", "one", "none", "g1", "g2") else found[grp][2]
        assert found[grp] == (len(names), names[0], want)
    assert found["hot"][2] == "BASE"


@pytest.mark.parametrize(
    ("card", "hero", "shown", "lines"),
    [
        ((True, "g", "BRAND", "Alpha 500", "MOL - Alpha", "gel", None), "BRAND", "Alpha 500", ["gel"]), ((True, None, "", " Alpha ", "MOL", None, " "), " Alpha ", "Alpha", []),
        ((False, "g", "", "Alpha 500", " MOL - Alpha ", "gel", "1 g"), "Alpha 500", "MOL", ["MOL - Alpha", "gel • 1 g"]), ((False, "g", "B", "Inconnu", "MOL - Alpha", "", "1 g"), "MOL", "MOL", ["1 g"]),
        ((False, None, "B", "Alpha", "MOL - Alpha", "gel", ""), "MOL - Alpha", "MOL", ["gel"]), ((False, "g", None, None, "MOL", None, None), "MOL", "MOL", []),
    ],
)
def test_cards(spark, card, hero, shown, lines):
    df = spark.createDataFrame([card], "p boolean, g string, b string, r string, c string, f string, d string")
    assert df.select(labels.hero_label("p", "g", "b", "r", "c"), labels.display_name("p", "b", "r", "c"), labels.subtitle_lines("p", "g", "r", "c", "f", "d")).first()[:] == (hero, shown, lines)


@pytest.mark.parametrize(
    ("name", "shape", "subtracted", "brand"),
    [
        ("Alpha 1.5 mg gel, gel", "gel", ("ALPHA 1.5 MG GEL", 0.7), ("Alpha", 0.9)), ("Beta-X 5 mg; sirop", "gel", ("BETA-X 5 MG; SIROP", 0.4), ("Beta-X 5 mg; sirop", 0.6)),
        ("GAMMA 2 B 10 %, x", None, ("GAMMA 2 B 10 %, X", 0.4), ("GAMMA 2 B", 0.9)), (None, "gel", ("", 0.4), ("", 0.6)), ("gel", "gel", ("", 0.7), ("gel", 0.6)),
    ],
)
def test_first_strategies(spark, name, shape, subtracted, brand):
    from apotheca.operators import strategies

    products = spark.createDataFrame([("1", name, shape)], "cis string, name string, shape string")
    composition = spark.createDataFrame([], "cis string, nature string, substance string, reference string, pos int")
    members, references = spark.createDataFrame([], "cis string, group_id string, pos int"), spark.createDataFrame([], "group_id string, reference_cis string, reference_name string")
    row = strategies.score(products, composition, members, references).first()
    assert (row.form_subtraction.brand, row.form_subtraction.confidence) == subtracted and (row.brand_extraction.brand, row.brand_extraction.confidence) == brand
    assert (row.composition_lookup.generic, row.composition_lookup.confidence) == (brand[0], 0.5)


def test_seconds(spark):
    assert one(spark, codes.second, "2024-02-29T23:59:59.999") == "2024-02-29 23:59:59" and one(spark, codes.second, "2024-02-30") is None


def test_two_lists_of_a_hot_group(spark):
    from apotheca.operators import groupview

    rows = [("hot" if i % 3 else f"g{i % 5}", None if i % 10 == 9 else i % 2 == 0, str(i), i // 2) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, flag boolean, value string, at int")
    found = sorted((r.g, r.list, r.place, r.value) for r in groupview.two_lists(df, "g", "flag", "value", "at").collect())
    want = []
    for g in {r[0] for r in rows}:
        for name, of in (("flagged", True), ("others", False)):
            ordered = sorted((at, value) for key, flag, value, at in rows if key == g and bool(flag) == of)
            want += [(g, name, i + 1, value) for i, (_, value) in enumerate(ordered)]
    assert found == sorted(want)
