"""Strategies that split product names into brand, generic and form, to be compared by their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions.text import ColumnOrName, as_column, trim

_BRAND = r"(?i)^([A-Z][A-Z0-9\s/\-]+?)"
_STRONG = r"(?i)^([A-Z][A-Z0-9\s]+?)\s+\d+(?:\.\d+)?\s*(?:mg|g|ml|UI|%)"
_DOSE = r"\s+\d+(?:\.\d+)?\s*(?:mg|g|ml|UI|%"

#: Salts that the simple rule takes off, and small words and forms of reference dosages.
SIMPLE_SALTS = r"^(?:CHLORHYDRATE DE |HEMIFUMARATE DE |SESQUIHYDRATE DE |MONOHYDRATE DE |DIHYDRATE DE |TRIHYDRATE DE )|(?: MONOHYDRATE| DIHYDRATE| TRIHYDRATE| HEMIFUMARATE| CHLORHYDRATE)$"
SMALL_WORDS = ("un", "une", "de", "le", "la", "les", "des", "d'", "du", "pour", "et", "ou", "en", "dans")
FORM_PHRASES = r"un comprim[eé]|une g[eé]nule|une? (?:flacon de )?(?:solution|suspension|pommade|cr[eè]me|collyre|linti[eè]re)|une? (?:tube de )?gel|une (?:flacon|ampoule|seringue) de .*? inj?e(?:c)?table"


def simple_substance(x: ColumnOrName) -> Column:
    """A substance without the commonest salts, in upper case."""
    bare = trim(F.regexp_replace(trim(F.upper(as_column(x))), SIMPLE_SALTS, ""))
    return trim(F.regexp_replace(bare, r"^(?:D'|DE )", ""))


def form_of_dosage(x: ColumnOrName) -> Column:
    """The form in a reference dosage such as "un comprimé": its first long word, else ""."""
    low = F.lower(trim(F.coalesce(as_column(x), F.lit(""))))
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*SMALL_WORDS))
    return F.when(F.regexp_like(low, F.lit(FORM_PHRASES)), F.coalesce(F.regexp_replace(F.get(words, F.lit(0)), r"[.,;:]$", ""), F.lit(""))).otherwise("")


def first_substances(composition: DataFrame) -> DataFrame:
    """cis, generic (first SA row's substance, else the first row's) and form of each product."""
    rank = F.struct((F.col("nature") != "SA").alias("other"), "pos")
    return composition.groupBy("cis").agg(simple_substance(F.min_by("substance", rank)).alias("generic"), form_of_dosage(F.min_by("reference", "pos")).alias("dosage_form"))


def _before_comma(name: Column) -> Column:
    at = F.instr(name, F.lit(", "))
    return F.when(at > 0, trim(name.substr(F.lit(1), at - 1))).otherwise(name)


def _result(brand: Column, generic: Column, form: Column, confidence: Column, method: Column) -> Column:
    return F.struct(brand.alias("brand"), generic.alias("generic"), form.alias("form"), confidence.cast("double").alias("confidence"), method.alias("method"))


def _brand(name: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(trim(F.regexp_extract(name, p, 1)), F.lit("")) for p in patterns), _before_comma(name))


def score(products: DataFrame, composition: DataFrame, members: DataFrame, references: DataFrame) -> DataFrame:
    """Products with a struct per strategy. Every lookup is a join, made once for all strategies.

    members: cis, group_id, pos. references: group_id, reference_cis, reference_name.
    """
    substances = first_substances(composition)
    groups = members.groupBy("cis").agg(F.min_by("group_id", "pos").alias("group_id"))
    theirs = substances.select(F.col("cis").alias("reference_cis"), F.col("generic").alias("reference_generic"))
    rows = products.join(substances, "cis", "left").join(groups, "cis", "left").join(references, "group_id", "left").join(theirs, "reference_cis", "left")
    name, shape = F.coalesce("name", F.lit("")), F.coalesce("shape", F.lit(""))
    generic, comma, reference = F.nullif("generic", F.lit("")), F.instr(F.coalesce("name", F.lit("")), F.lit(", ")) > 0, F.col("reference_cis").isNotNull()
    known, first = generic.isNotNull(), _before_comma(name)
    tail = F.when(comma, trim(F.element_at(F.split(name, ", ", 2), -1))).otherwise(shape)
    form = F.coalesce(F.nullif("dosage_form", F.lit("")), shape)
    split = _result(first, first, tail, F.when(comma, 0.8).otherwise(0.5), F.lit("comma_split"))
    dosed = F.regexp_replace(_brand(name, _BRAND + _DOSE + "|µg)"), r"[,.\s]+$", "")
    principal = F.coalesce(F.nullif("reference_generic", F.lit("")), trim(F.get(F.split("reference_name", ","), F.lit(0))))
    phased = _brand(name, _BRAND + _DOSE + r")\s*,", _BRAND + _DOSE + r")\s+", _BRAND + ",")
    sure = F.when(known & reference & comma, 0.98).when(known & comma, 0.95).when(known, 0.9).when(reference, 0.85).when(comma, 0.8).otherwise(0.5)
    upper, upper_shape = F.upper(name), F.upper(shape)
    ends = (shape != "") & F.contains(upper, upper_shape)
    before = F.when(ends, upper.substr(F.lit(1), F.length(upper) - F.length(upper_shape) - F.instr(F.reverse(upper), F.reverse(upper_shape)) + 1)).otherwise(upper)
    left = trim(F.regexp_replace(trim(before), r"[,.;:\-/]+$", ""))
    strong = F.nullif(trim(F.regexp_extract(name, _STRONG, 1)), F.lit(""))
    brand = trim(F.regexp_replace(F.coalesce(strong, trim(F.get(F.split(name, ","), F.lit(0)))), r"[,.\s]+$", ""))
    return rows.select(
        "cis",
        split.alias("comma_split"),
        _result(left, left, upper_shape, F.when(ends, 0.7).otherwise(0.4), F.lit("form_subtraction")).alias("form_subtraction"),
        _result(brand, F.coalesce(generic, brand), shape, F.when(strong.isNotNull(), 0.9).otherwise(0.6), F.lit("brand_extraction")).alias("brand_extraction"),
        _result(brand, F.coalesce(generic, brand), shape, F.when(known, 0.95).otherwise(0.5), F.lit("composition_lookup")).alias("composition_lookup"),
        _result(dosed, F.coalesce(generic, dosed), form, F.when(known, 0.95).otherwise(0.6), F.when(known, "composition_full").otherwise("composition_fallback")).alias("composition_based"),
        _result(first, F.coalesce(generic, first), tail, F.when(known, 0.9).otherwise(0.8), F.when(known, "hybrid_full").otherwise("hybrid_comma_only")).alias("hybrid"),
        F.when(reference, _result(F.when(comma, first).otherwise(F.get(F.split(name, " "), F.lit(0))), principal, shape, F.when(F.nullif("reference_generic", F.lit("")).isNotNull(), 0.98).otherwise(0.85), F.lit("princeps_canonical"))).otherwise(split).alias("princeps_based"),
        _result(phased, F.coalesce(generic, phased), form, sure, F.when(known, "advanced_full").otherwise("advanced_partial")).alias("advanced_multiphase"),
    )

