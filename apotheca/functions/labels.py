"""Predicates, codes of states and display labels of the catalogue, as columns of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from apotheca.functions import text, words
from apotheca.functions.text import ColumnOrName, as_column, trim


def contains_any(x: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))


def _by_keyword(x: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    first, *rest = classes
    out = F.when(contains_any(x, first[1]), first[0])
    for name, parts in rest:
        out = out.when(contains_any(x, parts), name)
    return out.otherwise(default)


# Predicates


def homeopathy_reason(lab: ColumnOrName, name: ColumnOrName) -> Column:
    """LAB, KEYWORD or null, from a product's laboratory and name."""
    by_lab = contains_any(text.normalise_product(F.coalesce(as_column(lab), F.lit(""))), words.HOMEO_LABS)
    by_name = contains_any(text.normalise_product(F.coalesce(as_column(name), F.lit(""))), words.HOMEO_WORDS)
    return F.when(by_lab, "LAB").when(by_name, "KEYWORD")


def is_homeopathic(label: ColumnOrName, *more: ColumnOrName) -> Column:
    """The wide detector over a label, and a dosage and maker if given: makers, terms, range codes, dilutions."""
    x = F.upper(F.concat_ws(" ", *(F.coalesce(as_column(c), F.lit("")) for c in (label, *more))))
    code = F.regexp_like(x, F.lit(r"\bL\s?\d{2,3}\b")) & F.contains(x, F.lit("SOLUTION BUVABLE"))
    code = code | F.regexp_like(x, F.lit(r"COMPLEXE\s*N[°O]?\s*\d*"))
    return contains_any(x, words.HOMEO_MAKERS + words.HOMEO_TERMS) | code | F.regexp_like(x, F.lit("|".join(words.DILUTIONS)))


def is_active(status: ColumnOrName, commercial: ColumnOrName) -> Column:
    """Authorised or on the market; the capital of Commercialis keeps Non commercialisée out (P5)."""
    authorised = F.contains(F.coalesce(as_column(status), F.lit("")), F.lit("Active")) | F.contains(F.coalesce(as_column(status), F.lit("")), F.lit("Autorisation active"))
    return authorised | F.contains(F.coalesce(as_column(commercial), F.lit("")), F.lit("Commercialis"))


def is_watched(x: ColumnOrName) -> Column:
    """Reinforced surveillance (P10)."""
    up = F.upper(trim(F.coalesce(as_column(x), F.lit(""))))
    return (up == "OUI") | F.contains(up, F.lit("RENFORCÉE"))


def is_stopped(status: ColumnOrName, stopped: ColumnOrName, active: ColumnOrName) -> Column:
    """Not marketed by status, or with stopped packages only."""
    up = F.upper(F.coalesce(as_column(status), F.lit("")))
    return contains_any(up, ("NON COMMERCIALISÉE", "NON COMMERCIALISEE")) | ((as_column(active) == 0) & (as_column(stopped) > 0))


def is_revoked_label(x: ColumnOrName) -> Column:
    """P18, first predicate."""
    return F.contains(F.lower(F.coalesce(as_column(x), F.lit(""))), F.lit("abrog"))


def is_unmarketed_label(x: ColumnOrName) -> Column:
    """P18, second predicate."""
    return F.contains(F.lower(F.coalesce(as_column(x), F.lit(""))), F.lit("non commercialis"))


def truth(x: ColumnOrName) -> Column:
    """A text as a boolean: the usual words, any other text that isn't blank is true."""
    low = F.lower(trim(F.coalesce(as_column(x).cast("string"), F.lit(""))))
    return F.when(low.isin("", "0", "false", "f", "no", "n"), False).otherwise(True)


def known(x: ColumnOrName) -> Column:
    """The trimmed text, "" for null, blank and the words for unknown."""
    t = trim(F.coalesce(as_column(x), F.lit("")))
    return F.when(F.lower(t).isin(*words.UNKNOWN_WORDS), "").otherwise(t)


def commercial_state(x: ColumnOrName) -> Column:
    """active, revoked, not_marketed, suspended or unknown."""
    low = F.lower(trim(F.coalesce(as_column(x), F.lit(""))))
    out = None
    for state, spellings in words.COMMERCIAL_STATES.items():
        out = F.when(low.isin(*spellings), state) if out is None else out.when(low.isin(*spellings), state)
    return out.otherwise("unknown")


def state_label(state: ColumnOrName) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in words.STATE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, as_column(state)), F.lit(words.STATE_LABELS["unknown"]))


def status_flags(commercial: ColumnOrName, availability: ColumnOrName, expires: ColumnOrName, as_of: Column) -> Column:
    """The set of revoked, notMarketed, shortage and expired, against a given moment."""
    state = commercial_state(commercial)
    return F.array_compact(
        F.array(
            F.when(state == "revoked", "revoked"),
            F.when(state == "not_marketed", "notMarketed"),
            F.when(text.nonblank(availability).isNotNull(), "shortage"),
            F.when(as_column(expires) < as_of, "expired"),
        )
    )


def prescription_flags(condition: ColumnOrName) -> Column:
    """The flags that a condition of prescription sets, in order; none for a null one."""
    plain = F.lower(F.coalesce(as_column(condition), F.lit("")))
    return F.array_compact(F.array(*(F.when(F.regexp_like(plain, F.lit(pattern)), flag) for flag, pattern in words.PRESCRIPTION_FLAGS.items())))


def availability(code: ColumnOrName) -> Column:
    """The state of availability that a code stands for; null for another code."""
    states = F.create_map(*(F.lit(x) for pair in words.AVAILABILITY.items() for x in pair))
    return F.try_element_at(states, trim(as_column(code)))


def flag_map(**flags: ColumnOrName) -> Column:
    """Regulatory flags by name as booleans; null counts as false."""
    return F.create_map(*(x for name, c in flags.items() for x in (F.lit(name), F.coalesce(as_column(c).cast("boolean"), F.lit(False)))))


# Classes and labels


def galenic_class(x: ColumnOrName) -> Column:
    """Class of a pharmaceutical form."""
    up = F.upper(F.coalesce(as_column(x), F.lit("")))
    plain = text.strip_accents(up)
    return F.when(F.contains(up, F.lit("INJECT")), "INJECTABLE").when(F.contains(plain, F.lit("PREPARATION RADIOPHARMACEUTIQUE")), "RADIOPHARMACEUTIQUE").otherwise(_by_keyword(up, words.GALENIC_CLASSES, "OTHER"))


def form_kind(x: ColumnOrName) -> Column:
    """solid, liquid, semiSolid, injectable or other."""
    return _by_keyword(F.lower(F.coalesce(as_column(x), F.lit(""))), words.FORM_KINDS, "other")


def main_holder(x: ColumnOrName, default: str = "Laboratoire inconnu") -> Column:
    """The first part between ; or / that isn't blank without its company suffix."""
    parts = F.transform(F.split(F.coalesce(as_column(x), F.lit("")), "[;/]"), lambda p: trim(F.regexp_replace(trim(p), rf"(?i)\s+(?:{'|'.join(words.COMPANY_SUFFIXES)})$", "")))
    return F.coalesce(F.get(F.filter(parts, lambda p: p != ""), F.lit(0)), F.lit(default))


def maker_name(x: ColumnOrName) -> Column:
    """A manufacturer without "Laboratoires", SAS and SA, in upper case."""
    up = trim(F.upper(F.coalesce(as_column(x), F.lit(""))))
    for pattern in (r"^LABORATOIRES?\s+", r"^LABO\s+", r"\s+SAS$", r"\s+SA$"):
        up = F.regexp_replace(up, pattern, "")
    return trim(up)


def product_label(x: ColumnOrName) -> Column:
    """A label without a leading product code and trailing marks."""
    return trim(F.regexp_replace(F.regexp_replace(trim(F.coalesce(as_column(x), F.lit(""))), r"^\d{8}\s+", ""), r"[,.-]+$", ""))


def brand_part(x: ColumnOrName) -> Column:
    """What stands before the first comma, without dosages."""
    unit = r"(?i)\s+\d+(?:[.,]\d+)?\s*(?:mg|g|ml|µg|mcg|ui|%)"
    part = trim(F.get(F.split(trim(F.coalesce(as_column(x), F.lit(""))), ","), F.lit(0)))
    return trim(F.regexp_replace(F.regexp_replace(part, unit + r"\s*(?:/|PAR)\s*(?:ml|dose|g)?", ""), unit, ""))


def masked_label(label: ColumnOrName, form: ColumnOrName) -> Column:
    """A label cut at its form's last place, else at a comma with a listed form, else at the first comma."""
    full, form = F.coalesce(as_column(label), F.lit("")), F.coalesce(as_column(form), F.lit(""))
    low, low_form = F.lower(full), F.lower(form)
    tidy = lambda cut: trim(F.regexp_replace(full.substr(F.lit(1), cut), r"[\s,;:()-]+$", ""))
    found = F.instr(F.reverse(low), F.reverse(low_form))
    out = F.when(low_form == "", trim(full)).when(found > 0, tidy(F.length(low) - found - F.length(low_form) + 1))
    for term in words.MASK_FORMS:
        at = F.instr(low, F.lit(f", {term}"))
        out = out.when(at > 0, tidy(at - 1))
    return out.otherwise(trim(F.get(F.split(full, ","), F.lit(0))))


def grouping_key(x: ColumnOrName) -> Column:
    """The base name that products are grouped by: without brackets, dosages and forms, in upper case."""
    source = F.coalesce(as_column(x), F.lit(""))
    base = trim(F.get(F.split(source, " - "), F.lit(0)))
    unit = r"(?:mg|g|ml|µg|mcg|ui|U\.I\.|M\.U\.I\.|%|meq|mol|gbq|mbq|CH|DH|microgrammes?|milligrammes?)"
    out = F.regexp_replace(base, r"\s*\([^)]*\)", "")
    out = F.regexp_replace(out, r"(?is)^(.*?)(?:équivalant à|équivalent à).*$", "$1")
    for pattern in (
        rf"(?i)(?:\s+\d+(?:[.,]\d+)?\s*{unit}?)?\s+pour(?:\s+\d+(?:[.,]\d+)?\s*{unit}?\b|\s*$)",
        rf"(?i)\b\d+(?:[.,]\d+)?\s*{unit}(?![a-z0-9])",
        r"\b\d+(?:[.,]\d+)?\b",
        r"\s*%\s*",
        r"(?i)\s+POUR ?CENT\b",
        r"\s*/\s*\w*",
    ):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, rf"(?i)(?<=^|\s)(?:{'|'.join(words.GROUPING_FORMS)})(?=\s|$)", " ")
    out = F.upper(trim(text.collapse(out)))
    bare = trim(F.regexp_replace(base, r"(?s)\s+\d+.*$", ""))
    short = F.when(F.regexp_like(base, F.lit(r"^\d")), "").when(bare == "", F.upper(trim(source))).otherwise(F.upper(bare))
    return F.when(source == "", "").when(F.length(out) < 3, short).otherwise(out)


def _any_part(x: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(p)) for p in parts))


def is_form_only(x: ColumnOrName) -> Column:
    """Whether every word of a text has a form in it; single letters are passed over."""
    parts = F.filter(F.split(F.lower(F.coalesce(as_column(x), F.lit(""))), rf"[{text.WHITE},.\-]+"), lambda w: w != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda w: (F.length(w) < 2) | _any_part(w, words.FORM_KEYWORDS))


def is_formulation(x: ColumnOrName) -> Column:
    """Whether a text describes a formulation instead of naming a brand.

    It is a form only, holds two of the listed keywords, holds one and is longer than 60 letters, or begins with no capital
    letter and has a form or a keyword in each of its words.
    """
    x = F.coalesce(as_column(x), F.lit(""))
    low = trim(F.lower(x))
    found = reduce(lambda a, b: a + b, (F.contains(low, F.lit(k)).cast("int") for k in words.FORMULATION_KEYWORDS))
    head = x.substr(1, 1)
    each = F.forall(F.split(low, rf"[{text.WHITE}]+"), lambda w: (F.length(w) < 2) | _any_part(w, words.FORM_KEYWORDS) | _any_part(w, words.FORMULATION_KEYWORDS))
    return (x != "") & (is_form_only(x) | (found >= 2) | ((F.length(x) > 60) & (found >= 1)) | ((head == F.lower(head)) & each))


def display_title(is_princeps: ColumnOrName, group_id: ColumnOrName, reference: ColumnOrName, canonical: ColumnOrName) -> Column:
    """A reference's brand, a group member's molecule, else the canonical name."""
    first = trim(F.get(F.split(as_column(canonical), " - "), F.lit(0)))
    return F.when(as_column(is_princeps), text.princeps_label(reference)).when(as_column(group_id).isNotNull(), F.coalesce(F.nullif(first, F.lit("")), as_column(canonical))).otherwise(as_column(canonical))


def subtitle(*parts: ColumnOrName) -> Column:
    """The parts that aren't blank, joined by a middle dot."""
    return F.concat_ws(" • ", *(text.nonblank(p) for p in parts))


def code_line(cip: ColumnOrName, holder: ColumnOrName | None = None) -> Column:
    """The code of a package, after its holder if there is one."""
    line = F.concat(F.lit("CIP "), as_column(cip))
    return line if holder is None else F.when(as_column(holder) != "", F.concat(trim(holder), F.lit(" • "), line)).otherwise(line)


def _molecule(canonical: ColumnOrName) -> Column:
    return trim(F.get(F.split(as_column(canonical), " - "), F.lit(0)))


def _has_reference(is_princeps: ColumnOrName, group_id: ColumnOrName, reference: ColumnOrName) -> Column:
    """Whether a product is a generic whose group's reference is known."""
    return ~as_column(is_princeps) & as_column(group_id).isNotNull() & ~F.coalesce(as_column(reference), F.lit("")).isin("", "Inconnu")


def hero_label(is_princeps: ColumnOrName, group_id: ColumnOrName, brand: ColumnOrName, reference: ColumnOrName, canonical: ColumnOrName) -> Column:
    """What a card shows first (T28): the brand or else the reference, for references and generics of a known one; a group
    member's molecule; else the canonical name."""
    named = as_column(is_princeps) | _has_reference(is_princeps, group_id, reference)
    return F.when(named, F.coalesce(F.nullif(as_column(brand), F.lit("")), as_column(reference))).when(as_column(group_id).isNotNull(), _molecule(canonical)).otherwise(as_column(canonical))


def display_name(is_princeps: ColumnOrName, brand: ColumnOrName, reference: ColumnOrName, canonical: ColumnOrName) -> Column:
    """A reference's brand, unless it is blank or the placeholder BRAND, or else its whole name; a generic's molecule."""
    own = F.nullif(trim(brand), F.lit(""))
    return F.when(as_column(is_princeps), F.coalesce(F.when(F.upper(own) != "BRAND", own), trim(reference))).otherwise(_molecule(canonical))


def subtitle_lines(is_princeps: ColumnOrName, group_id: ColumnOrName, reference: ColumnOrName, canonical: ColumnOrName, form: ColumnOrName, dosage: ColumnOrName) -> Column:
    """The lines below a label (T28): the canonical name of a generic of a known reference, then form and dosage; blanks are left out."""
    return F.array_compact(F.array(F.when(_has_reference(is_princeps, group_id, reference), text.nonblank(canonical)), F.nullif(subtitle(form, dosage), F.lit(""))))


def quoted_phrase(query: ColumnOrName) -> Column:
    """A search phrase in double quotes, trimmed."""
    return F.concat(F.lit('"'), trim(query), F.lit('"'))


def atc_label(code: ColumnOrName) -> Column:
    """Label of a code's first letter, null if there is none."""
    labels = F.create_map(*(F.lit(x) for pair in words.ATC_LEVEL_1.items() for x in pair))
    return F.try_element_at(labels, F.upper(trim(as_column(code)).substr(1, 1)))
