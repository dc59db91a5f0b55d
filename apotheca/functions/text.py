"""Text normalisers of the catalogue: each takes a column or its name and returns a column.

All are built-in Spark functions. Long chains of rewrites bind what they use more than once, so that plans stay small
enough to be compiled. Null gives null unless said
otherwise. White space is Unicode's, which Java's \\s alone is not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from apotheca.functions.words import (
    ELECTROLYTES,
    FALLBACK_FORMS,
    INORGANIC_CORES,
    INORGANIC_MODIFIERS,
    KEYWORD_STOPWORDS,
    MINERAL_MODIFIERS,
    MINERALS,
    NAME_STOPWORDS,
    PARENTHESIS_SALTS,
    PRINCIPLE_LAST,
    PRINCIPLE_NOISE,
    PRINCIPLE_SPELLINGS,
    SALT_PREFIXES,
    SALT_SUFFIXES,
)

ColumnOrName = Column | str
WHITE = r"\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The characters of WHITE.
SPACES = " \t\n\v\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _accent_table() -> tuple[str, str]:
    """Letters with marks and the letters below them, for all of Latin that decomposes to one letter."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accent_table()
#: Ligatures that the second flavour spells out.
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}


def bound(x: ColumnOrName, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(as_column(x)), use), F.lit(0))


def trim(x: ColumnOrName) -> Column:
    """Without white space at both ends."""
    return F.trim(as_column(x), F.lit(SPACES))


def collapse(x: ColumnOrName) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(as_column(x), rf"[{WHITE}]+", " ")


def strip_marks(x: ColumnOrName) -> Column:
    """Letters without their diacritical marks (X1, decomposition flavour); ligatures stay."""
    return F.regexp_replace(F.translate(as_column(x), _MARKED, _PLAIN), r"[\u0300-\u036F]", "")


def strip_accents(x: ColumnOrName) -> Column:
    """As strip_marks, and ligatures spelled out (X1, table flavour)."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), strip_marks(x))


def nonblank(x: ColumnOrName) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(trim(x), F.lit(""))


def first_nonblank(*columns: ColumnOrName) -> Column:
    """The first column that isn't blank, trimmed."""
    return F.coalesce(*(nonblank(c) for c in columns))


# Normalisers. Three phases of the catalogue use three different ones, so they stay apart.


def normalise_profile(x: ColumnOrName) -> Column:
    """Trim, upper case, no marks (T2 of profiling)."""
    return strip_marks(F.upper(trim(x)))


def normalise_name(x: ColumnOrName) -> Column:
    """As normalise_profile, with runs of white space collapsed (T2 of election and naming)."""
    return collapse(normalise_profile(x))


def normalise_product(x: ColumnOrName) -> Column:
    """As normalise_profile, without (E) and (SE), collapsed and trimmed."""
    return trim(collapse(F.regexp_replace(normalise_profile(x), r"\(S?E\)", "")))


def normalise_search(x: ColumnOrName) -> Column:
    """Lower-case letters and digits separated by single spaces (T6); null gives an empty text."""
    x = F.coalesce(as_column(x), F.lit(""))
    plain = F.lower(F.when(F.octet_length(x) == F.char_length(x), x).otherwise(strip_accents(x)))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


# Cutting names


def _last_index(text: Column, part: Column) -> Column:
    """0-based position of the last occurrence, -1 if there is none; an empty part is at the end."""
    found = F.instr(F.reverse(text), F.reverse(part))
    return F.when(part == "", F.length(text)).when(found == 0, F.lit(-1)).otherwise(F.length(text) - found - F.length(part) + 1)


def _before(text: Column, index: Column) -> Column:
    return text.substr(F.lit(1), index)


def _without_tail(text: Column) -> Column:
    return trim(F.regexp_replace(trim(text), r"[,.;:\-/]+$", ""))


def _word_before_pivot(name: Column, shape: Column) -> Column:
    """What stands before the last whole-word hit of the shape's first word of over two letters, else null (T4)."""
    pivot = F.get(F.filter(F.split(shape, rf"[{WHITE}(),;:./]+"), lambda t: F.length(t) > 2), F.lit(0))
    pattern = F.concat(F.lit(r"(?s)^(.*)(?<![A-Za-z0-9_])\Q"), pivot, F.lit(r"\E(?![A-Za-z0-9_])"))
    cut = F.when(F.regexp_like(name, pattern), _without_tail(F.get(F.regexp_extract_all(name, pattern, F.lit(1)), F.lit(0))))
    return F.when(F.length(cut) > 1, cut)


def subtract_shape(name: ColumnOrName, shape: ColumnOrName) -> Column:
    """A product name without its form: up to the first ", ", else the form's last place, else its main word."""
    cut = lambda n, s, at: F.when(at >= 0, _without_tail(_before(n, at))).otherwise(F.coalesce(_word_before_pivot(n, s), n))
    by_shape = lambda n: bound(normalise_product(F.coalesce(as_column(shape), F.lit(""))), lambda s: bound(_last_index(n, s), lambda at: cut(n, s, at)))
    return bound(normalise_product(name), lambda n: F.when(F.contains(n, F.lit(", ")), trim(F.substring_index(n, ", ", 1))).otherwise(by_shape(n)))


def clean_fallback_label(label: ColumnOrName) -> Column:
    """The brand of a group label: after the last " - ", up to ", " or the first listed form found."""
    ends = ("(.*?), ", *(f"(.*) {form}" for form in FALLBACK_FORMS))
    n = normalise_name(F.element_at(F.split(as_column(label), " - "), -1))
    return trim(F.regexp_replace(n, rf"(?s)^(?:{'|'.join(ends)}).*$", "".join(f"${i + 1}" for i in range(len(ends)))))


def brand_name(name: ColumnOrName) -> Column:
    """The first word of over two letters once dosages and numbers are gone, else UNKNOWN."""
    n = normalise_name(name)
    n = F.regexp_replace(n, r"(?i)[0-9.,]+\s*(?:(?:MG|G|ML|UI|M\.?U\.?I|MCG|MICROGRAMMES?)(?![A-Za-z0-9_])|%(?=[A-Za-z0-9_]))", "")
    n = F.regexp_replace(n, r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "")
    words = F.filter(F.split(n, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*NAME_STOPWORDS))
    return F.coalesce(F.get(words, F.lit(0)), F.lit("UNKNOWN"))


def promoted_name(name: ColumnOrName) -> Column:
    """Name of a cluster that one ungrouped product founds."""
    return substance_name(F.regexp_replace(F.get(F.split(as_column(name), ","), F.lit(0)), r"(?i)[0-9]+\s*(?:mg|g|ml|%)", ""))


# Substances


def is_pure_inorganic(name: Column) -> Column:
    """A mineral alone, a core with "DE" and a mineral, or a core with a modifier."""
    minerals, cores, modifiers = ("|".join(w) for w in (MINERALS, INORGANIC_CORES, INORGANIC_MODIFIERS))
    return F.regexp_like(name, F.lit(rf"^ *(?:(?:{minerals})|(?:{cores}) +(?:DE|D'|D) +(?:{minerals})|(?:{cores}) +(?:{modifiers})) *$"))


def substance_name(label: ColumnOrName) -> Column:
    """A substance without its salts, in upper case; pure inorganic names stay; blank gives "" (T7)."""
    x = F.upper(strip_accents(trim(F.upper(F.coalesce(as_column(label), F.lit(""))))))
    x = trim(F.regexp_replace(x, r"(?s)^(.*?)(?:EQUIVALANT A|EQUIVALENT A).*$", "$1"))
    x = F.regexp_replace(x, rf"\s*\([^)]*(?:{'|'.join(PARENTHESIS_SALTS)})[^)]*\)\s*$", "")
    bare = "|".join(rf"{p}\s*" if p.endswith("'") else rf"{p}(?:\s+|$)" for p in SALT_PREFIXES)
    organic = F.regexp_replace(x, rf"^(?:{bare})", "")
    organic = F.regexp_replace(organic, rf"(?:\s+(?:{'|'.join(sorted(set(SALT_SUFFIXES), key=len, reverse=True))}))+\s*$", "")
    for mineral in MINERALS:
        organic = trim(F.regexp_replace(organic, rf"\s+(?:DE\s+|D'){mineral}$", ""))
    for modifier in MINERAL_MODIFIERS:
        organic = trim(F.regexp_replace(organic, rf" {modifier}$", ""))
    return trim(collapse(F.when(is_pure_inorganic(x), x).otherwise(organic)))


def format_principles(x: ColumnOrName) -> Column:
    """Comma-separated principles, each with a capital first letter."""
    parts = F.filter(F.transform(F.split(as_column(x), ","), lambda p: trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(p.substr(1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), ", ")


def _rewritten(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Each rule once, in order; what is left is trimmed after each."""
    return reduce(lambda c, rule: trim(F.regexp_replace(c, *rule)), rules, x)


def index_principle(x: ColumnOrName) -> Column:
    """A principle as the search index holds it: without stereo marks, inverse salts, salts and noise, spellings united.

    Its own order of rewrites, other than that of ``substance_name``: minerals go before salt suffixes, these in one pass
    through their list, and a pure inorganic name ends the chain at once.
    """
    n = F.upper(strip_accents(trim(F.upper(F.coalesce(as_column(x), F.lit(""))))))
    salt_of = r"\s*\(\s*([^()]+?)"
    inverse = ((rf"^(?:{'|'.join(ELECTROLYTES)}){salt_of}(?:\s+(?:DE|D['’]))?\s+DE\s*\)$", "$1"), (rf"^([A-Z0-9\-]+){salt_of}\s+DE\s*\)$", "$1"))
    n = _rewritten(n, ((r"^ACIDE\s+", ""), (r"^\(\s*[RS]\s*\)\s*-\s*(.+)$", "$1"), *inverse))
    return bound(n, lambda n: trim(collapse(F.when(is_pure_inorganic(n), n).otherwise(_index_rewrites(n)))))


def _index_rewrites(n: Column) -> Column:
    minerals = ((rf"\s+(?:DE\s+|D['’]){m}$|^{m}\s+(?:DE\s+|D['’])[{WHITE}]*", "") for m in MINERALS)
    prefixes = "|".join(p if p.endswith("'") else rf"{p}(?= |$)" for p in SALT_PREFIXES)
    # In one pass, what stands further left comes later in the list.
    suffixes = "".join(rf"(?:\s* {suffix})?" for suffix in reversed(dict.fromkeys(SALT_SUFFIXES)))
    salts = ((suffixes + "$", ""), (r"\s*\([A-Z]+\s+D[E'’].*\)$", ""), (rf"\s*\((?:{'|'.join(SALT_SUFFIXES)})\)", ""))
    omega = ((r"(?s)^(?=.*OMEGA[- ]3).*?(OMEGA[- ]?3).*$", "$1"), (r"^OMEGA 3$", "OMEGA-3"))
    calcitonin = (r"(?s)^(?=.*CALCITONINE).*(?:SAUMON|SALMINE|SYNTHETIQUE).*$", "CALCITONINE")
    return _rewritten(n, (*PRINCIPLE_NOISE, (rf"^(?:{prefixes})\s*", ""), *minerals, *salts, *omega, calcitonin, *PRINCIPLE_SPELLINGS, *PRINCIPLE_LAST))


def common_principles(x: ColumnOrName) -> Column:
    """Principles split on + or else on commas, as the search index holds them, distinct, sorted and joined by a space."""
    x = as_column(x)
    parts = F.when(F.contains(x, F.lit("+")), F.split(x, r"\+")).otherwise(F.split(x, ","))
    names = F.filter(F.transform(parts, lambda p: index_principle(p)), lambda p: p != "")
    return F.array_join(F.array_sort(F.array_distinct(names)), " ")


def princeps_label(x: ColumnOrName) -> Column:
    """What follows the last " - ", trimmed."""
    return trim(F.element_at(F.split(trim(x), " - "), -1))


def search_vector(display: ColumnOrName, *lists: ColumnOrName) -> Column:
    """Upper-case text of a display name and lists of names; nulls are left out."""
    return F.upper(F.concat_ws(" ", as_column(display), *(as_column(x) for x in lists)))


def keyword_vector(substance: ColumnOrName, brand: ColumnOrName, others: ColumnOrName, principles: ColumnOrName, raw_names: ColumnOrName) -> Column:
    """Words of letters and digits of a product's names for the index, without stop words.

    Entries count once, by their first place: the substance, the brand, an array of other brands, principles (cut at + and
    commas, and before a dosage) and an array of raw names. Nulls and empties are left out.
    """
    none = F.expr("cast(array() as array<string>)")
    cut = F.transform(F.split(F.coalesce(as_column(principles), F.lit("")), "[+,]"), lambda p: trim(F.get(F.split(trim(p), rf"[{WHITE}]+[0-9]"), F.lit(0))))
    raw = F.filter(F.coalesce(as_column(raw_names), none), lambda n: trim(n) != "")
    entries = F.concat(F.array(as_column(substance), as_column(brand)), F.coalesce(as_column(others), none), cut, F.transform(raw, lambda n: F.upper(strip_marks(n))))
    joined = F.upper(strip_marks(F.array_join(F.array_distinct(F.filter(entries, lambda e: e.isNotNull() & (e != ""))), " ")))
    kept = F.regexp_replace(joined, rf"(?<![A-Za-z0-9_])(?:{'|'.join(KEYWORD_STOPWORDS)})(?![A-Za-z0-9_])", " ")
    return F.trim(F.regexp_replace(kept, "[^A-Z0-9]+", " "))


def common_word_prefix(names: ColumnOrName) -> Column:
    """The longest run of words that all texts of an array begin with, without case, as the first one spells it.

    Where that has less than three letters, the texts are compared again without blanks and hyphens, letter by letter: three
    letters or more in common are spelt like the first text that has just these, if there is one. One text is its own answer.
    """
    names = as_column(names)
    split = F.transform(names, lambda n: F.split(trim(n), rf"[{WHITE}]+"))
    upper = F.transform(split, lambda w: F.transform(w, lambda x: F.upper(x)))
    run = lambda w, n: F.slice(w, F.lit(1), n)
    longest = lambda sizes, same: F.coalesce(F.array_max(F.filter(sizes, same)), F.lit(0))
    counts = F.sequence(F.lit(1), F.array_min(F.transform(split, lambda w: F.size(w))))
    by_word = F.array_join(run(F.get(split, F.lit(0)), longest(counts, lambda n: F.forall(upper, lambda w: run(w, n) == run(F.get(upper, F.lit(0)), n)))), " ")

    dense = lambda n: F.upper(F.regexp_replace(n, rf"[{WHITE}\-]", ""))
    condensed = F.transform(names, dense)
    fewest = F.array_min(F.transform(condensed, lambda c: F.length(c)))
    sizes = F.when(fewest > 0, F.sequence(F.lit(1), fewest)).otherwise(F.expr("cast(array() as array<int>)"))
    head = F.get(condensed, F.lit(0)).substr(F.lit(1), longest(sizes, lambda n: F.forall(condensed, lambda c: c.substr(F.lit(1), n) == F.get(condensed, F.lit(0)).substr(F.lit(1), n))))
    spelt = F.coalesce(F.get(F.filter(names, lambda n: dense(n) == head), F.lit(0)), head)
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, F.get(names, F.lit(0))).when((F.length(by_word) < 3) & (F.length(head) >= 3), spelt).otherwise(by_word)


def run_words(x: ColumnOrName) -> Column:
    """The words of a normalised name that runs are made of: decimals stay whole, punctuation separates."""
    masked = F.regexp_replace(as_column(x), r"([0-9])[.,]([0-9])", "$1DECIMAL$2")
    return F.filter(F.transform(F.split(masked, r"[\s\-,.()]+"), lambda t: F.replace(t, F.lit("DECIMAL"), F.lit(","))), lambda t: t != "")


def has_run(name: ColumnOrName, run: ColumnOrName) -> Column:
    """Whether a run of words stands in a normalised name as whole words."""
    name, run = as_column(name), as_column(run)
    return F.contains(name, run) & F.regexp_like(name, F.concat(F.lit(r"(?i)(?:\b)\Q"), run, F.lit(r"\E\b")))


def longest_common_words(names: ColumnOrName) -> Column:
    """The longest run of words of the shortest text that stands in all texts of an array.

    Longest first, then leftmost, of the last of equally short texts; decimals stay whole. One text is its own
    answer, none gives "". For groups of any size ``clusters.common_runs`` does the same on rows.
    """
    names = as_column(names)
    plain = F.transform(names, lambda n: normalise_name(n))
    split = F.transform(plain, lambda n: run_words(n))
    fewest = F.array_min(F.transform(split, lambda w: F.size(w)))
    shortest = F.element_at(F.filter(split, lambda w: F.size(w) == fewest), -1)
    everywhere = F.filter(word_runs(shortest), lambda run: F.forall(plain, lambda n: has_run(n, run)))
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(F.coalesce(F.get(everywhere, F.lit(0)), F.lit("")))


def word_runs(words: ColumnOrName) -> Column:
    """All runs of an array of words, the longest first, then the leftmost."""
    words = as_column(words)
    size = F.size(words)
    none = F.expr("cast(array() as array<int>)")
    runs = F.transform(F.when(size > 0, F.sequence(size, F.lit(1))).otherwise(none), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda start: F.array_join(F.slice(words, start, n), " ")))
    return F.coalesce(F.flatten(runs), F.expr("cast(array() as array<string>)"))


def agreed_name(common: ColumnOrName, first: ColumnOrName, count: ColumnOrName, chemical_id: ColumnOrName) -> tuple[Column, Column]:
    """Display name of a cluster and how it was found, from its elected names' common words, the first name, and how many there are."""
    common, first, count = as_column(common), as_column(first), as_column(count)
    agreed = (F.length(common) >= 3) & ~F.regexp_like(common, F.lit(r"^[0-9]+$"))
    name = F.when(count <= 0, F.concat(F.lit("CLUSTER_"), as_column(chemical_id).substr(1, 8))).when(count == 1, first).when(agreed, common).otherwise(brand_name(first))
    method = F.when(count <= 0, "BRAND_EXTRACTION_FALLBACK").when(count == 1, "SINGLE_SOURCE").when(agreed, "LCS_CONSENSUS").otherwise("BRAND_EXTRACTION_FALLBACK")
    return substance_name(name), method


# Labels


def euro(x: ColumnOrName) -> Column:
    """A price with two decimals, a comma and the sign."""
    return F.concat(F.replace(F.format_string("%.2f", as_column(x)), F.lit("."), F.lit(",")), F.lit(" €"))


def initial(x: ColumnOrName) -> Column:
    """Upper-case first letter without marks, # for anything but a letter."""
    letter = F.upper(trim(x).substr(1, 1))
    return F.when(F.regexp_like(letter, F.lit("^[A-ZÀ-ÖØ-Ý]$")), letter).otherwise("#")


def natural_key(x: ColumnOrName) -> Column:
    """An array that sorts like the text with its numbers as numbers and letters without case.

    Numbers come before text. A number with a comma counts as 0, as in the catalogue.
    """
    runs = F.regexp_extract_all(as_column(x), F.lit("[0-9.,]+|[^0-9.,]+"), F.lit(0))
    number = lambda r: F.coalesce(F.expr("0.0D") + r.try_cast("double"), F.lit(0.0))
    return F.transform(runs, lambda r: F.when(F.regexp_like(r, F.lit("^[0-9.,]+$")), F.concat(F.lit("0"), F.lpad(F.format_string("%.6f", number(r)), 24, "0"))).otherwise(F.concat(F.lit("1"), F.lower(r))))
