"""Package codes, barcodes, dates, prices and encoded values, as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apotheca.functions.text import WHITE, ColumnOrName, as_column, trim

#: Milligrams per unit.
DOSAGE_UNITS = {"KG": 1_000_000.0, "G": 1000.0, "MG": 1.0, "UG": 0.001, "ΜG": 0.001, "µG": 0.001, "MCG": 0.001}


def price(x: ColumnOrName) -> Column:
    """A price with a comma or dot; a numeric beginning is enough, blank or unreadable gives null."""
    return F.regexp_extract(F.regexp_replace(as_column(x), "^([^,]*),", "$1."), r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def price_is_broken(x: ColumnOrName) -> Column:
    """A text that isn't blank but has no price; such rows are rejected."""
    return (F.coalesce(trim(x), F.lit("")) != "") & price(x).isNull()


def whole_number(x: ColumnOrName, default: int) -> Column:
    """The leading integer of a text, else the default (D8f)."""
    return F.coalesce(F.regexp_extract(as_column(x), r"^\s*([-+]?\d+)", 1).try_cast("int"), F.lit(default))


def dosage_mg(value: ColumnOrName, unit: ColumnOrName) -> Column:
    """A dosage in milligrams; an unknown unit leaves the value as it is (D7f)."""
    factors = F.create_map(*(F.lit(x) for pair in DOSAGE_UNITS.items() for x in pair))
    return as_column(value) * F.coalesce(F.try_element_at(factors, F.upper(as_column(unit))), F.lit(1.0))


def short_code(code: ColumnOrName) -> Column:
    """The 7-character code: itself, or from a 13-character one that begins with 34009; else null (D4f)."""
    c = as_column(code)
    return F.when(F.length(c) == 7, c).when((F.length(c) == 13) & F.startswith(c, F.lit("34009")), c.substr(6, 7))


def generated_short_code(code: ColumnOrName) -> Column:
    """The table's generated column, without a check of the prefix (D4f)."""
    return as_column(code).substr(6, 7)


# Barcodes

_FIELD = r"\G\x1D*(01[0-9]{14}|1[17][0-9]{6}|(?:10|21)[^\x1D]*)"


def _gs1_field(raw: Column, identifier: str) -> Column:
    """The last field of an identifier that isn't empty, among those that can be read from the start."""
    fields = F.regexp_extract_all(F.regexp_replace(raw, rf"[{WHITE}]", "\x1d"), F.lit(_FIELD), F.lit(1))
    found = F.get(F.reverse(F.filter(fields, lambda f: F.startswith(f, F.lit(identifier)) & (F.length(f) > 2))), F.lit(0))
    return found.substr(F.lit(3), F.length(found))


def gs1_date(x: ColumnOrName) -> Column:
    """YYMMDD as a date: years from 50 are 19xx, day 00 is the month's last, days past it run on; else null (D3f)."""
    x = as_column(x)
    number = lambda start: x.substr(start, 2).try_cast("int")
    year = number(1) + F.when(number(1) >= 50, 1900).otherwise(2000)
    month, day = number(3), number(5)
    first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
    return F.when(F.regexp_like(x, F.lit(r"^\d{6}$")) & month.between(1, 12) & (day <= 31), F.when(day == 0, F.last_day(first)).otherwise(F.date_add(first, day - 1)))


def parse_gs1(raw: ColumnOrName) -> Column:
    """Struct gtin (13 digits), short_code, serial, lot, expires, made of a barcode (D1f, D2f).

    White space, no-break spaces too, counts as the separator 0x1D. A lot or serial may be empty and is then left out. Reading
    stops at the first place that no field fits.
    """
    raw = as_column(raw)
    fourteen = _gs1_field(raw, "01")
    gtin = fourteen.substr(2, 13)
    return F.struct(
        gtin.alias("gtin"),
        short_code(gtin).alias("short_code"),
        _gs1_field(raw, "21").alias("serial"),
        _gs1_field(raw, "10").alias("lot"),
        gs1_date(_gs1_field(raw, "17")).alias("expires"),
        gs1_date(_gs1_field(raw, "11")).alias("made"),
    )


def build_gs1(code: ColumnOrName, expires: ColumnOrName, lot: ColumnOrName, serial: ColumnOrName) -> Column:
    """A barcode that parse_gs1 reads back; null parts are left out (D5f)."""
    fields = (("01", F.lpad(as_column(code), 14, "0"), ""), ("17", F.date_format(as_column(expires), "yyMMdd"), ""), ("10", as_column(lot), "\x1d"), ("21", as_column(serial), ""))
    return F.concat(*(F.coalesce(F.concat(F.lit(key), value, F.lit(end)), F.lit("")) for key, value, end in fields))


def box_label(code: ColumnOrName, serial: ColumnOrName, lot: ColumnOrName) -> Column:
    """code[_serial[_lot]], the name of one box (M9)."""
    return F.concat_ws("_", as_column(code), F.nullif(as_column(serial), F.lit("")), F.when(F.nullif(as_column(serial), F.lit("")).isNotNull(), F.nullif(as_column(lot), F.lit(""))))


# Times, JSON and settings


def second(x: ColumnOrName) -> Column:
    """A moment as text, cut to the second; null if it can't be read (D6f)."""
    return F.date_format(as_column(x).try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def due(last: ColumnOrName, days: ColumnOrName, now: Column) -> Column:
    """Whether a sync is due: never done, or at least so many days ago; 0 days is never (D14f)."""
    gap = F.make_dt_interval(as_column(days))
    return (as_column(days) > 0) & (as_column(last).isNull() | (as_column(last) + gap <= now))


def text_list(x: ColumnOrName) -> Column:
    """A JSON list of texts, or else a comma-separated one, as an array; null and blank are empty (D9f, D10f)."""
    t = trim(F.coalesce(as_column(x), F.lit("")))
    parsed = F.from_json(t, "array<string>")
    split = F.filter(F.transform(F.split(t, ","), lambda p: trim(p)), lambda p: p != "")
    return F.when(F.startswith(t, F.lit("[")), F.coalesce(parsed, F.expr("cast(array() as array<string>)"))).otherwise(split)


def is_json(x: ColumnOrName) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), as_column(x), F.lit("]"))) == 1, F.lit(False))


def setting(value: ColumnOrName, kind: str) -> Column:
    """A stored UTF-8 value as string, int, double, boolean, map or timestamp; null if it isn't one (D12f)."""
    t = F.decode(as_column(value), "UTF-8")
    return {
        "string": lambda: t,
        "int": lambda: t.try_cast("bigint"),
        "double": lambda: t.try_cast("double"),
        "boolean": lambda: F.when(F.lower(t).isin("true", "1"), True).when(F.lower(t).isin("false", "0"), False),
        "map": lambda: F.from_json(t, "map<string,string>"),
        "timestamp": lambda: t.try_cast("timestamp_ntz"),
    }[kind]()
