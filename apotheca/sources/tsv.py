"""Readers of the catalogue's tab-separated files: typed rows with a stable position, and the rejected lines.

Positions matter, for many rules take the first row. A position is the number of a line over all files, so it doesn't depend on
how files are cut into splits or splits into tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apotheca.functions import codes, labels, text
from apotheca.sources.store import materialised


@dataclass(frozen=True)
class Parsed:
    rows: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """One row: how many lines were taken and rejected."""
        taken = self.rows.agg(F.count("*").alias("taken"))
        return taken.crossJoin(self.rejects.agg(F.count("*").alias("rejected")))


def lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """pos and value of the lines that aren't blank; .gz files are read as they are.

    pos counts lines from 0 over all files in the order of their paths, blank ones too. Lines are written once with their place in
    the split they come from; splits are counted, put in order of path and offset, and each moves its lines by what is before it.
    One task sees a row per split; no line is shuffled unless these rows outgrow a broadcast.
    """
    reader = spark.read.option("encoding", charset)
    read = reader.text(path) if charset.upper() == "UTF-8" else reader.option("sep", chr(0)).option("quote", "").csv(path, schema="value string")
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    written = materialised(read.select("value", *split, F.monotonically_increasing_id().alias("__at")), "lines")
    splits = written.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    moves = materialised(splits.select("__file", "__start", shift.alias("__shift")), "splits")
    return written.filter(text.nonblank("value").isNotNull()).join(moves, ["__file", "__start"]).select((F.col("__at") + F.col("__shift")).alias("pos"), "value")


def records(source: DataFrame, names: list[str], exact: bool = True, raw: bool = False) -> Parsed:
    """Lines as named text columns; another number of cells is rejected, or with exact=False only fewer."""
    cells = F.split("value", "\t", -1)
    fits = F.size(cells) == len(names) if exact else F.size(cells) >= len(names)
    columns = [text.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)]
    return Parsed(source.filter(fits).select("pos", *columns, *([F.col("value").alias("_raw")] if raw else [])), source.filter(~fits))


def _cut(source: DataFrame, least: int, columns: dict[str, Column], valid: Column) -> Parsed:
    """Typed rows, and the lines that fail validation; lines with too few cells are left out of both."""
    cells = source.withColumn("cells", F.split("value", "\t", -1))
    enough = cells.filter(F.size("cells") >= least)
    typed = enough.select("pos", "value", *(c.alias(n) for n, c in columns.items())).withColumn("__valid", F.coalesce(valid, F.lit(False)))
    return Parsed(typed.filter("__valid").drop("__valid", "value"), typed.filter("not __valid").select("pos", "value"))


def _cell(i: int) -> Column:
    return text.trim(F.get("cells", F.lit(i)))


def products(source: DataFrame) -> Parsed:
    """S1 with P3, P10, T3, T5 and P20: products need 11 cells and an id of 8 characters."""
    columns = {
        "cis": _cell(0), "name": _cell(1), "shape": _cell(2), "routes": _cell(3), "status": _cell(4), "procedure": _cell(5), "commercial": _cell(6), "authorised_on": _cell(7), "lab": _cell(10),
        "is_watched": labels.is_watched(F.get("cells", F.lit(11))),
    }
    found = _cut(source, 11, columns, F.length("cis") == 8)
    reason = labels.homeopathy_reason("lab", "name")
    rows = found.rows.withColumn("homeopathy_reason", reason).withColumn("is_homeopathic", F.col("homeopathy_reason").isNotNull())
    rows = rows.withColumn("clean_name", text.subtract_shape("name", "shape"))
    return Parsed(rows.withColumn("is_suspect_name", cleaning_is_suspect("name", "clean_name")), found.rejects)


def cleaning_is_suspect(name: str, clean: str) -> Column:
    """A cleaned name that is empty, or still the whole name although it has a comma or a bracket (T5)."""
    return (F.length(clean) < 2) | ((F.col(clean) == text.normalise_product(name)) & F.regexp_like(name, F.lit("[,(]")))


def members(source: DataFrame) -> Parsed:
    """Group memberships need 5 cells, a group id and a product id of 8 characters."""
    columns = {"group_id": _cell(0), "label": _cell(1), "cis": _cell(2), "type": _cell(3), "sort_order": codes.whole_number(_cell(4), 999)}
    return _cut(source, 5, columns, (F.length("group_id") >= 1) & (F.length("cis") == 8))


def packages(source: DataFrame) -> Parsed:
    """S3 with P9: packages need 13 cells, a code of 13 characters and a readable price or none."""
    columns = {
        "cis": _cell(0), "cip7": _cell(1), "label": _cell(2), "status": _cell(3), "commercial": _cell(4), "marketed_on": _cell(5), "cip13": _cell(6), "collectivities": _cell(7), "refund": _cell(8),
        "price": codes.price(_cell(9)), "__broken": codes.price_is_broken(_cell(9)),
    }
    found = _cut(source, 13, columns, (F.length("cis") == 8) & (F.length("cip13") == 13) & ~F.col("__broken"))
    return Parsed(found.rows.drop("__broken"), found.rejects)


def compositions(source: DataFrame) -> Parsed:
    """Composition rows need 8 cells; "0" and blank links are independent."""
    columns = {"cis": _cell(0), "element": _cell(1), "code": _cell(2), "substance": _cell(3), "dosage": _cell(4), "reference": _cell(5), "nature": _cell(6), "link": F.when(_cell(7).isin("", "0"), "").otherwise(_cell(7))}
    return _cut(source, 8, columns, F.length("cis") > 0)


def conditions(source: DataFrame) -> Parsed:
    """Conditions of prescription need a product id and 2 cells; a product may have several."""
    return _cut(source, 2, {"cis": _cell(0), "condition": _cell(1)}, F.length("cis") == 8)


def availability(source: DataFrame) -> Parsed:
    """States of availability need 4 cells and the id of a product, of a package, or both; the state of an unknown code is its label."""
    columns = {"cis": F.coalesce(_cell(0), F.lit("")), "cip13": F.coalesce(_cell(1), F.lit("")), "state": F.coalesce(labels.availability(_cell(2)), _cell(3)), "since": _cell(4), "until": _cell(5)}
    return _cut(source, 4, columns, (F.length("cis") == 8) | (F.length("cip13") == 13))
