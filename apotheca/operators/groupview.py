"""Views of one group or cluster: headers, prices, refunds, conditions, lists and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.functions.text import ColumnOrName, as_column
from apotheca.operators.catalogue import ranked


def sorted_set(x: ColumnOrName) -> Column:
    """Distinct values that aren't blank, trimmed and sorted."""
    return F.sort_array(F.collect_set(text.nonblank(x)))


def header(rows: DataFrame, key: str, dosage: str, form: str, *titles: str) -> DataFrame:
    """Per group: dosages, forms, and the first title that any row has."""
    chosen = F.coalesce(*(F.min(text.nonblank(t)) for t in titles))
    return rows.groupBy(key).agg(F.array_join(sorted_set(dosage), ", ").alias("dosages"), F.array_join(sorted_set(form), ", ").alias("forms"), chosen.alias("title"))


def price_range(rows: DataFrame, key: str, price: str) -> DataFrame:
    """Per group: lowest to highest price as text, one price if they differ by less than 0.005."""
    low, high = F.min(price), F.max(price)
    label = F.when(F.abs(high - low) < 0.005, text.euro(low)).otherwise(F.concat(text.euro(low), F.lit(" – "), text.euro(high)))
    return rows.groupBy(key).agg(label.alias("price_label"))


def in_first_seen_order(rows: DataFrame, key: str, column: ColumnOrName, pos: ColumnOrName, name: str, separator: str = " • ") -> DataFrame:
    """Per group: distinct values by the position they were first seen at, joined.

    Values are made distinct before they are gathered, so a list has a group's values and not its rows.
    """
    seen = rows.select(key, text.nonblank(column).alias("__x"), as_column(pos).alias("__pos")).groupBy(key, "__x").agg(F.min("__pos").alias("__pos"))
    found = F.array_sort(F.collect_list(F.when(F.col("__x").isNotNull(), F.struct("__pos", "__x"))))
    return seen.groupBy(key).agg(F.array_join(F.transform(found, lambda s: s["__x"]), separator).alias(name))


def split_sorted(rows: DataFrame, key: str, column: str, pattern: str = r"[,;\n]") -> DataFrame:
    """Per group: distinct parts of a delimited column, sorted."""
    parts = rows.select(key, F.explode(F.split(column, pattern)).alias("part")).select(key, text.nonblank("part").alias("part"))
    return parts.filter("part is not null").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("part")), ", ").alias("parts"))


def two_lists(rows: DataFrame, key: str, flag: str, value: str, order: str) -> DataFrame:
    """key, list (flagged or others), value and place from 1: each group's two lists in order, a row per entry.

    Places come from a sort over all tasks, so a group of any size is many tasks. A null flag counts as not flagged.
    """
    listed = rows.withColumn("list", F.when(F.col(flag), "flagged").otherwise("others"))
    return ranked(listed, [order, value], within=[key, "list"]).select(key, "list", value, F.col("rank").alias("place"))


def first_match(rows: DataFrame, key: str, condition: Column, value: str, order: str) -> DataFrame:
    """Per group: the value of the first row that meets the condition, null if none does."""
    return rows.groupBy(key).agg(F.min_by(value, F.when(condition, F.col(order))).alias("first_value"), F.max(condition).alias("__any")).select(key, F.when(F.col("__any"), F.col("first_value")).alias("first_value"))


def concat_distinct(rows: DataFrame, key: str, **columns: str) -> DataFrame:
    """Per group: distinct values of columns, sorted and comma-joined (A4, A5)."""
    return rows.groupBy(key).agg(*(F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(n) for n, c in columns.items()))


def smart_order(shortage: ColumnOrName, hospital: ColumnOrName, name: ColumnOrName) -> list[Column]:
    """No shortage first, then not for hospitals only, then by name."""
    return [F.coalesce(as_column(shortage), F.lit(False)).asc(), F.coalesce(as_column(hospital), F.lit(False)).asc(), as_column(name).asc()]


def preferred_key(preference: str, princeps: ColumnOrName, form: ColumnOrName, generic: ColumnOrName) -> Column:
    """The upper-case text that a preference sorts by."""
    return F.upper({"princeps": text.first_nonblank(princeps, generic), "form": text.first_nonblank(form, generic), "generic": text.first_nonblank(generic, princeps)}[preference])


def letter_groups(rows: DataFrame, column: str) -> DataFrame:
    """Number of rows per initial, # for what isn't a letter."""
    return rows.groupBy(text.initial(column).alias("letter")).agg(F.count("*").alias("n"))
