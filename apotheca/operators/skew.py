"""Joins of rows with their groups where one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], members: str) -> DataFrame:
    """``rows`` joined with one row per key; ``members`` is a column of ``groups`` with the number of a key's rows.

    Groups of more than a thousandth of all rows, of which there are less than a thousand, are broadcast, so their rows stay
    where they are; the others are joined by a shuffle in which no key has more than that share, and are never sent through the driver.
    """
    total = groups.agg(F.sum(members)).first()[0] or 0
    least = max(total // 1000, 1)
    large, others = groups.filter(F.col(members) > least), groups.filter(F.col(members) <= least)
    common = rows.join(F.broadcast(large), keys)
    return common.unionByName(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(others.hint("merge"), keys))
