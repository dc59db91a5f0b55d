"""Substring search of all words, a trigram index, and BM25 ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apotheca.functions import text
from apotheca.operators.distinct import dealt
from apotheca.sources.store import materialised


def query_words(query: str, least: int = 3) -> list[str]:
    """Words of a query that a trigram index can find; shorter ones are left out."""
    return [w for w in query.split() if len(w) >= least]


def matches(column: str, query: str, fold: bool = False) -> Column:
    """All words of the query are in the text, in any order, without case; with fold also without accents (F2).

    A query without any word of three letters finds nothing.
    """
    found = query_words(query)
    if not found:
        return F.lit(False)
    source = text.normalise_search(column) if fold else F.lower(column)
    target = (lambda w: text.normalise_search(F.lit(w))) if fold else (lambda w: F.lower(F.lit(w)))
    return reduce(lambda a, b: a & b, (F.contains(source, target(w)) for w in found))


def search(rows: DataFrame, column: str, query: str, position: str, limit: int = 50, fold: bool = False) -> DataFrame:
    """The first hits by position (O2, F2); an empty query lists all by text instead."""
    if not query.strip():
        return rows.orderBy(column, position).limit(2 * limit)
    return rows.filter(matches(column, query, fold)).orderBy(position).limit(limit)


def trigrams(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Postings: trigram, key and how often it occurs there."""
    low = F.lower(column)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))
    # Many rows of short texts are a small file, and would be one task.
    held = dealt(rows.filter(F.length(column) >= 3).select(key, column)).select(key, F.explode(grams).alias("trigram"))
    return held.groupBy("trigram", key).agg(F.count("*").alias("n"))


def write_index(rows: DataFrame, key: str, column: str, path: str, files: int = 32) -> None:
    """The postings as a table, dealt and sorted by trigram, so that a search reads few of its row groups.

    A trigram that very many texts hold is dealt over all files by the key too.
    """
    postings = trigrams(rows, key, column).drop("n")
    postings.repartitionByRange(files, "trigram", key).sortWithinPartitions("trigram", key).write.parquet(path)


def search_index(index: DataFrame, rows: DataFrame, key: str, column: str, query: str, position: str, limit: int = 50) -> DataFrame:
    """The first hits by position, through the postings of ``write_index``: texts that hold all trigrams of the words are
    candidates, and only they are read whole (F2, O2)."""
    found = query_words(query)
    if not found:
        return rows.limit(0)
    grams = sorted({w.lower()[i : i + 3] for w in found for i in range(len(w) - 2)})
    candidates = index.filter(F.col("trigram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(key)
    return rows.join(candidates, key, "left_semi").filter(matches(column, query)).orderBy(position).limit(limit)


def words(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, word and count of every word of a text; counts are combined before the shuffle."""
    split = F.filter(F.split(F.lower(column), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return rows.select(key, F.explode(split).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


_BLANK = " \t\n\x0b\f\r"


def bm25(rows: DataFrame, key: str, column: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the rows that hold any query word; better matches have lower scores.

    Texts are read once, for the length and the counts of the words asked for, which are written; a word is only counted
    where the text holds its letters. Averages and document frequencies over all rows are one broadcast row.
    """
    wanted = sorted({w.lower() for w in query})
    spaced = F.concat(F.lit(" "), F.replace(reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit(" ")), _BLANK[1:], F.lower(column)), F.lit(" "), F.lit("  ")), F.lit(" "))
    texts = rows.select(key, spaced.alias("__text"))

    def count(word: str) -> Column:
        marked = f" {word} "
        gone = F.length("__text") - F.length(F.replace("__text", F.lit(marked), F.lit("")))
        return F.when(F.contains("__text", F.lit(marked)), (gone / len(marked)).cast("long")).otherwise(F.lit(0).cast("long"))

    counts = texts.select(key, F.regexp_count("__text", F.lit("[^ ]+")).alias("length"), *(count(w).alias(f"tf{i}") for i, w in enumerate(wanted)))
    counted = materialised(counts, "counts")
    frequencies = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    totals = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"), *frequencies)
    hits = counted.filter(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(wanted)))))
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean_length"))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        return F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm)

    score = -reduce(lambda x, y: x + y, (part(i) for i in range(len(wanted))))
    return hits.crossJoin(F.broadcast(totals)).select(key, score.alias("score"))
