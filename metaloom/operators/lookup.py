"""Lookups by name: exact, by words, by substring; references; membership; verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words, words_of


def folded(column: str | Column) -> Column:
    """Case doesn't count, in any alphabet."""
    return F.lower(F.col(column) if isinstance(column, str) else column)


def find_exact(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.where(folded(column) == name.lower())


def has_substring(column: str | Column, part: str) -> Column:
    """The part taken literally, whatever characters it has."""
    return F.contains(folded(column), F.lit(part.lower()))


def has_words(columns: list[str], query: str) -> Column:
    """All words of the query stand in the columns; the only word of a one-word query may be a beginning."""
    wanted = words_of(query)
    if not wanted:
        return F.lit(False)
    padded = F.concat(F.lit(" "), F.array_join(words(F.concat_ws(" ", *columns)), " "), F.lit(" "))
    if len(wanted) == 1:
        return F.contains(padded, F.lit(" " + wanted[0]))
    return reduce(lambda a, b: a & b, (F.contains(padded, F.lit(f" {w} ")) for w in wanted))


def find_tiered(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows of the best tier that has any: 0 exact name, 1 words, 2 substring. One scan: the tier is a column, its minimum a one-row aggregate."""
    tier = F.when(folded(column) == query.lower(), 0).when(has_words([column], query), 1).when(has_substring(column, query), 2)
    tagged = rows.withColumn("tier", tier).where("tier is not null")
    best = tagged.agg(F.min("tier").alias("best"))
    return tagged.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def search_metadata(objects: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Word search over name, synonym and full name; the first by full name."""
    return objects.where(has_words(["name", "synonym", "full_name"], query)).orderBy("full_name").limit(limit)


def contains_any(rows: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    tests = [has_substring(c, p) for c in columns for p in parts]
    return rows.where(reduce(lambda a, b: a | b, tests))


def only_in(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of left whose key right doesn't have."""
    keys = right.select(F.col(other or key).alias(key))
    return left.join(keys, key, "left_anti")


def also_in(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    keys = right.select(F.col(other or key).alias(key))
    return left.join(keys, key, "left_semi")
