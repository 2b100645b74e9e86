"""Search in lines of text, with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import padded, words_of


def grep(rows: DataFrame, keys: list[str], text: str, pattern: str, case_sensitive: bool = False, around: int = 2) -> DataFrame:
    """keys, line (from 1), content (trimmed), context of each line that holds the pattern.

    Texts without the pattern are dropped before they are cut into lines, and the context is sliced
    from the text's own array of lines, so there is neither a shuffle nor a window.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    part = F.lit(pattern if case_sensitive else pattern.lower())
    hit = rows.where(F.contains(fold(F.col(text)), part)).select(*keys, F.split(F.col(text), "\n").alias("_lines"))
    found = F.filter(F.transform("_lines", lambda x, i: F.when(F.contains(fold(x), part), i)), lambda i: i.isNotNull())
    low = F.greatest(F.lit(1), F.col("_at") + 1 - around)
    near = F.slice("_lines", low, F.col("_at") + 2 + around - low)
    each = hit.where(F.lit(pattern != "")).select(*keys, "_lines", F.explode(found).alias("_at"))
    return each.select(*keys, (F.col("_at") + 1).alias("line"), F.trim(F.get("_lines", F.col("_at"))).alias("content"), F.array_join(near, "\n").alias("context"))


def token_prefix(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows with a word that begins as the query's only word does, or with all of its words."""
    wanted = words_of(query)
    if not wanted:
        return rows.where(F.lit(False))
    own = padded(F.col(text))
    if len(wanted) == 1:
        return rows.where(F.contains(own, F.lit(" " + wanted[0])))
    for w in wanted:
        rows = rows.where(F.contains(own, F.lit(f" {w} ")))
    return rows


def phrase(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows in which the query's words stand side by side."""
    wanted = words_of(query)
    return rows.where(F.contains(padded(F.col(text)), F.lit(" " + " ".join(wanted) + " ")) if wanted else F.lit(False))


def running(rows: DataFrame, keys: list[str], order: str, marker: Column, name: str) -> DataFrame:
    """The last marker that isn't null, up to each row of its group."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(over))


def mined(rows: DataFrame, keys: list[str], text: str, pattern: str, group: int, name: str) -> DataFrame:
    """keys, name: each different match of a pattern in a text."""
    return rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))).alias(name))
