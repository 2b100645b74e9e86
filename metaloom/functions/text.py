"""Column functions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+"


def words(column: Column) -> Column:
    """Runs of letters and digits in lower case, as an index would store them."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def words_of(text: str) -> list[str]:
    """The same for a text at hand."""
    return re.findall(r"[^\W_]+", text.lower())


def padded(column: Column) -> Column:
    """Words with single blanks between and around them: a phrase is a substring of it."""
    return F.concat(F.lit(" "), F.array_join(words(column), " "), F.lit(" "))


def shortened(column: Column, most: int, marker: str) -> Column:
    return F.when(F.length(column) > most, F.concat(F.left(column, F.lit(most)), F.lit(marker))).otherwise(column)


def collapsed(column: Column, most: int = 200) -> Column:
    """Blanks in a row become one; cut to a length."""
    return F.left(F.trim(F.regexp_replace(column, "\\s+", " ")), F.lit(most))


def params_of(column: Column) -> Column:
    """Names of parameters of a list as written: by-value marks and defaults are left out."""
    bare = lambda p: F.trim(F.regexp_extract(F.regexp_replace(F.trim(p), "^(?:Знач|знач|Val|val)\\s+", ""), "^[^=]*", 0))
    return F.filter(F.transform(F.split(column, ","), bare), lambda p: p != "")


def handler_of(column: Column) -> Column:
    """The last two parts of a dotted handler as module and method."""
    parts = F.filter(F.split(F.replace(column, F.lit(" ")), "\\."), lambda p: p != "")
    module = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    method = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.struct(module.alias("module"), method.alias("method"))
