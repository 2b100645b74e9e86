"""Ids from natural keys, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_id(path: str) -> Column:
    return F.xxhash64(F.col(path))


def symbol_id(path: str, name: str, line: str) -> Column:
    return F.xxhash64(F.col(path), F.col(name), F.col(line))


def vector_id(source: Column, name: Column, index: Column, prefix: str = "fn_") -> Column:
    """A prefix and 32 hex digits of the source, name and chunk number. Nulls count as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("::", part(source), part(name), part(index)), 256), 1, 32))
