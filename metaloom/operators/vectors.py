"""Exact vector search: order is by distance, never by score, which is 0 for all that is far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gap, F.lit(0.0), lambda n, x: n + x)


def score(distance: Column) -> Column:
    return F.lit(1.0) - F.least(distance, F.lit(1.0))


def nearest(rows: DataFrame, vector: str, query: list[float] | DataFrame, key: str, k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to a vector, filtered first; ties to the smaller key. Each task keeps its own k rows.

    A query given as a DataFrame must be one row with a column `query`.
    """
    if where is not None:
        rows = rows.where(where)
    if isinstance(query, DataFrame):
        rows = rows.join(F.broadcast(query.limit(1)))
        own = F.col("query")
    else:
        own = F.array(*(F.lit(float(x)) for x in query))
    rated = rows.withColumn("distance", squared_l2(F.col(vector), own)).withColumn("score", score(F.col("distance")))
    return rated.orderBy("distance", key).limit(k)


def hybrid(rows: DataFrame, vector: str, content: str, query_text: str, query: list[float] | DataFrame, key: str, k: int, where: Column | None = None) -> DataFrame:
    """A one-word query must stand in the content; a longer one goes by distance alone."""
    if len(query_text.split()) == 1:
        own = F.contains(F.col(content), F.lit(query_text.strip()))
        where = own if where is None else where & own
    return nearest(rows, vector, query, key, k, where)
