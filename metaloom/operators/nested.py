"""Children collected into arrays of their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, most: int | None = None) -> DataFrame:
    """keys, name (values in order, the first `most`), n (how many there are).

    With a bound only the first rows of each group are collected: a window filter that Spark turns
    into a limit per group before the shuffle.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("_value")))), lambda x: x["_value"]).alias(name)
    tagged = rows.select(*keys, *[c for c in order if c not in keys], value.alias("_value"))
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("n"))
    if most is not None:
        place = f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)})"
        tagged = tagged.withColumn("_place", F.expr(place)).where(F.col("_place") <= most)
    return tagged.groupBy(*keys).agg(listed).join(counts, keys)


def distinct_ordered(rows: DataFrame, keys: list[str], order: str, value: str, name: str, most: int | None = None) -> DataFrame:
    """keys, name: the different values by their first place in order, the first `most` of them or all."""
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    if most is not None:  # ranked before they are collected, so that a hub's list is never built whole
        place = f"row_number() over (partition by {', '.join(keys)} order by _first, {value})"
        firsts = firsts.withColumn("_place", F.expr(place)).where(F.col("_place") <= most)
    return firsts.groupBy(*keys).agg(listed.alias(name))
