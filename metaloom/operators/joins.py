"""Joins that need a plan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, first: Column, second: Column, distinct_on: list[str]) -> DataFrame:
    """Rows that meet by the first condition, or else by the second: two equi-joins and a distinct instead of a nested loop."""
    both = left.join(right, first).unionByName(left.join(right, second))
    return both.dropDuplicates(distinct_on)


def resolve_least(rows: DataFrame, targets: DataFrame, keys: list[str], target: str, name: str) -> DataFrame:
    """Left join to the least target of each key: what a correlated LIMIT 1 means, with a fixed choice."""
    least = targets.groupBy(*keys).agg(F.min(target).alias(name))
    return rows.join(least, keys, "left")


def within(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, width: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Points inside spans [start, end]: each span is covered by dyadic blocks and each point named by the blocks it lies in, which are joined by equality.

    Blocks are powers of two times `width`, which is best near the usual length of spans. A span of n widths is at most
    2 * log2(n) + 2 blocks, and a point lies in one block of each size that spans may have, so a span over all points stays
    logarithmic. Columns must be numeric; spans with an end before their start, or without one of both, hold nothing.
    Extra equality keys may be given.
    """
    whole = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    real = spans.where(F.col(start) <= F.col(end))
    longest = real.agg(F.max(whole(end) - whole(start) + 1)).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))
    cut = real.withColumn("_block", F.explode(_cover(whole(start), whole(end) + 1, longest.bit_length() - 1)))
    named = points.withColumn("_block", F.explode(F.transform(levels, lambda n: F.struct(n.alias("level"), _half(whole(at), n).alias("at")))))
    return named.join(cut, ["_block", *(keys or [])]).where(F.col(at).between(F.col(start), F.col(end))).drop("_block")


def _cover(low: Column, high: Column, most: int) -> Column:
    """Blocks (level, at) of whole numbers from low to below high: from the bottom up, the odd one on the left and the one before an odd end."""
    kind = "struct<low:bigint,high:bigint,blocks:array<struct<level:int,at:bigint>>>"
    start = F.struct(low.alias("low"), high.alias("high"), F.array().cast("array<struct<level:int,at:bigint>>").alias("blocks"))

    def step(s: Column, level: Column) -> Column:
        a, b, block = s["low"], s["high"], lambda x: F.struct(level.cast("int").alias("level"), x.cast("bigint").alias("at"))
        left, right = (a < b) & (F.pmod(a, F.lit(2)) == 1), (a < b) & (F.pmod(b, F.lit(2)) == 1)
        a2, b2 = a + left.cast("bigint"), b - right.cast("bigint")
        none = F.array().cast("array<struct<level:int,at:bigint>>")
        added = F.concat(s["blocks"], F.when(left, F.array(block(a))).otherwise(none), F.when(right & (a2 <= b2), F.array(block(b2))).otherwise(none))
        return F.struct(_half(a2, F.lit(1)).alias("low"), _half(b2, F.lit(1)).alias("high"), added.alias("blocks")).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step, lambda s: s["blocks"])


def _half(number: Column, times: Column) -> Column:
    """Halved and rounded down so often."""
    return F.call_function("shiftright", number, times)
