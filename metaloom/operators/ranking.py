"""Choices by order: best of a group, first and last writes, budgets, rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark limits each task to its own first rows before the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def last_write_wins(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    return best_of(rows, keys, [F.desc(c) for c in sequence])


def first_write_wins(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    return best_of(rows, keys, [F.asc(c) for c in sequence])


def within_budget(rows: DataFrame, order: list[Column], limit: int, size: Column, budget: int) -> DataFrame:
    """The first rows in order, `limit` at most, as long as their sizes add up to no more than the budget; one row at least.

    The limit comes first, so the running sum is over that many rows.
    """
    top = rows.orderBy(*order).limit(limit)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = top.withColumn("used", F.sum(size).over(running)).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return spent.where((F.col("used") <= budget) | (F.col("place") == 1))


def fuse(lists: list[DataFrame], key: str, rank: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over lists, ranks from 0; rows without a key are left out."""
    tagged = [df.where(F.col(key).isNotNull()).select(key, F.col(rank).alias("_rank"), F.lit(i).alias("_list")) for i, df in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("_rank"))).alias("score"), F.min("_list").alias("first_list"))


def ranked(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows with their places from 0; only `limit` rows reach the window."""
    top = rows.orderBy(*order).limit(limit)
    return top.select(key, (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))
