"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask picks some of the tokens in a row and ignores the others, so a hit survives substitutions
at ignored places. Seeds of documents join seeds of benchmark items; a hit names a diagonal
(document position less item position), and on each diagonal the tokens are compared one by one:
the item is found if a window of `window` of its tokens (all, if it has fewer) agrees in
`agree` of them.

Masks are lighter for shorter items. Whichever places of a window are substituted, as many as the
default `window` and `agree` allow, one of the masks of its tier fits between them, so no passage
that agrees enough is missed; a test enumerates all substitutions. Tiers without items cost nothing.

The item side is broadcast only below `broadcast_rows` seeds; beyond, both sides are shuffled.

Defined results: null texts are empty; items of fewer than `SHORT` tokens can't be told from
chance and match nothing; null ids are kept as such; repeated documents are each reported,
repeated items of one id count once each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_of

TOKEN = "[\\p{L}\\p{N}]+"
SHORT = 5
#: Least tokens of an item and its masks: offsets of the tokens that a mask looks at; the first is looked at by all.
TIERS = (
    (20, ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 1, 2, 4, 5, 6))),
    (15, ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4))),
    (SHORT, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))),
)


@dataclass(frozen=True)
class Settings:
    window: int = 20
    agree: float = 0.8
    broadcast_rows: int = 1_000_000

    def __post_init__(self):
        if self.window != 20 or not 0.8 <= self.agree <= 1:
            raise ValueError("the masks find all passages for windows of 20 tokens of which 80 % or more agree, and for no others")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def seeds(rows: DataFrame, keys: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """keys, at, mask, seed: a row for each mask and position of the array column `h`; no seed where the mask reaches beyond it.

    Shifted slices are zipped and inlined, so each position is a flat row of longs and
    the seeds are plain compiled expressions.
    """
    offsets = sorted({o for m in masks for o in m})
    shifted = rows.where(F.size("h") > min(max(m) for m in masks)).select(*keys, *(F.slice("h", o + 1, F.size("h")).alias(f"h{o}") for o in offsets))
    flat = shifted.select(*keys, F.posexplode(F.arrays_zip(*(f"h{o}" for o in offsets))).alias("at", "z"))
    of = lambda m: F.when(F.col(f"z.h{max(m)}").isNotNull(), F.xxhash64(*(F.col(f"z.h{o}") for o in m)))
    flat = flat.select(*keys, "at", *(of(m).alias(f"s{i}") for i, m in enumerate(masks)))
    each = F.posexplode(F.array(*(f"s{i}" for i in range(len(masks)))))
    return flat.select(*keys, "at", each.alias("mask", "seed")).where("seed is not null")


def overlaps(documents: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, item_id, agreed (most agreeing tokens of a window) for each document and item found in it."""
    found = _found(documents, benchmark, settings or Settings())
    return found.groupBy("doc_id", "item_id").agg(F.max("agreed").alias("agreed"))


def _found(documents: DataFrame, benchmark: DataFrame, s: Settings) -> DataFrame:
    """doc_id, doc_key (hash of the text), item_id, agreed: a row for each diagonal that is found."""
    items = keep(benchmark.select("item_id", F.xxhash64(text_of()).alias("item_key"), tokens(text_of()).alias("item")).distinct(), "items")
    docs = documents.select("doc_id", F.xxhash64(text_of()).alias("doc_key"), tokens(text_of()).alias("h"))
    hits = keep(_hits(docs, items, s).distinct(), "hits")
    # the texts are tokenised again for documents with hits alone
    hit_docs = keep(hits.select(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key")).distinct(), "hit_docs")
    again = documents.select("doc_id", text_of().alias("text")).withColumn("doc_key", F.xxhash64("text"))
    again = again.join(_small(hit_docs, s), F.expr("doc_id <=> hit_id and doc_key = hit_key")).select("doc_id", "doc_key", tokens(F.col("text")).alias("h"))
    return _verified(hits, again, items, s)


def _small(side: DataFrame, s: Settings) -> DataFrame:
    return F.broadcast(side) if side.limit(s.broadcast_rows + 1).count() <= s.broadcast_rows else side


def _hits(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """doc_id, doc_key, item_id, item_key, diagonal of equal seeds, with the masks of those tiers that have items."""
    sizes = F.size("item")
    tier = reduce(lambda c, t: c.when(sizes >= TIERS[t][0], t), range(1, len(TIERS)), F.when(sizes >= TIERS[0][0], 0))
    tiered = items.withColumn("tier", tier)
    present = sorted(r["tier"] for r in tiered.where("tier is not null").select("tier").distinct().collect()) or [0]
    masks = tuple(m for t in present for m in TIERS[t][1])
    wanted, first = [], 0
    for t in present:
        of_tier = seeds(tiered.where(F.col("tier") == t).select("item_id", "item_key", F.col("item").alias("h")), ["item_id", "item_key"], TIERS[t][1])
        wanted.append(of_tier.select("item_id", "item_key", F.col("at").alias("item_at"), (F.col("mask") + first).alias("mask"), "seed"))
        first += len(TIERS[t][1])
    found = seeds(docs, ["doc_id", "doc_key"], masks).join(_small(keep(reduce(DataFrame.unionByName, wanted), "item_seeds"), s), ["seed", "mask"])
    return found.select("doc_id", "doc_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))


def _verified(hits: DataFrame, docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    of_item = items.select(F.col("item_id").alias("i_id"), F.col("item_key").alias("i_key"), "item")
    of_doc = docs.select(F.col("doc_id").alias("d_id"), F.col("doc_key").alias("d_key"), "h")
    both = hits.join(_small(of_item, s), F.expr("item_id <=> i_id and item_key = i_key")).join(of_doc, F.expr("doc_id <=> d_id and doc_key = d_key"))
    equal = F.expr("transform(item, (t, i) -> cast(diagonal + i >= 0 and get(h, cast(diagonal + i as int)) <=> t as int))")
    window = F.least(F.lit(s.window), F.size("item"))
    best = F.expr("array_max(transform(sequence(1, size(item) - wide + 1), i -> aggregate(slice(same, i, wide), 0, (n, x) -> n + x)))")
    rated = both.select("doc_id", "doc_key", "item_id", "item", window.alias("wide"), equal.alias("same")).withColumn("agreed", best)
    return rated.where(F.col("agreed") >= F.ceil(F.col("wide") * F.lit(s.agree))).select("doc_id", "doc_key", "item_id", "agreed")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents in which no item is found, with their own columns. Of rows that share a doc_id (or have none) only those with a found text go."""
    s = settings or Settings()
    found = keep(_found(documents, benchmark, s).select(F.col("doc_id").alias("found_id"), F.col("doc_key").alias("found_key")).distinct(), "found")
    return documents.join(_small(found, s), F.expr("doc_id <=> found_id") & (F.xxhash64(text_of()) == F.col("found_key")), "left_anti")
