"""An inverted index as files: words with their positions, or trigrams, for search without reading texts.

One row holds a token's positions in one document. Rows lie in folders by bucket, a hash of the token's first
letters, sorted by token: a lookup reads the folders of its tokens alone (partition pruning), and of their
files the row groups whose range holds them (pushed filters). Within a bucket rows are dealt by document too,
so that a token which a third of all documents hold is neither written nor read by one task.

An index is a list of segments that never change. An update writes one with the postings of new
texts and the ids that are gone; what is gone counts for all segments before it. So a reader of an
older list isn't disturbed, and `compacted` writes all that counts as one segment.

Texts are kept beside the postings, in folders by document, for the check that follows a search by
trigrams and for lines around a hit: the folders are pruned at run time by the documents found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words, words_of
from ..plans.shared import keep

#: Stands after a text, so that its last letters begin trigrams too.
END = "\u0000"
LAST = "\U0010ffff"


@dataclass(frozen=True)
class Settings:
    buckets: int = 32
    #: Letters that choose a token's bucket; a search by a beginning of so many letters reads one bucket.
    letters: int = 3
    slots: int = 4
    text_parts: int = 32
    #: Trigrams of a needle that are looked up: the rarest.
    grams: int = 3
    #: Ids that are broadcast; beyond, they are joined by a shuffle.
    broadcast_ids: int = 500_000


class Postings:
    """kind `words` or `trigrams`; documents are named by a long id, `doc`."""

    def __init__(self, spark: SparkSession, kind: str, segments: tuple[str, ...], settings: Settings | None = None):
        self.spark, self.kind, self.segments, self.s = spark, kind, segments, settings or Settings()
        self._gone: dict[int, DataFrame] = {}

    # writing

    @classmethod
    def write(cls, texts: DataFrame, kind: str, folder: str, settings: Settings | None = None) -> Postings:
        """A new index of texts (doc, text and columns that go along)."""
        return cls(texts.sparkSession, kind, (), settings).updated(texts, None, folder)

    def updated(self, texts: DataFrame, gone: DataFrame | None, folder: str) -> Postings:
        """With the texts added, and without the documents of `gone` (doc) or what was known of these texts. Ids are unique; texts without one are left out."""
        texts = texts.where("doc is not null")
        out = texts.select("doc") if gone is None else gone.select("doc").unionByName(texts.select("doc"))
        tokens = tokens_of(texts, self.kind).withColumn("bucket", self._bucket(F.col("token")))
        slot = F.pmod(F.xxhash64("doc"), F.lit(self.s.slots))
        if self.kind == "words":
            postings = _in_order(tokens.withColumn("slot", slot).repartition("bucket", "slot")).select("bucket", "token", "doc", "positions")
            with _by_sorting(self.spark):
                _placed(postings, "bucket", ["bucket", "token", "doc"], f"{folder}/postings")
        else:
            _once(tokens, slot).write.partitionBy("bucket").parquet(f"{folder}/postings")
        kept = texts.withColumn("part", self._part(F.col("doc"))).repartition("part")
        _placed(kept, "part", ["part", "doc"], f"{folder}/texts")
        out.distinct().write.parquet(f"{folder}/gone")
        if self.kind == "trigrams":  # the rarest are looked for, of words all
            self._count(folder)
        return Postings(self.spark, self.kind, (*self.segments, folder), self.s)

    def _count(self, folder: str) -> None:
        written = self.spark.read.schema("token string, bucket int").parquet(f"{folder}/postings")  # not the plan, which would cut the texts again
        counts = written.groupBy("bucket", "token").agg(F.count("*").alias("docs"))
        _placed(counts, "bucket", ["bucket", "token"], f"{folder}/counts")

    def compacted(self, folder: str) -> Postings:
        return Postings.write(self.texts().drop("part"), self.kind, folder, self.s)

    # reading

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(F.left(token, F.lit(self.s.letters))), F.lit(self.s.buckets)).cast("int")

    def _part(self, doc: Column) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(self.s.text_parts)).cast("int")

    def _small(self, ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(self.s.broadcast_ids + 1).count() <= self.s.broadcast_ids else ids

    def _living(self, name: str, where: Column | None = None) -> DataFrame:
        """Rows of a table over all segments, less what later segments say is gone."""
        rows = []
        for n, folder in enumerate(self.segments):
            own = self.spark.read.parquet(f"{folder}/{name}")
            own = own if where is None else own.where(where)
            rows.append(own.join(self._later(n), "doc", "left_anti") if n + 1 < len(self.segments) else own)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)

    def _later(self, n: int) -> DataFrame:
        """What segments after the n-th say is gone; looked at once, for segments don't change."""
        if n not in self._gone:
            later = [self.spark.read.parquet(f"{f}/gone") for f in self.segments[n + 1 :]]
            self._gone[n] = self._small(reduce(DataFrame.unionByName, later).distinct())
        return self._gone[n]

    def texts(self) -> DataFrame:
        return self._living("texts")

    def texts_of(self, found: DataFrame) -> DataFrame:
        """The texts of documents (doc); folders without one are not read. The search is run once: its ids are kept, then counted."""
        ids = keep(found.select("doc", self._part(F.col("doc")).alias("part")), "found")
        return self._living("texts").join(self._small(ids), ["part", "doc"], "left_semi").drop("part")

    def _in(self, tokens: list[str]) -> Column:
        """In a bucket of one of these tokens: constants, so that only their folders are listed."""
        return reduce(lambda a, b: a | b, (F.col("bucket") == self._bucket(F.lit(t)) for t in sorted({t[: self.s.letters] for t in tokens})))

    def of_tokens(self, tokens: list[str]) -> DataFrame:
        """token, doc, positions of these tokens."""
        return self._living("postings", self._in(tokens) & F.col("token").isin(tokens)).select("token", "doc", "positions")

    def starting(self, beginning: str) -> DataFrame:
        """doc of documents with a token that begins so. Shorter beginnings than a bucket's read all buckets, but only their range of each."""
        where = (F.col("token") >= beginning) & (F.col("token") < beginning + LAST) & F.startswith("token", F.lit(beginning))
        if len(beginning) >= self.s.letters:
            where = self._in([beginning]) & where
        return self._living("postings", where).select("doc").distinct()

    def all_of(self, tokens: list[str]) -> DataFrame:
        wanted = sorted(set(tokens))
        return self.of_tokens(wanted).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("doc")

    def phrase(self, tokens: list[str]) -> DataFrame:
        """doc of documents where the tokens stand side by side: each token's positions, moved back by its place in the phrase, must share one."""
        rows = self.of_tokens(sorted(set(tokens)))
        moved = F.array(*(F.struct(F.lit(n).alias("place"), F.lit(t).alias("t")) for n, t in enumerate(tokens)))
        each = rows.select("doc", "positions", "token", F.explode(moved).alias("m")).where("m.t = token")
        starts = each.select("doc", "m.place", F.transform("positions", lambda p: p - F.col("m.place")).alias("starts"))
        met = starts.groupBy("doc").agg(F.collect_list("starts").alias("all")).where(F.size("all") == len(tokens))
        shared = F.aggregate(F.slice("all", 2, len(tokens)), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return met.where(F.size(shared) > 0).select("doc")

    # searches

    def words(self, pattern: str) -> DataFrame:
        """The texts with a word that begins as the only word of a pattern does, or with the phrase of its words; all, if it has no letter or digit."""
        parts = re.findall(r"\w+", pattern)
        if not parts:
            return self.texts().drop("part")
        wanted = words_of(pattern)
        if not wanted:
            return self.texts().where(F.lit(False)).drop("part")
        return self.texts_of(self.starting(wanted[0]) if len(parts) == 1 and "_" not in parts[0] else self.phrase(wanted))

    def containing(self, needle: str) -> DataFrame:
        """The texts that contain a needle whatever its case: candidates by its rarest trigrams, then the texts themselves."""
        part = needle.lower()
        if not part:
            return self.texts().drop("part")
        grams = sorted({part[i : i + 3] for i in range(len(part) - 2)})
        found = self.all_of(self._rarest(grams)) if grams else self.starting(part)
        return self.texts_of(found).where(F.contains(F.lower("text"), F.lit(part)))

    def _rarest(self, grams: list[str]) -> list[str]:
        """By the documents that have them in all segments; a trigram that none has is the rarest."""
        if len(grams) <= self.s.grams:
            return grams
        rows = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{f}/counts").where(self._in(grams) & F.col("token").isin(grams)).select("token", "docs") for f in self.segments))
        known = {r["token"]: r["docs"] for r in rows.groupBy("token").agg(F.sum("docs").alias("docs")).collect()}  # as many rows as the needle has trigrams
        return sorted(grams, key=lambda g: (known.get(g, 0), g))[: self.s.grams]


def tokens_of(texts: DataFrame, kind: str) -> DataFrame:
    """doc, pos, token: words of letters and digits, or each trigram's first place."""
    rows = texts.where("doc is not null and text is not null")
    if kind == "words":
        return rows.select("doc", F.posexplode(words(F.col("text"))).alias("pos", "token"))
    grams = F.regexp_extract_all(F.concat(F.lower("text"), F.lit(END + END)), F.lit("(?s)(?=(.{3}))."), F.lit(1))
    return rows.select("doc", F.lit(0).alias("pos"), F.explode(F.array_distinct(grams)).alias("token"))


def _in_order(rows: DataFrame) -> DataFrame:
    """bucket, token, doc, slot, positions of rows dealt by bucket and slot: one sort serves the grouping and the file."""
    keys = ["bucket", "token", "doc", "slot"]
    return rows.sortWithinPartitions(*keys, "pos").groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _once(rows: DataFrame, slot: Column) -> DataFrame:
    """bucket, token, doc, positions, dealt and in order, of tokens that come once in a text: what is the same in all rows is neither shuffled nor sorted."""
    dealt = rows.select("bucket", "token", "doc").repartition("bucket", slot)
    return dealt.sortWithinPartitions("bucket", "token", "doc").select("bucket", "token", "doc", F.array(F.lit(0)).alias("positions"))


@contextmanager
def _by_sorting(spark: SparkSession) -> Iterator[None]:
    """Within, lists are collected from sorted rows as they come, not in a hash table that gives up after some keys and sorts again."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _placed(rows: DataFrame, folder: str, order: list[str], path: str) -> None:
    rows.sortWithinPartitions(*order).write.partitionBy(folder).parquet(path)
