"""Alignment of two tokenizers' tokens, relationally.

Tokens are rows (unit, place, id), windowed sums of their byte lengths give where each ends, and an equi-join on
unit and end finds the cuts that both tokenizers make. A running count of cuts names each token's group,
and a join of both sides' groups gives the links. Only the tokenizers themselves are Python.

A unit is a stretch of text between places where both tokenizers are known to cut: before a blank that
follows something else. Each different unit of the corpus is encoded and aligned once, whatever number of
texts has it, and texts are put together from their units. Where the vocabularies don't promise these
cuts (`cuts_at_blanks`), a unit is a whole text, and all else stays.

The number of documents in which a pair of ids is linked is counted over the different pairs of each
document. Units meet their documents in two ways that together cover all: the `frequent` most common short
units are broadcast, all others are joined by a shuffle, and so do pairs their units. Documents, cut once, and encoded
units are written as tables bucketed by blocks of the task that writes them, so what groups the units of a document, or
the tokens of a unit, shuffles nothing and is sorted in memory. Tables go as soon as they are read.

Defined results: null and empty texts have no tokens, nor have texts where a side's tokens don't give back
the bytes; they count zero and have '' as digest. Repeated rows and repeated or null ids are each answered, and each
counts as a document. Extra columns are not looked at. Of an empty table there are no rows.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, small_batches, text_of

#: Before a blank that follows anything but white space and isn't the last character.
CUT = "(?Us)(?<=\\S)(?= .)"
#: Id of A and id of B in one number.
SHIFT = 1 << 24


@dataclass(frozen=True)
class Settings:
    #: At most so many units are broadcast, of so many bytes each at most.
    frequent: int = 1 << 19
    frequent_bytes: int = 64
    #: Blocks of documents to a task that reads them; units to a block.
    blocks: int = 8
    block_units: int = 1 << 15


# the tokenizers


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, all other bytes for those from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def _byte_level(path: str):
    """A tokenizer and the bytes of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = {c: b for b, c in _alphabet().items()}
    return tokenizer, {i: bytes(of[c] for c in token) for token, i in tokenizer.get_vocab(with_added_tokens=False).items()}


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    """A tokenizer and the bytes of its ids."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    named = lambda i: bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    return p, {i: named(i) for i in range(p.get_piece_size())}


def cuts_at_blanks(a_path: str, b_path: str) -> bool:
    """Whether both vocabularies are bound to cut at CUT: A splits by its pattern and changes nothing before, and no piece of B has a blank after anything else."""
    tokenizer, _ = _byte_level(a_path)
    pieces, _ = _pieces(b_path)
    splits = tokenizer.normalizer is None and getattr(tokenizer.pre_tokenizer, "use_regex", False)
    return splits and not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))


def encoded(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """ok, a_ids, a_sizes, b_ids, b_sizes beside the columns of units (unit, ..); a unit that doesn't come back in bytes has ok false and no tokens."""
    small_batches(units.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, a_bytes), (b, b_bytes) = _byte_level(a_path), _pieces(b_path)
        for batch in batches:
            texts = batch.column("unit").to_pylist()
            a_ids = [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
            b_ids = b.encode([t[1:] for t in texts], num_threads=1)
            ok, sizes = [], ([], [])
            for n, t in enumerate(texts):
                both = [a_bytes.get(i, b"") for i in a_ids[n]], [b_bytes[i] for i in b_ids[n]]
                want = t.encode()
                fine = b"".join(both[0]) == want == b"".join(both[1])
                ok.append(fine)
                if not fine:
                    a_ids[n], b_ids[n], both = [], [], ([], [])
                for side, tokens in zip(sizes, both):
                    side.append([len(x) for x in tokens])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), *(pa.array(x, ints) for x in (a_ids, sizes[0], b_ids, sizes[1]))], names=[*batch.schema.names, *found])

    found = {"ok": "boolean", "a_ids": "array<int>", "a_sizes": "array<int>", "b_ids": "array<int>", "b_sizes": "array<int>"}
    return units.mapInArrow(encode, ", ".join(f"{name} {kind}" for name, kind in (dict(units.dtypes) | found).items()))


# the alignment of units


@contextmanager
def _as_dealt(spark: SparkSession):
    """Within, rows are joined, windowed and grouped where they lie, if they lie by some of the keys; and tables are read by their buckets."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    with _set(spark, wanted):
        tables: dict[str, str] = {}
        try:
            yield tables
        finally:
            _drop(spark, tables, *tables)


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]):
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _held(rows: DataFrame, tables: dict[str, str], name: str, blocks: int = 0) -> DataFrame:
    """The rows as a table until it is dropped. With blocks each writing task deals its rows into so many blocks (`task`), by which the table is bucketed:
    nothing is shuffled then, nor is whatever is grouped by task and more keys later, and a block is small enough to be sorted in memory."""
    tables[name] = full = f"alignment_{name}_{uuid.uuid4().hex[:12]}"
    if blocks:
        n = min(max(rows.rdd.getNumPartitions(), 1) * blocks, 50_000)
        rows = rows.withColumn("task", F.spark_partition_id() * blocks + F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
        rows.write.option("compression", "zstd").bucketBy(n, "task").saveAsTable(full)
    else:
        rows.write.option("compression", "zstd").saveAsTable(full)
    return rows.sparkSession.table(full)


def _drop(spark: SparkSession, tables: dict[str, str], *names: str) -> None:
    """What is read no more leaves the disk at once: the tables, and the shuffles that made them, which Spark deletes when the driver collects its garbage."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop(name)}")
    spark._jvm.System.gc()


def tokens(rows: DataFrame, side: str) -> DataFrame:
    """task, no, place, id, end: a row for each token of a side, with the byte at which it ends. A task's units count as one text, in the order of `no`:
    where one ends both sides cut, so windows and joins have as many groups as there are tasks."""
    each = rows.select("task", "no", F.posexplode(F.arrays_zip(F.col(f"{side}_ids").alias("id"), F.col(f"{side}_sizes").alias("size"))).alias("place", "t"))
    so_far = Window.partitionBy("task").orderBy("no", "place").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("task", "no", "place", "t.id", F.sum("t.size").over(so_far).alias("end"))


def grouped(mine: DataFrame, other: DataFrame) -> DataFrame:
    """task, no, part, place, id: tokens with the number of cuts before them. A cut is an end that the other side has too.
    Ends are in the order of places, and the join has put the rows in theirs."""
    cut = mine.join(other.select("task", "end", F.lit(1).alias("cut")).hint("merge"), ["task", "end"], "left")
    before = Window.partitionBy("task").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("task", "no", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("part"), "place", "id")


def parts_of(tokens: DataFrame, side: str) -> DataFrame:
    """task, no, part and the side's ids there, in order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return tokens.groupBy("task", "no", "part").agg(ids.alias(side))


def links_of(a: str, b: str) -> Column:
    """(pair, times) of a group's ids. Equal ids are counted before the sides meet, so n tokens make no n * n links unless all differ."""
    link = lambda x, y, times: F.struct((x.cast("long") * F.lit(SHIFT) + y).alias("pair"), times.cast("long").alias("times"))
    times = lambda side, x: F.size(F.filter(side, lambda y: y == x))
    many = F.flatten(F.transform(F.array_distinct(a), lambda x: F.transform(F.array_distinct(b), lambda y: link(x, y, times(a, x).cast("long") * times(b, y)))))
    return F.when((F.size(a) == 1) & (F.size(b) == 1), F.array(link(F.get(a, F.lit(0)), F.get(b, F.lit(0)), F.lit(1)))).otherwise(many)


def aligned(rows: DataFrame) -> DataFrame:
    """For encoded units (task, no, ..): n_a, n_b, n_groups, n_links, groups, and links, the pairs of ids linked in each group with their times."""
    fine = rows.where("ok")
    ends = {s: tokens(fine, s) for s in "ab"}
    both = parts_of(grouped(ends["a"], ends["b"]), "a").join(parts_of(grouped(ends["b"], ends["a"]), "b").hint("merge"), ["task", "no", "part"])
    listed = (F.array_join(F.col(s).cast("array<string>"), ",") for s in "ab")
    line = F.struct("part", F.concat_ws("|", *listed).alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), ";").alias("groups")
    n_links = F.sum(F.size("a").cast("long") * F.size("b"))
    sums = [F.sum(F.size("a")).alias("n_a"), F.sum(F.size("b")).alias("n_b"), F.count("*").alias("n_groups"), n_links.alias("n_links")]
    return both.groupBy("task", "no").agg(*sums, text, F.flatten(F.collect_list(links_of("a", "b"))).alias("links"))


# texts from their units


def _often(rows: DataFrame, limit: int, short: Column | None = None) -> Column:
    """Whether a row is one of those of most docs, at most `limit` and all short. Frequencies are counted in steps of a 16th of a power of two; the last step that fits whole is in."""
    step = F.floor(F.log2("docs") * 16)
    step = step if short is None else F.when(short, step).otherwise(-1)
    counts = sorted(((r["step"], r["count"]) for r in rows.groupBy(step.alias("step")).count().collect() if r["step"] >= 0), reverse=True)
    total, least = 0, 1 << 20
    for at, n in counts:
        total += n
        if total > limit:
            break
        least = at
    return step >= least


def _met(rows: DataFrame, rest: DataFrame, payload: DataFrame, often: Column, aggregates: list) -> list[DataFrame]:
    """Aggregates by row with what payload has for their units: of frequent units among those of rows, and of the others, which are those of rest."""
    first = rows.join(F.broadcast(payload.where(often).drop("docs")), "unit").groupBy("task", "row").agg(*aggregates)
    return [first, rest.join(payload.where(~often).drop("docs"), "unit").groupBy("task", "row").agg(*aggregates)]


def align(documents: DataFrame, a_path: str, b_path: str, settings: Settings | None = None, shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;..`) of every row; shown says what is kept of groups."""
    with _as_dealt(documents.sparkSession) as tables:
        with _set(documents.sparkSession, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192"}):  # a block's documents are put together without a sort
            return keep(_align(documents, a_path, b_path, settings or Settings(), tables, shown), "alignment")


def _align(documents: DataFrame, a_path: str, b_path: str, s: Settings, tables: dict[str, str], shown: Callable[[Column], Column]) -> DataFrame:
    spark = documents.sparkSession
    whole = F.concat(F.lit(" "), "text")
    cut = F.split(whole, CUT, -1) if cuts_at_blanks(a_path, b_path) else F.array(whole)
    texts = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    rows = _held(texts.select("row", "doc_id", F.when(F.col("text") != "", cut).alias("units")), tables, "rows", s.blocks)
    once = rows.select("task", "row", F.explode(F.array_distinct("units")).alias("unit"))
    placed = rows.select("task", "row", F.posexplode("units").alias("place", "unit"))
    known = _held(once.groupBy("unit").agg(F.count("*").alias("docs")).withColumn("no", F.monotonically_increasing_id()), tables, "units")
    blocks = -(-known.count() // (s.block_units * max(known.rdd.getNumPartitions(), 1)))
    coded = _held(encoded(known, a_path, b_path), tables, "coded", max(blocks, 1))
    _drop(spark, tables, "units")
    with _set(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "128"}):  # groups are too many for that
        found = _held(coded.select("task", "no", "unit", "docs", "ok").join(aligned(coded).hint("merge"), ["task", "no"], "left").drop("task"), tables, "aligned")
    _drop(spark, tables, "coded")

    # documents of each pair: its units' pairs, each once
    pairs = F.transform("links", lambda x: x["pair"])
    often = _often(found, s.frequent, F.octet_length("unit") <= s.frequent_bytes)
    others = _held(placed.join(F.broadcast(found.where(often).select("unit")), "unit", "left_anti"), tables, "others")
    first, rest = _met(once, others, found.select("unit", "docs", "ok", pairs.alias("pairs")), often, [F.min("ok").alias("ok"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")])
    joined = first.join(rest.select("task", "row", F.col("ok").alias("ok_2"), F.col("pairs").alias("pairs_2")), ["task", "row"], "full")
    none = F.array().cast("array<bigint>")
    union = F.array_union(F.coalesce("pairs", none), F.coalesce("pairs_2", none))
    linked = joined.where(F.coalesce("ok", F.lit(True)) & F.coalesce("ok_2", F.lit(True))).select(F.explode(union).alias("pair"))
    counts = _held(linked.groupBy("pair").agg(F.count("*").alias("docs")), tables, "pairs")

    # what each unit adds to n_best and count_sum
    of_a = F.floor(F.col("pair") / SHIFT).alias("a")
    best = counts.groupBy(of_a).agg(F.max("docs").alias("most"))
    rated = _held(counts.select("pair", "docs", of_a).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), tables, "rated")
    _drop(spark, tables, "pairs")
    top = _often(rated, s.frequent)
    most, seldom = rated.where(top), rated.where(~top)
    links = found.select("no", F.inline("links"))
    near, far = links.join(F.broadcast(most), "pair"), links.join(F.broadcast(most.select("pair")), "pair", "left_anti").join(seldom, "pair")
    of_unit = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    added = near.select("no", "times", "docs", "best").union(far.select("no", "times", "docs", "best")).groupBy("no").agg(*of_unit)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    summed = _held(found.join(added, "no", "left").select("unit", "docs", "ok", "groups", *names), tables, "sums")
    _drop(spark, tables, "aligned", "rated")

    first, rest = _met(placed, others, summed, often, [F.min("ok").alias("ok"), F.collect_list(F.struct("place", "groups")).alias("listed"), *(F.sum(n).alias(n) for n in names)])
    rest = rest.select("task", "row", *(F.col(c).alias(f"{c}_2") for c in rest.columns if c not in ("task", "row")))
    out = rows.select("task", "row", "doc_id").join(first, ["task", "row"], "left").join(rest, ["task", "row"], "left")
    fine = F.coalesce("ok", "ok_2").isNotNull() & F.coalesce("ok", F.lit(True)) & F.coalesce("ok_2", F.lit(True))
    empty = F.array().cast("array<struct<place:int,groups:string>>")
    text = F.array_join(F.transform(F.sort_array(F.concat(F.coalesce("listed", empty), F.coalesce("listed_2", empty))), lambda x: x["groups"]), ";")
    zero = F.lit(0).cast("long")
    total = [F.when(fine, F.coalesce(n, zero) + F.coalesce(f"{n}_2", zero)).otherwise(zero).alias(n) for n in names]
    return out.select("doc_id", *total, shown(F.when(fine, text)).alias("groups"))


def digest(documents: DataFrame, a_path: str, b_path: str, settings: Settings | None = None) -> DataFrame:
    """align() with groups as a sha256, '' without tokens. The groups themselves, several times the texts, are never written."""
    found = align(documents, a_path, b_path, settings, lambda groups: F.coalesce(F.sha2(groups, 256), F.lit("")))
    return found.withColumnRenamed("groups", "groups_sha256")
