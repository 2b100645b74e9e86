"""Compression of vectors to codes, by Lloyd rounds whose sums are maintained from changes.

A vector is cut into equal parts; each part is named by the nearest entry of its position's codebook.
What a round persists is the assignment of every vector (a table of its own, beside the one before) and,
on the driver, the running integer sums and counts of all entries, `parts * entries` rows. A round
assigns anew, and shuffles only the contributions of parts whose entry changed: minus at the old one,
plus at the new one. Tasks combine these first, so a shuffle has at most `parts * entries` rows a task. All
sums are whole numbers, so the order in which they are added changes nothing, and the maintained sums
equal those of a full pass.

Numbers: components are floor(256 * x) as whole numbers; a table with one over `LARGEST` is refused, as
squares would pass 64 bits. Squared distances are exact: in double precision where the greatest component
allows it, in 64-bit integers otherwise.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped. The length
of the vector with the smallest id (of the smallest vector of these, if ids repeat) rules: it must be a multiple
of `parts`, and vectors of another length are dropped too. Repeated rows are kept, and each counts. Null ids come after
all others. With fewer vectors than entries the codebooks are shorter; of an empty table there are no rows.
Null labels make one group. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import keep, small_batches

LARGEST = 1 << 26


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    #: Up to so many labels their sums are broadcast; beyond, they are joined, each label in `salts` places.
    broadcast_labels: int = 200_000
    salts: int = 32


@dataclass
class Codes:
    """rows: vec_id, label, code (binary, an entry's number for each part), error. codebooks: parts x entries x components."""

    rows: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole(vectors: DataFrame, s: Settings) -> DataFrame:
    """vec_id, label, q: the kept vectors in whole numbers."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    scaled = lambda e: F.floor(e.cast("double") * s.scale)
    fits = lambda e: F.abs(e.cast("double") * s.scale) <= LARGEST
    refused = F.raise_error(F.lit(f"a component times {s.scale} is over {LARGEST}")).cast("bigint")
    rows = vectors.where(F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", "label", F.transform(x, lambda e: F.when(fits(e), scaled(e)).otherwise(refused)).alias("q"))


def compress(vectors: DataFrame, settings: Settings | None = None) -> Codes:
    s = settings or Settings()
    small_batches(vectors.sparkSession)
    rows = keep(whole(vectors, s), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        none = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(none, np.zeros((s.parts, 0, 0), np.int64))
    size = len(first[0]["q"])
    if size % s.parts:
        raise ValueError(f"vectors of {size} components can't be cut into {s.parts} equal parts")
    rows = rows.where(F.size("q") == size)
    start = np.array([r["q"] for r in rows.orderBy(*order).limit(s.entries).collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), s.parts, size // s.parts).transpose(1, 0, 2))
    most = rows.agg(F.max(F.array_max(F.transform("q", F.abs)))).first()[0]
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    before = None
    for n in range(s.rounds):
        assigned = keep(_assigned(rows if before is None else before, books, most, before is not None), f"assigned{n}")
        for r in _changes(assigned, s.parts, size // s.parts).collect():  # parts * entries rows at most
            sums[r["part"], r["entry"]] += r["sums"]
            counts[r["part"], r["entry"]] += r["times"]
        used = counts > 0
        books = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)
        before = assigned.select("vec_id", "label", "q", F.col("code").alias("old"))
    last = _assigned(rows if before is None else before, books, most, False)
    return Codes(keep(last.select("vec_id", "label", "code", "error"), "codes"), books)


def _assigned(rows: DataFrame, books: np.ndarray, most: int, beside_old: bool) -> DataFrame:
    """The rows with code and error under these codebooks; `old` goes along if there is one to compare with."""
    parts, entries, width = books.shape
    kind = np.float64 if width * (2 * max(most, 1)) ** 2 < 1 << 52 else np.int64
    known = books.astype(kind)
    squares = (known * known).sum(axis=2)
    carried = ["vec_id", "label", "q", *(["old"] if beside_old else [])]
    schema = StructType([*rows.select(*carried).schema.fields, StructField("code", BinaryType()), StructField("error", LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width).astype(kind)
            codes, error = np.empty((n, parts), np.uint8 if entries <= 256 else ">u2"), np.zeros(n, np.int64)
            for p in range(parts):
                gap = squares[p] - 2 * (x[:, p] @ known[p].T)
                codes[:, p] = near = gap.argmin(axis=1)
                error += (gap[np.arange(n), near] + (x[:, p] * x[:, p]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*carried, "code", "error"])

    return rows.select(*carried).mapInArrow(assign, schema)


def _changes(assigned: DataFrame, parts: int, width: int) -> DataFrame:
    """part, entry, sums, times: what entries gain and lose by the parts whose assignment differs from the one before."""
    has_old = "old" in assigned.columns
    moved = assigned.where(F.col("old") != F.col("code")) if has_old else assigned
    digits = F.length(F.col("code")) / parts
    at = lambda c, p: F.conv(F.hex(F.substring(F.col(c), (p * digits + 1).cast("int"), digits.cast("int"))), 16, 10).cast("int")
    row = lambda p, c, sign: F.struct(F.lit(p).alias("part"), at(c, p).alias("entry"), F.lit(sign).alias("sign"))
    told = [row(p, "code", 1) if not has_old else F.when(at("old", p) != at("code", p), F.array(row(p, "old", -1), row(p, "code", 1))) for p in range(parts)]
    each = F.array(*told) if not has_old else F.flatten(F.filter(F.array(*told), lambda x: x.isNotNull()))
    lines = moved.select("q", F.explode(each).alias("c")).select("q", "c.*")
    total = [F.sum(F.col("sign") * F.get("q", F.col("part") * width + i)).alias(f"s{i}") for i in range(width)]
    sums = lines.groupBy("part", "entry").agg(*total, F.sum(F.col("sign").cast("long")).alias("times"))
    return sums.select("part", "entry", F.array(*(f"s{i}" for i in range(width))).alias("sums"), "times")


def with_label_errors(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows with the sum of errors over all rows of the same label, nulls together."""
    s = settings or Settings()
    sums = keep(rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    if sums.limit(s.broadcast_labels + 1).count() <= s.broadcast_labels:
        return rows.join(F.broadcast(sums), F.expr("label <=> of_label")).drop("of_label")
    spread = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(s.salts)).cast("int"))
    return dealt.join(spread, F.expr("label <=> of_label and salt = of_salt")).drop("of_label", "of_salt", "salt")


def digest(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    s = settings or Settings()
    found = compress(vectors, s)
    rows = with_label_errors(found.rows, s)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
