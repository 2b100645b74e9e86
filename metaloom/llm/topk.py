"""Exact top-k search by distributed histogram selection.

Vectors become integer components; queries and candidates are packed into blocks of bounded size
and meet block by block in an equi-join on (query block, lane), candidate blocks being dealt over
the lanes. Each pass scores every candidate against every query and counts scores in a histogram
over the query's present range; summed over all tasks, it tells in which bin the k-th value lies,
and that bin is the next range. When the range is a single value, the k-th score is known: one
more pass keeps what lies above it, and of the ties the smallest ids that are needed.

A task reports only its own highest bins, down to its own k-th candidate: no global k-th value
lies below that. So a task sends at most k rows a query, ties or not.

Defined results: a row whose vector is null, or holds a null or a component that isn't finite,
takes no part, nor does one whose vec_id is null; vectors shorter than the longest are filled up
with zeros, which add nothing to a product; of several rows of a query's vec_id the smallest
vector asks, while as candidates they all count; a query with fewer than k candidates gets all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep


@dataclass(frozen=True)
class Settings:
    k: int = 5
    bins: int = 512
    query_block: int = 1024
    candidate_block: int = 4096
    lanes: int = 64
    held: int = 16


def quantised(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """vec_id and the integer vector v, of rows that take part."""
    part = F.col(column).cast("array<double>")
    fine = F.forall(part, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & part.isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(part, lambda x: F.floor(x * scale).cast("double")).alias("v"))


BLOCK = "n int, ids binary, matrix binary"


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def candidate_blocks(vectors: DataFrame, width: int, lanes: int, kind: str, s: Settings) -> DataFrame:
    """Each partition packs its rows into blocks, each in a lane."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), s.candidate_block):
                part = frame.iloc[at : at + s.candidate_block]
                ids = part["vec_id"].to_numpy(np.int64)
                lane = int((ids[0] * 0x9E3779B1) % lanes)
                yield pd.DataFrame({"lane": [lane], "n": [len(part)], "ids": [ids.tobytes()], "matrix": [_matrix(part["v"].tolist(), width).astype(kind).tobytes()]})

    packed = vectors.mapInPandas(pack, f"lane int, {BLOCK}")
    return packed.select("lane", *(F.col(c).alias(f"c_{c}") for c in ("n", "ids", "matrix")))


def query_blocks(queries: DataFrame, width: int, blocks: int, lanes: int, kind: str) -> DataFrame:
    """Queries with their state (low, high, size of a bin, still wanted) packed into blocks by a hash of the id, in every lane."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        state = frame[["low", "high", "bin", "want"]].to_numpy(np.float64)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "n": [len(frame)], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [_matrix(frame["v"].tolist(), width).astype(kind).tobytes()], "state": [state.tobytes()]})

    tagged = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = tagged.groupBy("block").applyInPandas(pack, f"block int, {BLOCK}, state binary")
    return packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *(F.col(c).alias(f"q_{c}") for c in ("n", "ids", "matrix", "state")))


def _scored(row, width: int, kind: str):
    """Ids, state and score matrix of a pair of blocks; a query's own rows score nan."""
    q_ids, c_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
    q = np.frombuffer(row.q_matrix, kind).reshape(-1, width).astype(float)
    c = np.frombuffer(row.c_matrix, kind).reshape(-1, width).astype(float)
    scores = q @ c.T
    order = np.argsort(q_ids, kind="stable")
    at = np.minimum(np.searchsorted(q_ids, c_ids, sorter=order), len(q_ids) - 1)
    own = q_ids[order[at]] == c_ids
    scores[order[at[own]], np.flatnonzero(own)] = np.nan
    return q_ids, c_ids, np.frombuffer(row.q_state).reshape(-1, 4), scores


def histograms(pairs: DataFrame, width: int, kind: str, s: Settings) -> DataFrame:
    """vec_id, slot, count: for each query its highest occupied bins, as many as hold the wanted number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for row in frame.itertuples():
                if len(sums) >= s.held and row.block not in sums:
                    yield from highest(sums)
                    sums.clear()
                q_ids, _, state, scores = _scored(row, width, kind)
                fits = (scores >= state[:, :1]) & (scores < state[:, 1:2])
                slots = np.floor((scores - state[:, :1]) / state[:, 2:3])
                which, _ = np.nonzero(fits)
                flat = which * s.bins + slots[fits].astype(np.int64)
                counts = np.bincount(flat, minlength=len(q_ids) * s.bins).reshape(len(q_ids), s.bins)
                old = sums.get(row.block)
                sums[row.block] = (q_ids.copy(), state[:, 3].copy(), counts if old is None else old[2] + counts)
        yield from highest(sums)

    def highest(sums: dict) -> Iterator[pd.DataFrame]:
        for q_ids, want, counts in sums.values():
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            which, slot = np.nonzero((counts > 0) & (above < want[:, None]))
            yield pd.DataFrame({"vec_id": q_ids[which], "slot": slot.astype(np.int32), "count": counts[which, slot]})

    return pairs.mapInPandas(run, "vec_id long, slot int, count long")


def nearest(pairs: DataFrame, width: int, kind: str) -> DataFrame:
    """query_id, vec_id, score: what lies above the k-th score (low), and of its ties the wanted number with the smallest ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, c_ids, state, scores = _scored(row, width, kind)
                order = np.argsort(c_ids, kind="stable")
                scores, c_ids = scores[:, order], c_ids[order]
                tie = scores == state[:, :1]
                found = (scores > state[:, :1]) | (tie & (np.cumsum(tie, axis=1) <= state[:, 3:4]))
                which, at = np.nonzero(found)
                yield pd.DataFrame({"query_id": q_ids[which], "vec_id": c_ids[at], "score": scores[which, at].astype(np.int64)})

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: Column, column: str = "embedding", scale: int = 256, settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` picks the k best other rows by integer inner product."""
    s = settings or Settings()
    rows = keep(quantised(vectors, column, scale), "quantised")
    asking = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda n, x: n + F.abs(x))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(most)).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    # no score is beyond a query's sum of sizes times the largest component
    bound = F.greatest(F.lit(1.0), size * (top or 0.0))
    bin_ = F.greatest(F.lit(1.0), F.ceil((2 * bound + 1) / s.bins).cast("double"))
    state = keep(asking.select("vec_id", "v", (-bound).alias("low"), (bound + 1).alias("high"), bin_.alias("bin"), F.lit(float(s.k)).alias("want")), "state")
    count, farthest = state.agg(F.count("*"), F.max("high")).first()
    if farthest is not None and farthest > 2**53:
        raise ValueError("scores may pass 2 ** 53, beyond which doubles are not exact: use a smaller scale")
    blocks = max(1, -(-count // s.query_block))
    lanes = max(s.lanes, -(-n // (8 * s.candidate_block)))
    kind = "i2" if (top or 0) < 2**15 else "f8"
    packed = keep(candidate_blocks(rows, width, lanes, kind, s), "candidates")
    meet = lambda now: packed.join(query_blocks(now, width, blocks, lanes, kind), "lane")
    while True:
        done = state.agg(F.max("bin")).first()[0]
        counted = histograms(meet(state), width, kind, s).groupBy("vec_id", "slot").agg(F.sum("count").alias("count"))
        state = keep(_narrowed(state, counted, s), "state")
        if done is None or done <= 1:
            break
    found = nearest(meet(state), width, kind)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _narrowed(state: DataFrame, counted: DataFrame, s: Settings) -> DataFrame:
    """The bin that holds the wanted-th value becomes the range; with too few candidates the lowest occupied one does."""
    running = counted.withColumn("above", F.expr("coalesce(sum(count) over (partition by vec_id order by slot desc rows between unbounded preceding and 1 preceding), 0)"))
    chosen = running.join(state.select("vec_id", "want"), "vec_id").where("above < want")
    chosen = chosen.groupBy("vec_id").agg(F.min(F.struct("slot", "above")).alias("c"))
    now = state.join(chosen, "vec_id", "left")
    slot, above = F.coalesce("c.slot", F.lit(0)), F.coalesce("c.above", F.lit(0))
    low = F.col("low") + slot * F.col("bin")
    finer = F.greatest(F.lit(1.0), F.ceil(F.col("bin") / s.bins).cast("double"))
    return now.select("vec_id", "v", low.alias("low"), F.least("high", low + F.col("bin")).alias("high"), finer.alias("bin"), (F.col("want") - above).alias("want"))
