"""Near duplicates by Order MinHash.

A sketch component of a document takes its `picks` least hashed, occurrence-labelled shingles of
five words and keeps them in text order; equal components make candidates. A candidate pair is a
link if the banded alignment of the two shingle sequences keeps `alike` of them: matched shingles
over all shingles of both. Texts with the same words are one node from the start.

Documents that share a component are a bucket; buckets over `block` are cut into blocks, each of
which also holds the bucket's least node. Candidates come in three steps, each aligned and
contracted to classes before the next:

1. The two of a bucket of two. In a larger one the least node that isn't taken yet leads all those
   whose one-bit minimum hashes differ from its own in at most `differ` of `bits`, and each is a
   candidate with its leader alone.
2. In buckets that still hold several classes, each node and the `nearest` ones of other classes.
3. In those that still do, all pairs of different classes, block against block, each pair in the
   bucket of its first common component.

The first two cost a few rows per member however large a group of copies is; after the third every
pair of a bucket is in one class, or aligned, or too far apart by its bits, which a pair at 0.8 is
with a chance of 3e-5. Nothing is capped.

Defined results: a null text is an empty one; texts without words are one node; a text of fewer
than five words has one shingle, all its words; a null doc_id is kept, class_id being the least
doc_id that isn't null (null if there is none); repeated rows are members of one class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_frames, keep, releasing, text_of
from .components import components

WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """With 20 components of 3 picks a pair at 0.8 is missed with a chance of (1 - 0.8 ** 3) ** 20, under 1e-6."""

    words: int = 5
    alike: float = 0.8
    components: int = 20
    picks: int = 3
    bits: int = 2048
    differ: int = 259
    nearest: int = 3
    block: int = 2048
    broadcast_rows: int = 1_000_000
    seed: int = 11


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of words; a worker remembers up to `most` of them."""

    def __init__(self, most: int = 100_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def of(self, text: str) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > self.most:
            seen.clear()
        for w in WORD.findall(text.lower()):
            h = seen.get(w)
            if h is None:
                h = seen[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, np.uint64)


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row; of all words, if there are fewer."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = mixed(out * ODD + words[j : len(words) - k + 1 + j])
    return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how often it occurred before), so that no two of a document are equal."""
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if n else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, n))
    count = np.empty(n, np.uint64)
    count[order] = (np.arange(n) - np.repeat(first, runs)).astype(np.uint64)
    return np.where(count > 0, mixed(shingles + count * ODD), shingles)


def sketch(items: np.ndarray, s: Settings) -> np.ndarray:
    """One hash for each component: the least hashed items of its order, put back into text order."""
    picks = min(s.picks, len(items))
    out = np.zeros(s.components, np.uint64)
    step = max(1, 1_000_000 // max(1, len(items)))
    with np.errstate(over="ignore"):
        seeds = mixed(np.arange(1, s.components + 1, dtype=np.uint64) * ODD + np.uint64(s.seed))
        for at in range(0, s.components if picks else 0, step):
            here = seeds[at : at + step]
            ranks = mixed(items[None, :] ^ here[:, None])
            where = np.argpartition(ranks, picks - 1, axis=1)[:, :picks] if picks < len(items) else np.tile(np.arange(picks), (len(here), 1))
            chosen = items[np.sort(where, axis=1)]
            h = here.copy()
            for j in range(picks):
                h = mixed(h * ODD + chosen[:, j])
            out[at : at + step] = h
    return out


def signature(own: np.ndarray, s: Settings) -> bytes:
    """A bit of the least item (32 bits each) under each of many multiplications."""
    out = np.zeros(s.bits, bool)
    if len(own):
        factors = mixed(np.arange(s.bits, dtype=np.uint64) * ODD + np.uint64(s.seed + 1)).astype(np.uint32) | np.uint32(1)
        step = max(1, 1_000_000 // len(own))
        for at in range(0, s.bits, step):
            least = (factors[at : at + step, None] * own[None, :]).min(axis=1)
            out[at : at + step] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(out).tobytes()


def similarity(a: np.ndarray, b: np.ndarray, alike: float) -> float:
    """Share of labelled shingles that a banded alignment of a and b keeps; 0 where it can't reach alike.

    Labels make items unique, so an alignment is a chain of common items rising in both texts:
    a longest increasing subsequence. Beyond the band more items would be left over than alike allows.
    """
    most = min(len(a), len(b))
    if not most or most < alike * max(len(a), len(b)):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    spot = order[at]
    same = b[spot] == a
    need = alike * (len(a) + len(b)) / (1 + alike)
    if same.sum() < need - 1e-9:
        return 0.0
    i, j = np.flatnonzero(same), spot[same]
    band = len(a) + len(b) - 2 * need
    near = np.abs(i - j) <= band + 1e-9
    j = j[near]
    kept = len(j) if (np.diff(j) > 0).all() else _rising(j)
    return kept / (len(a) + len(b) - kept) if kept >= need - 1e-9 else 0.0


def _rising(values: np.ndarray) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def sketches(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id and node (a hash of the words) of every document; the first of a node that a task meets also has sketch and items.

    Items are the labelled shingles in text order, 32 bits each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, met = Words(), set()
        with np.errstate(over="ignore"):
            for frame in frames:
                nodes, found, kept = [], [], []
                for text in frame["text"]:
                    w = words.of(text)
                    node = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
                    nodes.append(node)
                    if node in met:
                        found.append(None)
                        kept.append(None)
                        continue
                    if len(met) > words.most:
                        met.clear()
                    met.add(node)
                    items = labelled(shingled(w, s.words))
                    found.append(sketch(items, s).view(np.int64) if len(items) else np.zeros(0, np.int64))
                    kept.append((items >> np.uint64(32)).astype(np.uint32).tobytes())
                yield pd.DataFrame({"doc_id": frame["doc_id"], "node": nodes, "sketch": found, "items": kept})

    return in_frames(documents.select("doc_id", text_of().alias("text")), run, "doc_id long, node binary, sketch array<long>, items binary")


def signed(drawn: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node, sketch, items and signature of the wanted nodes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with np.errstate(over="ignore"):
                yield frame.assign(signature=[signature(np.frombuffer(x, np.uint32), s) for x in frame["items"]])

    rows = drawn.where("items is not null").select("node", "sketch", "items").join(bounded(wanted, s), "node", "left_semi")
    once = rows.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("items").alias("items"))
    return once.mapInPandas(releasing(run), "node binary, sketch array<long>, items binary, signature binary")


def bounded(side: DataFrame, s: Settings) -> DataFrame:
    """Broadcast up to a count of rows; beyond it the join shuffles both sides."""
    return F.broadcast(side) if side.limit(s.broadcast_rows + 1).count() <= s.broadcast_rows else side


def verified(pairs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """The pairs a, b and whether they are links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            linked = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), s.alike) > 0 for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": linked})

    x = items.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = items.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInPandas(releasing(run), "a binary, b binary, linked boolean")


def classes(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id, node and copies (rows of the class) of every document."""
    of_node = _rooted(documents, settings or Settings())
    least = keep(of_node.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "least")
    return of_node.join(least, "root").select("doc_id", "class_id", "node", "copies")


def _rooted(documents: DataFrame, s: Settings) -> DataFrame:
    """root (the same for a class), doc_id and node of every document."""
    drawn = keep(sketches(documents, s), "sketches")
    nodes = drawn.where("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"))
    rows = nodes.select("node", F.posexplode("sketch").alias("component", "key"))
    # grouped sides are written first: beside a plain exchange a skewed join can be split
    shared = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = keep(rows.join(shared, "key").select("key", "component", "node", F.ceil(F.col("n") / s.block).cast("int").alias("blocks"), (F.col("n") == 2).alias("two")), "members")
    roots = linked(drawn, members, s)
    return drawn.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(drawn: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """node, root of all nodes that have a link; members: key, component, node, blocks, two (whether the bucket holds no more)."""
    spark = drawn.sparkSession
    roots = spark.createDataFrame([], "node binary, root binary")
    if members.isEmpty():
        return roots
    items = keep(signed(drawn, keep(members.select("node").distinct(), "held"), s), "items")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tested = spark.createDataFrame([], "a binary, b binary")
    for candidates in (led, closest, across):
        pairs = keep(candidates(members, roots, items, s).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found = keep(verified(pairs, items, s), "tested")
        tested = tested.unionByName(found.select("a", "b"))
        links = found.where("linked").select("a", "b")
        if not links.isEmpty():
            roots = keep(merged(roots, links), "roots")
    return roots


class Block:
    """Signatures, sizes and classes of a frame of members in order of node."""

    def __init__(self, frame: pd.DataFrame, s: Settings):
        self.frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
        self.nodes = self.frame["node"].to_numpy()
        self.signatures = np.frombuffer(b"".join(self.frame["signature"]), np.uint64).reshape(len(self.frame), -1)
        self.sizes = self.frame["size"].to_numpy()
        self.root = pd.factorize(self.frame["root"])[0]
        self.s = s

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the others that i may be alike by size and signature, and how many bits they differ in."""
        apart = np.bitwise_count(self.signatures[others] ^ self.signatures[i]).sum(axis=1)
        fits = np.minimum(self.sizes[others], self.sizes[i]) >= self.s.alike * np.maximum(self.sizes[others], self.sizes[i])
        fits &= apart <= self.s.differ
        return others[fits], apart[fits]

    def pairs(self, first: list[int], second: list[int]) -> pd.DataFrame:
        low, high = np.minimum(first, second).astype(int), np.maximum(first, second).astype(int)
        return pd.DataFrame({"a": self.nodes[low], "b": self.nodes[high]})


def led(members: DataFrame, roots: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Pairs a < b: both of a bucket of two; of larger ones each node and the least one that may be alike and isn't led itself."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame, s)
        free, first, second = np.arange(len(block.nodes)), [], []
        while len(free) > 1:
            found, _ = block.near(free[0], free[1:])
            first += [free[0]] * len(found)
            second += found.tolist()
            free = np.setdiff1d(free[1:], found, assume_unique=True)
        return block.pairs(first, second)

    twos = members.where("two").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    rows = _blocks(members.where("not two").withColumn("root", F.col("node")), items)
    return twos.unionByName(rows.groupBy("key", "block").applyInPandas(run, "a binary, b binary"))


def closest(members: DataFrame, roots: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Pairs a < b: each node and the nearest ones in its block that may be alike and are in other classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame, s)
        first, second = [], []
        for i in range(len(block.nodes)):
            found, apart = block.near(i, np.flatnonzero(block.root != block.root[i]))
            found = found[np.argsort(apart, kind="stable")[: s.nearest]]
            first += [i] * len(found)
            second += found.tolist()
        return block.pairs(first, second)

    return _blocks(_open(members, roots), items).groupBy("key", "block").applyInPandas(run, "a binary, b binary")


def across(members: DataFrame, roots: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Pairs a < b of a bucket, its first common component, that may be alike and are in different classes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame, s)
        own = block.frame["block"].to_numpy()
        within = block.frame["i"].iat[0] == block.frame["j"].iat[0]
        before = np.stack(block.frame["sketch"])[:, : block.frame["component"].iat[0]]
        first, second = [], []
        for i in range(len(own) - 1):
            rest = np.arange(i + 1, len(own))
            rest = rest[(block.root[rest] != block.root[i]) & (within | (own[rest] != own[i]))]
            found, _ = block.near(i, rest)
            found = found[~(before[found] == before[i]).any(axis=1)]
            first += [i] * len(found)
            second += found.tolist()
        return block.pairs(first, second)

    rows = _open(members, roots).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    return rows.join(_marks(items, "sketch"), "node").groupBy("key", "i", "j").applyInPandas(run, "a binary, b binary")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes and more than two nodes."""
    now = members.where("not two").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return now.join(keep(several.select("key"), "open"), "key")


def _blocks(members: DataFrame, items: DataFrame) -> DataFrame:
    """Members with what is compared; the least node of a bucket is in each of its blocks."""
    rows = members.select("key", "block", "node", "root")
    least = members.where("blocks > 1").groupBy("key").agg(F.min(F.struct("node", "root")).alias("least"), F.max("blocks").alias("blocks"))
    least = least.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "least.node", "least.root")
    return rows.unionByName(least).join(_marks(items), "node")


def _marks(items: DataFrame, *more: str) -> DataFrame:
    return items.select("node", "signature", (F.length("items") / 4).cast("int").alias("size"), *more)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after new links: classes are contracted to their roots first, so that only those that meet are looked at."""
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    met = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    moved = keep(components(met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "moved")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return old.unionByName(moved.join(roots.select("node"), "node", "left_anti"))


def drop_copies(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One document of each class, with its own columns: that of the least doc_id, one without an id only if none has one.

    Words are hashed again only for rows that share their doc_id, or the want of one, with others.
    """
    s = settings or Settings()
    found = keep(_rooted(documents, s), "classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"))
    shared = keep(found.groupBy(F.col("doc_id").alias("shared_id")).agg(F.count("*").alias("n")).where("n > 1").select("shared_id", F.lit(True).alias("shared")), "shared_ids")
    kept = first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept_node"))
    kept = keep(kept.join(bounded(shared, s), F.expr("kept_id <=> shared_id"), "left").select("kept_id", "kept_node", "shared"), "kept")
    once = documents.join(bounded(kept.where("shared is null").select("kept_id"), s), F.expr("doc_id <=> kept_id")).select(documents.columns)
    of_shared = kept.where("shared")
    if of_shared.isEmpty():
        return once

    @F.pandas_udf("binary")
    def node_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for part in parts:
            yield pd.Series([hashlib.blake2b(words.of(t).tobytes(), digest_size=16).digest() for t in part])

    several = documents.join(bounded(shared.select("shared_id"), s), F.expr("doc_id <=> shared_id"), "left_semi").withColumn("_own_node", node_of(text_of()))
    held = several.join(bounded(of_shared.select("kept_id", "kept_node"), s), F.expr("doc_id <=> kept_id and _own_node = kept_node"))
    return once.unionByName(held.dropDuplicates(["doc_id", "_own_node"]).select(documents.columns))
