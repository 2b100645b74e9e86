"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs over all training texts are put on a logarithmic scale, and
a count's level is kept by entering the n-gram once for each level up to it. Looking a count up
asks for level after level until one is missing. The filter is made of segments by n-gram hash,
each built by the task that holds the segment's counts, with `bits_each` bits for each level that
is entered: it grows with the corpus. A filter of up to `Settings.bits` is broadcast. A larger one
stays in its segments: the different n-grams of each part of the texts are sent to the segments
they are in, and their levels back to the part, so that no task holds more than a segment or a part.
Both ways ask the same filter and give the same scores.

A word's probability mixes its pair's share of the context with its own smoothed share:
w * c(context, word) / c(context) + (1 - w) * (c(word) + 0.1) / (N + 0.1 * (V + 1)),
w = weight * c(context) / (c(context) + 5), all counts being those of the filter.

Exact word counts for the base score come from the count table itself: the most frequent words
(as many as `frequent` holds) as a broadcast, all others by a join.

Words are told apart by 64-bit hashes: two of a billion words share one with a chance of 3 %.

Defined results: a null text is an empty one, whose only token is its end; a null doc_id counts
as an empty string for the fold and is kept; repeated rows train and are scored each; with no
training text N and V are 0 and every token has the share of an unknown one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_frames, keep, text_of

ODD = np.uint64(0x9E3779B97F4A7C15)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


@dataclass(frozen=True)
class Settings:
    """bits: the largest filter that is broadcast; frequent: bound of the broadcast word counts; cache: words a worker remembers."""

    bits: int = 1 << 30
    bits_each: float = 10.0
    probes: int = 4
    step: float = 0.5  # a level is a factor of 2 ** step
    levels: int = 80
    weight: float = 0.4
    frequent: int = 1 << 20
    cache: int = 300_000
    flush: int = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Texts as hashes: words between ASCII blanks, A-Z in lower case, and an end for each text."""

    def __init__(self, most: int):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts in a row, and where each text starts."""
        import xxhash

        seen, hashed = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.most:
            seen.clear()
        out, starts = [], []
        for text in texts:
            starts.append(len(out))
            for w in text.encode("utf-8").lower().split():
                h = seen.get(w)
                if h is None:
                    h = seen[w] = hashed(w)
                out.append(h)
            out.append(int(END))
        return np.array(out, np.uint64), np.array(starts, np.int64)


def pairs_of(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context (the token before, or the start) and the hash of both."""
    context = np.empty_like(h)
    context[1:] = h[:-1]
    context[starts] = START
    return context, mixed(context * ODD + h)


def chunked(frame: pd.DataFrame, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    at = size = 0
    for i, n in enumerate(frame["text"].str.len()):
        if i > at and size + n > most:
            yield frame.iloc[at:i]
            at, size = i, 0
        size += n
    if at < len(frame):
        yield frame.iloc[at:]


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return (grams >> np.uint64(32)) % np.uint64(segments)


COUNTS = "kind int, segment int, hashes binary, counts binary, n long"


def partial_counts(training: DataFrame, segments: int, s: Settings) -> DataFrame:
    """Counts of words (kind 0, 64 bits each) and of n-grams (kind 1, 32 bits in their segment) of parts of the texts, packed by segment."""

    def pack(kind: int, values: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        seg = segment_of(values, segments).astype(np.int32)
        order = np.argsort(seg, kind="stable")
        seg, values, counts = seg[order], values[order], counts[order].astype(np.uint32)
        if kind:
            values = values.astype(np.uint32)
        which, first = np.unique(seg, return_index=True)
        ends = np.append(first[1:], len(seg))
        return pd.DataFrame({"kind": np.int32(kind), "segment": which, "hashes": [values[a:b].tobytes() for a, b in zip(first, ends, strict=True)], "counts": [_packed(counts[a:b]) for a, b in zip(first, ends, strict=True)], "n": ends - first})

    def packs(words: list[np.ndarray], pairs: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        values, counts = np.unique(np.concatenate(words), return_counts=True)
        yield pack(0, values, counts)
        yield pack(1, mixed(values), counts)
        yield pack(1, *np.unique(np.concatenate(pairs), return_counts=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, words, pairs, held = Tokens(s.cache), [], [], 0
        with np.errstate(over="ignore"):
            for frame in frames:
                for part in chunked(frame):
                    h, starts = tokens.of(part["text"].tolist())
                    words.append(h)
                    pairs.append(pairs_of(h, starts)[1])
                    held += len(h)
                    if held > s.flush:
                        yield from packs(words, pairs)
                        words, pairs, held = [], [], 0
            if held:
                yield from packs(words, pairs)

    return training.select(text_of().alias("text")).mapInPandas(run, COUNTS)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in one byte each if all fit, else in four."""
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else counts.tobytes()


def _merged(hashes, counts, kind) -> tuple[np.ndarray, np.ndarray]:
    h = [np.frombuffer(x, kind) for x in hashes]
    c = [np.frombuffer(y, np.uint8 if len(y) == len(x) else np.uint32) for x, y in zip(h, counts, strict=True)]
    values, where = np.unique(np.concatenate(h), return_inverse=True)
    return values, np.bincount(where, np.concatenate(c).astype(np.float64)).astype(np.int64)


def word_counts(partial: DataFrame) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, c = _merged(frame["hashes"], frame["counts"], np.uint64)
        return pd.DataFrame({"word": h.view(np.int64), "c": c})

    return partial.where("kind = 0").groupBy("segment").applyInPandas(run, "word long, c long")


def filter_segments(partial: DataFrame, bits_each: float, s: Settings) -> DataFrame:
    """The filter's segments, each with the bits that its own entries need."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, c = _merged(frame["hashes"], frame["counts"], np.uint32)
        top = levels_of(c, s)
        size = max(64, int(math.ceil(top.sum() * bits_each / 64)) * 64)
        bits = np.zeros(size, bool)
        with np.errstate(over="ignore"):
            for level in range(1, int(top.max()) + 1):
                own = h[top >= level].astype(np.uint64)
                for i in range(s.probes):
                    bits[place(own, level, i) % np.uint64(size)] = True
        return pd.DataFrame({"segment": frame["segment"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return partial.where("kind = 1").groupBy("segment").applyInPandas(run, "segment int, bits binary")


def place(grams: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mixed((grams + np.uint64(level * 0x100000001)) * ODD + np.uint64(probe * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(8)


def probed(bits: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray, s: Settings) -> np.ndarray:
    """Repeated membership probes: the last level of each n-gram of which all bits are set in its segment; 0 where that is empty."""
    out, active = np.zeros(len(low), np.int64), np.flatnonzero(size > 0)
    for level in range(1, s.levels + 1):
        for i in range(s.probes):
            at = start[active] + (place(low[active], level, i) % size[active]).astype(np.int64)
            active = active[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        if not len(active):
            break
        out[active] = level
    return out


def levels_of(counts: np.ndarray, s: Settings) -> np.ndarray:
    return np.minimum(s.levels, 1 + np.floor(np.log2(counts) / s.step + 1e-9)).astype(np.int64)


def value_of(levels: np.ndarray, s: Settings) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    low = np.ceil(2.0 ** ((levels - 1) * s.step) - 1e-9)
    high = np.maximum(low, np.ceil(2.0 ** (levels * s.step) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0)


@dataclass
class Model:
    settings: Settings
    segments: int
    starts: np.ndarray  # of segments, in bits
    sizes: np.ndarray
    bits: np.ndarray | None  # none if the filter stays in its segments
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    total: int
    distinct: int

    def levels(self, grams: np.ndarray) -> np.ndarray:
        seg = segment_of(grams, self.segments).astype(np.int64)
        return probed(self.bits, grams & np.uint64(0xFFFFFFFF), self.starts[seg], self.sizes[seg].astype(np.uint64), self.settings)

    def counts_of(self, grams: np.ndarray) -> np.ndarray:
        values, where = np.unique(grams, return_inverse=True)
        return value_of(self.levels(values), self.settings)[where]

    def scores(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.scores_from(self.counts_of(mixed(h)), self.counts_of(pairs_of(h, starts)[1]), starts)

    def scores_from(self, own: np.ndarray, both: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of texts from the counts of their words and pairs."""
        s = self.settings
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts] = own[len(own) - 1] if len(own) else 0  # as many starts as ends
        share = (own + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        weight = np.where(before > 0, s.weight * before / (before + 5), 0)
        p = weight * np.minimum(1, both / np.maximum(before, 1)) + (1 - weight) * np.minimum(1, share)
        return np.add.reduceat(np.log10(p), starts) if len(starts) else np.zeros(0)

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of the frequent words; -1 for all others."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], -1)


def fitted(training: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    """The model, and the table word, c of all words."""
    return trained(training, s)[:2]


def trained(training: DataFrame, s: Settings) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table word, c of all words, and the filter's segments."""
    size = training.agg(F.sum(F.length(text_of()))).first()[0] or 0
    segments = max(64, math.isqrt(size) // 16)  # packed parts and merged segments grow alike
    partial = keep(partial_counts(training, segments, s), "counts")
    vocabulary = keep(word_counts(partial), "words")
    total, distinct = vocabulary.agg(F.sum("c"), F.count("*")).first()
    parts = keep(filter_segments(partial, s.bits_each, s), "filter")
    held = 8 * (parts.agg(F.sum(F.length("bits"))).first()[0] or 0)
    sizes, bits = _whole_filter(parts, segments) if held <= s.bits else (np.zeros(segments, np.int64), None)
    least = _least_count(vocabulary, s)
    often = vocabulary.where(F.col("c") >= (least or 2**62)).toArrow()
    words = often["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Model(s, segments, np.cumsum(sizes) - sizes, sizes, bits, words[order], often["c"].to_numpy()[order], total or 0, distinct), vocabulary, parts


def _whole_filter(parts: DataFrame, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the segments in bits, and the filter as one array: collected as Arrow, so the driver holds its bytes and no rows."""
    found = parts.toArrow()
    order = np.argsort(found["segment"].to_numpy())
    sizes = np.zeros(segments, np.int64)
    column = found["bits"]
    lengths = [len(column[int(i)].as_buffer()) for i in order]
    sizes[found["segment"].to_numpy()[order]] = np.array(lengths, np.int64) * 8
    bits, at = np.zeros(sum(lengths), np.uint8), 0
    for i, n in zip(order, lengths, strict=True):
        bits[at : at + n] = np.frombuffer(column[int(i)].as_buffer(), np.uint8)
        at += n
    return sizes, bits


def _least_count(vocabulary: DataFrame, s: Settings) -> int:
    """The smallest count from which on the words fit into `frequent`; 0 if none do. By powers of two, so a few rows."""
    rows = vocabulary.groupBy(F.floor(F.log2("c")).alias("power")).count().collect()
    held, least = 0, 0
    for power, n in sorted(((r["power"], r["count"]) for r in rows), reverse=True):
        held += n
        if held > s.frequent:
            break
        least = 2**power
    return least


def coded(h: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A part's different words, its tokens as places among them, and the starts of its texts."""
    words, codes = np.unique(h, return_inverse=True)
    return words.tobytes(), codes.astype(np.uint32).tobytes(), starts.tobytes()


def decoded(words: bytes, codes: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(words, np.uint64)[np.frombuffer(codes, np.uint32)], np.frombuffer(starts, np.int64)


def grams_of(h: np.ndarray, starts: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's different n-grams by segment, their segments, and the places of all words and then all pairs among them."""
    values, where = np.unique(np.concatenate([mixed(h), pairs_of(h, starts)[1]]), return_inverse=True)
    seg = segment_of(values, segments).astype(np.int32)
    order = np.argsort(seg, kind="stable")
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))
    return values[order], seg[order], spot[where]


def scores_by_segments(parts: DataFrame, filter_: DataFrame, sent, segments: int, s: Settings) -> DataFrame:
    """row, score of every text of the parts (columns row of its first text, words, codes, starts), from a filter left in its segments."""
    small = np.min_scalar_type(s.levels)

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for frame in frames:
                for row, *part in frame.itertuples(index=False):
                    grams, seg, _ = grams_of(*decoded(*part), segments)
                    which, first = np.unique(seg, return_index=True)
                    low = np.split(grams.astype(np.uint32), first[1:])
                    yield pd.DataFrame({"segment": which, "part": row, "grams": [x.tobytes() for x in low]})

    def asked(probes: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
        low = [np.frombuffer(x, np.uint32) for x in probes["grams"]]
        grams = np.concatenate([np.zeros(0, np.uint32), *low]).astype(np.uint64)
        bits = np.frombuffer(b"".join(filter_["bits"]), np.uint8)
        with np.errstate(over="ignore"):
            found = probed(bits, grams, np.zeros(len(grams), np.int64), np.full(len(grams), 8 * len(bits), np.uint64), s).astype(small)
        cuts = np.cumsum([len(x) for x in low])[:-1]
        return pd.DataFrame({"part": probes["part"], "segment": probes["segment"], "levels": [x.tobytes() for x in np.split(found, cuts)] if low else []})

    def scored(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row, *own = next(part.itertuples(index=False))
        with np.errstate(over="ignore"):
            h, starts = decoded(*own)
            levels = np.frombuffer(b"".join(found.sort_values("segment")["levels"]), small).astype(np.int64)
            counts = value_of(levels, s)[grams_of(h, starts, segments)[2]]
            out = sent.value.scores_from(counts[: len(h)], counts[len(h) :], starts)
        return pd.DataFrame({"row": row + np.arange(len(starts)), "score": out})

    asks = parts.mapInPandas(probes, "segment int, part long, grams binary").groupBy("segment")
    found = keep(asks.cogroup(filter_.groupBy("segment")).applyInPandas(asked, "part long, segment int, levels binary"), "levels")
    return parts.groupBy("row").cogroup(found.groupBy("part")).applyInPandas(scored, "row long, score double")


def score(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    s = settings or Settings()
    rows = documents.select("doc_id", (fold_of("doc_id", 10) == 0).alias("held_out"), text_of().alias("text"))
    model, vocabulary, filter_ = trained(rows.where("not held_out"), s)
    whole_filter, segments = model.bits is not None, model.segments
    sent = documents.sparkSession.sparkContext.broadcast(model)
    norm = model.total + 0.1 * (model.distinct + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        m, tokens = sent.value, Tokens(s.cache)
        row = TaskContext.get().partitionId() << 36
        with np.errstate(over="ignore"):
            for frame in frames:
                for part in chunked(frame):
                    h, starts = tokens.of(part["text"].tolist())
                    ends = np.append(starts[1:], len(h))
                    c = m.exact(h)
                    often = c >= 0
                    base = np.add.reduceat(np.where(often, np.log10((np.maximum(c, 0) + 0.1) / norm), 0), starts)
                    rare = [h[a:b][~often[a:b]].view(np.int64) for a, b in zip(starts, ends, strict=True)]
                    held = (m.scores(h, starts), None, None, None) if whole_filter else (np.nan, *([x, *[None] * (len(part) - 1)] for x in coded(h, starts)))
                    yield pd.DataFrame({"row": row + np.arange(len(part)), "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": ends - starts, "often": np.add.reduceat(often.astype(np.int64), starts), "base": base, "rare": rare, **dict(zip(("score", "words", "codes", "starts"), held, strict=True))})
                    row += len(part)

    scored = keep(in_frames(rows, run, "row long, doc_id long, held_out boolean, n_tokens long, often long, base double, rare array<long>, score double, words binary, codes binary, starts binary"), "scored")
    each = scored.select("row", F.explode("rare").alias("word")).join(vocabulary, "word", "left")
    found = each.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / norm)).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = scored.drop("rare", "words", "codes", "starts").join(found, "row", "left")
    if not whole_filter:
        parts = scored.where("codes is not null").select("row", "words", "codes", "starts")
        whole = whole.drop("score").join(scores_by_segments(parts, filter_, sent, segments, s), "row")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("often") + zero("known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + zero("more")).alias("base_score"), "score")
