"""Byte-level BPE in DuckDB: encoding by recursive queries, decoding by ordered aggregation.

Each Python worker holds an in-memory DuckDB with two tables made from the rank file: `tokens`
(id, bytes as hex) and `merges` (both ids in one number, rank), a row for every way to cut a token
in two tokens. A partition's distinct words that the worker hasn't met yet become token-position
rows, keyed by both in one number; a recursive query joins neighbours with `merges` and contracts
each word's leftmost pair of least rank until none is left. Rounds are bounded per query, and words that need more go through
it again, so memory stays in proportion to the words however long one is.

A word over `long` bytes is contracted in pieces by the same query, since a round costs its whole
length. Tokens in a row are the word's encoding exactly if every two neighbours are the encoding of
their own bytes (no merge would then cross a border), provided every token is the encoding of its
own bytes, which is tried before the first long word. Borders of pieces are tried by that rule;
where one fails, the tokens around it are contracted anew as one piece, of twice as many tokens in
each pass.

Defined results: a null text is an empty one with no ids; a null doc_id is kept; repeated rows
are each encoded; bytes of ids outside the vocabulary raise an error; special tokens don't exist.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, in_frames, text_of


@dataclass(frozen=True)
class Settings:
    """cache: bytes that a worker remembers distinct words in, about, half of them for words met lately; long, piece: bytes from which words are cut, and of
    a piece; the rest bounds what one DuckDB query holds.
    """

    cache: int = 200_000_000
    long: int = 1000
    piece: int = 256
    query_bytes: int = 400_000
    query_tokens: int = 1_000_000
    rounds: int = 32


ENCODE = """
WITH RECURSIVE step(key, id, round) AS (
    SELECT key, id, 0::INTEGER FROM start_rows
    UNION ALL
    SELECT p.key - (p.key > b.hit)::INTEGER, CASE WHEN p.key = b.hit THEN b.rank ELSE p.id END, p.round + 1
    FROM step p JOIN (
        SELECT word, word << 32 | (best & 4294967295) AS hit, (best >> 32)::INTEGER AS rank
        FROM (
            SELECT a.key >> 32 AS word, min(m.rank::BIGINT << 32 | (a.key & 4294967295)) AS best
            FROM step a JOIN step n ON n.key = a.key + 1 JOIN merges m ON m.pair = (a.id::BIGINT << 32 | n.id)
            GROUP BY a.key >> 32
        )
    ) b ON p.key >> 32 = b.word
    WHERE p.round < {rounds} AND p.key <> b.hit + 1
)
SELECT s.key >> 32 AS word, s.id, s.round
FROM step s JOIN (SELECT key >> 32 AS word, max(round) AS last FROM step GROUP BY 1) m ON s.key >> 32 = m.word AND s.round = m.last
ORDER BY s.key
"""

DECODE = """
SELECT d.doc, string_agg(t.hex, '' ORDER BY d.pos) AS hex, count(t.hex) = count(*) AS whole
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) d LEFT JOIN tokens t ON d.id = t.id
GROUP BY d.doc
"""


class Codec:
    """One for each worker process and rank file."""

    held: dict[tuple, Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str, s: Settings) -> Codec:
        key = (path, pattern, s)
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = cls(path, pattern, s)
        return cls.held[key]

    def __init__(self, path: str, pattern: str, s: Settings):
        import duckdb
        import regex

        gc.set_threshold(200_000, 20, 50)  # words and entries are many and hold no cycles
        self.s, self.words = s, regex.compile(pattern)
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.sound: bool | None = None
        #: word -> its ids as text, the bytes they decode to, their number
        self.known: dict[str, tuple[str, bytes, int]] = {}
        self.older: dict[str, tuple[str, bytes, int]] = {}
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._table("tokens", {"id": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})
        left, right, rank = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        self._table("merges", {"pair": left << 32 | right, "rank": rank.astype(np.int32)})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def learn(self, words: list[str]) -> None:
        """Ids of new words, by as many queries as their bytes ask for. A word that is itself a token is that token."""
        coded = [w.encode("utf-8") for w in words]
        found = {c: [whole] for c in coded if (whole := self.ranks.get(c)) is not None}
        rest = [c for c in coded if c not in found]
        short = [c for c in rest if len(c) <= self.s.long or not self._pieces_fit()]
        found |= zip(short, self.contracted(short), strict=True)
        found |= {c: self._long(c) for c in rest if c not in found}
        every = [found[c] for c in coded]
        for w, ids, text in zip(words, every, self._texts(_flat(every), np.array([len(x) for x in every], np.int64)), strict=True):
            self._hold(w, (",".join(map(str, ids)), text, len(ids)))

    def _hold(self, word: str, entry: tuple[str, bytes, int]) -> None:
        self.known[word] = entry
        self.held += 350 + 2 * len(word) + len(entry[0]) + len(entry[1])  # what Python takes for an entry

    def contracted(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, by as many queries as their bytes ask for."""
        out: list[list[int]] = []
        while len(out) < len(words):
            end, size = len(out), 0
            while end < len(words) and (end == len(out) or size + len(words[end]) <= self.s.query_bytes):
                size += len(words[end])
                end += 1
            part = words[len(out) : end]
            ids, lengths = self._query(self.byte[np.frombuffer(b"".join(part), np.uint8)], np.array([len(w) for w in part], np.int64))
            ends, ids = np.cumsum(lengths).tolist(), ids.tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _pieces_fit(self) -> bool:
        """Whether every token is the encoding of its own bytes, so that long words may be cut."""
        if self.sound is None:
            self.sound = self.contracted(list(self.ranks)) == [[r] for r in self.ranks.values()]
        return self.sound

    def _long(self, word: bytes) -> list[int]:
        parts = self.contracted([word[i : i + self.s.piece] for i in range(0, len(word), self.s.piece)])
        whole = lambda ids: b"".join(map(self.token.__getitem__, ids))
        fits: dict[tuple[int, int], bool] = {}
        k = 8
        while True:
            borders = [(a[-1], b[0]) for a, b in zip(parts, parts[1:], strict=False)]
            new = sorted(set(borders) - fits.keys())
            fits |= {pair: ids == list(pair) for pair, ids in zip(new, self.contracted([whole(pair) for pair in new]), strict=True)}
            apart: list[int] = []
            for i, pair in enumerate(borders):
                if not fits[pair] and (not apart or i > apart[-1] + 1):
                    apart.append(i)
            if not apart:
                return [x for ids in parts for x in ids]
            mended = dict(zip(apart, self.contracted([whole(parts[i][-k:] + parts[i + 1][:k]) for i in apart]), strict=True))
            after: list[list[int]] = []
            for i, ids in enumerate(parts):
                after.append(ids[k if i - 1 in mended else 0 : len(ids) - k if i in mended and len(ids) > k else 0 if i in mended else len(ids)])
                if i in mended:
                    after.append(mended[i])
            parts = [ids for ids in after if ids]
            k *= 2

    def _query(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and their numbers, from the ids of their bytes given likewise."""
        count = len(lengths)
        names, done = np.arange(count), []
        while len(names):
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self._table("start_rows", {"key": np.repeat(np.arange(len(names)), lengths) << 32 | pos, "id": ids.astype(np.int32)})
            found = self.db.execute(ENCODE.format(rounds=self.s.rounds)).fetchnumpy()
            word, ids, left = found["word"], found["id"], found["round"] >= self.s.rounds
            done.append((names[word[~left]], ids[~left]))
            again, lengths = np.unique(word[left], return_counts=True)
            names, ids = names[again], ids[left]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=count)

    def split(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each text what is known of its words, in order. Words that were not met lately are forgotten first."""
        if self.held > self.s.cache // 2:
            self.older, self.known, self.held = self.known, {}, 0
        parts = [self.words.findall(t) for t in texts]
        met = set().union(*parts).difference(self.known)
        for w in met & self.older.keys():
            self._hold(w, self.older.pop(w))
        self.learn([w for w in met if w not in self.known])
        for p in parts:
            yield list(map(self.known.__getitem__, p))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(",".join(w[0] for w in p).split(","), np.int32) if p else np.zeros(0, np.int32) for p in self.split(texts)]

    def decode(self, coded: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence."""
        return self._texts(np.concatenate(coded) if coded else np.zeros(0, np.int32), np.array([len(x) for x in coded], np.int64))

    def _texts(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of id sequences that stand in a row, by as many queries as their ids ask for."""
        out, ends, at = [b""] * len(lengths), np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < len(lengths):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + self.s.query_tokens, "right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array((ends[at : end + 1] - ends[at]).astype(np.int32)), pa.array(ids[ends[at] : ends[end]].astype(np.int32)))
            self.db.register("coded", pa.table({"doc": pa.array(np.arange(at, end)), "ids": lists}))
            for doc, text, whole in self.db.execute(DECODE).fetchall():
                if not whole:
                    raise ValueError("an id is outside the vocabulary")
                out[doc] = bytes.fromhex(text)
            self.db.unregister("coded")
            at = end
        return out


HELD["byte_bpe"] = Codec.held


def _flat(parts: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(parts), np.int32)


def chunks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode(documents: DataFrame, path: str, pattern: str, settings: Settings | None = None) -> DataFrame:
    """doc_id and ids of every document."""
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern, s)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "ids": codec.encode(texts[a:b])})

    return in_frames(documents.select("doc_id", text_of().alias("text")), run, "doc_id long, ids array<int>", owner="byte_bpe")


def decode(coded: DataFrame, path: str, pattern: str, settings: Settings | None = None) -> DataFrame:
    """doc_id and decoded bytes of each row of doc_id, ids; null ids are none."""
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern, s)
        for frame in frames:
            ids = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "decoded": codec.decode(ids)})

    return in_frames(coded.select("doc_id", "ids"), run, "doc_id long, decoded binary", owner="byte_bpe")


def digest(documents: DataFrame, path: str, pattern: str, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and bytes stay in the worker that made them.

    Ids are decoded word by word: bytes of a text are the bytes of its words in a row.
    """
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(path, pattern, s)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                counts, names, decoded = [], [], []
                for words in codec.split(texts[a:b]):
                    own, back, n = zip(*words, strict=True) if words else ((),) * 3
                    counts.append(sum(n))
                    names.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(back)).hexdigest())
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "n_tokens": counts, "ids_sha256": names, "decoded_sha256": decoded})

    return in_frames(documents.select("doc_id", text_of().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", owner="byte_bpe")
