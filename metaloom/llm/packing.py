"""Best-fit-decreasing packing of token ids into rows of one length, written as binary matrices.

Each partition takes documents until `buffer_tokens` are held, cuts those longer than a row, sorts
the pieces by length and puts each into the fullest row that still has room for it, which a
segment tree over remaining capacities finds. No text moves between tasks; a document's pieces
stay in one matrix. Every matrix is three files: ids (uint16 or uint32, row after row, padded),
lengths (int32: for each row the number of segments, then their cumulative lengths) and positions
(zstd of the steps between position ids, which restart with each segment).

A task writes under temporary names and renames whole files, named after partition and buffer; the
manifest, written last, lists them with the documents' pieces, and a reader follows it alone.

Defined results: a null text is an empty one; every document ends in the end token, so an empty
one has one id; a null doc_id is kept; repeated rows are packed each; an empty table gives an
empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_frames, new_dir, text_of
from .warc import filesystem


@dataclass(frozen=True)
class Settings:
    row: int = 2048
    buffer_tokens: int = 2_000_000
    end: int = 50256
    pad: int = 50256
    ids: int = 50257

    @property
    def kind(self) -> str:
        return "<u2" if max(self.end, self.pad, self.ids - 1) < 2**16 else "<u4"


class Capacities:
    """A segment tree over remaining capacities 0..most: each leaf has the rows with so much room, each node how many rows are below it."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of the least capacity that is at least `need`, and that capacity; it leaves the tree."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        self._change(capacity, -1)
        return row, capacity

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """For each row the pieces in it: longest pieces first, each into the fullest row that has room."""
    tree, rows = Capacities(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        at, room = found if found else (len(rows), row)
        if found is None:
            rows.append([])
        rows[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return rows


def matrix_of(docs: list[np.ndarray], s: Settings) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[tuple[int, int, int, int]]]:
    """ids and positions as matrices, cumulative lengths of each row, and pieces as (document, its offset, row, column)."""
    pieces = [(d, at, min(s.row, len(ids) - at)) for d, ids in enumerate(docs) for at in range(0, len(ids), s.row)]
    rows = best_fit([n for _, _, n in pieces], s.row)
    ids, positions = np.full((len(rows), s.row), s.pad, s.kind), np.zeros((len(rows), s.row), np.int32)
    if any(len(d) and d.max() > np.iinfo(ids.dtype).max for d in docs):
        raise ValueError("an id is too large for the matrices: state the vocabulary's size in Settings.ids")
    lengths, places = [], []
    for r, inside in enumerate(rows):
        at, ends = 0, [0]
        for i in inside:
            d, start, n = pieces[i]
            ids[r, at : at + n] = docs[d][start : start + n]
            positions[r, at : at + n] = np.arange(n)
            places.append((d, start, r, at))
            at += n
            ends.append(at)
        positions[r, at:] = np.arange(s.row - at)
        lengths.append(np.array(ends, np.int32))
    return ids, lengths, positions, places


MANIFEST = "file string, rows long, sha1 string, keys array<string>, document array<int>, start array<int>, row array<int>, column array<int>"


def write(documents: DataFrame, folder: str, vocabulary: str, pattern: str, settings: Settings | None = None) -> DataFrame:
    """Packs the documents into files in folder; returns the manifest as read back."""
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, sequence, held, ids, keys = TaskContext.get().partitionId(), 0, 0, [], []
        coder = encoding(vocabulary, pattern)
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids.append(np.array([*coder.encode_ordinary(text), s.end], np.uint32))
                keys.append(doc_id)
                held += len(ids[-1])
                if held >= s.buffer_tokens:
                    yield flushed(fs, path, f"part-{part:06d}-{sequence:05d}", keys, ids, s)
                    sequence, held, ids, keys = sequence + 1, 0, [], []
        if ids:
            yield flushed(fs, path, f"part-{part:06d}-{sequence:05d}", keys, ids, s)

    temporary = f"{folder}/_manifest"
    documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(run, MANIFEST).write.parquet(temporary)
    return documents.sparkSession.read.parquet(temporary)


def flushed(fs, path: str, name: str, keys: list[str | None], docs: list[np.ndarray], s: Settings) -> pd.DataFrame:
    import zstandard

    ids, lengths, positions, places = matrix_of(docs, s)
    steps = np.diff(positions.ravel(), prepend=0).astype("<i4")
    whole = hashlib.sha1()
    for ending, content in (("ids", ids.tobytes()), ("lengths", b"".join(np.append(len(x) - 1, x).astype("<i4").tobytes() for x in lengths)), ("positions", zstandard.ZstdCompressor(level=1).compress(steps.tobytes()))):
        temporary = f"{path}/_temporary-{name}.{ending}-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(content)
        fs.move(temporary, f"{path}/{name}.{ending}")
        whole.update(content)
    document, start, row, column = (np.array(x, np.int32) for x in zip(*places, strict=True))
    return pd.DataFrame({"file": [name], "rows": [len(ids)], "sha1": [whole.hexdigest()], "keys": [keys], "document": [document], "start": [start], "row": [row], "column": [column]})


def encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def load(fs, path: str, name: str, sha1: str, s: Settings) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """ids, cumulative lengths and position ids of a matrix; an error if the files aren't as the manifest says."""
    import zstandard

    whole, parts = hashlib.sha1(), []
    for ending in ("ids", "lengths", "positions"):
        with fs.open_input_stream(f"{path}/{name}.{ending}", compression=None) as stream:
            parts.append(stream.read())
        whole.update(parts[-1])
    if whole.hexdigest() != sha1:
        raise ValueError(f"{name} is not as the manifest says")
    flat, lengths, at = np.frombuffer(parts[1], "<i4"), [], 0
    while at < len(flat):
        lengths.append(flat[at + 1 : at + 2 + flat[at]])
        at += 2 + flat[at]
    ids = np.frombuffer(parts[0], s.kind).reshape(-1, s.row)
    return ids, lengths, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[2]), "<i4")).reshape(ids.shape)


def read(manifest: DataFrame, folder: str, settings: Settings | None = None) -> DataFrame:
    """Documents put together again from the matrices: doc_id, n_tokens, n_pieces, ids_sha256 (of decimal ids joined by commas, without the end), file.

    Pieces are taken from the cumulative lengths, and their position ids must count from 0.
    """
    s = settings or Settings()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        for frame in frames:
            for f in frame.itertuples():
                ids, lengths, positions = load(fs, path, f.file, f.sha1, s)
                pieces: dict[int, list[tuple[int, np.ndarray]]] = {}
                for d, start, r, c in zip(f.document, f.start, f.row, f.column, strict=True):
                    end = int(lengths[r][np.searchsorted(lengths[r], c, side="right")])
                    if (positions[r, c:end] != np.arange(end - c)).any():
                        raise ValueError(f"{f.file}: positions of row {r} don't restart at {c}")
                    pieces.setdefault(int(d), []).append((int(start), ids[r, c:end]))
                rows = []
                for d, parts in sorted(pieces.items()):
                    whole = np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])
                    if whole[-1] != s.end:
                        raise ValueError(f"{f.file}: document {d} has no end")
                    rows.append((f.keys[d], len(whole), len(parts), hashlib.sha256(",".join(map(str, whole[:-1].tolist())).encode()).hexdigest(), f.file))
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_pieces", "ids_sha256", "file"])

    return in_frames(manifest, run, "doc_id long, n_tokens long, n_pieces long, ids_sha256 string, file string", ("doc_id",))


def round_trip(spark: SparkSession, documents: DataFrame, vocabulary: str, pattern: str, settings: Settings | None = None) -> DataFrame:
    folder = new_dir(spark, "packed")
    return read(write(documents, folder, vocabulary, pattern, settings), folder, settings)
