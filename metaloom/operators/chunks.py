"""Texts in chunks of bounded length that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces between the first separator that occurs, joined up to `size`; a piece that is too long is split by the next one.

    Neighbours share as many whole pieces as fit into `overlap`.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    pieces = list(text) if separator == "" else _with_separator(text, separator)
    out, group = [], []
    for piece in pieces:
        if len(piece) > size and rest:
            out += _joined(group, size, overlap)
            group = []
            out += split(piece, size, overlap, rest)
        else:
            group.append(piece)
    return out + _joined(group, size, overlap)


def _with_separator(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [x for x in out if x]


def chunks(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_index, chunk; a null or blank text has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "parts": [split(t or "", size, overlap) for t in frame[text]]})

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(key, text).mapInPandas(run, f"{key} {kind}, parts array<string>")
    return parts.select(key, F.posexplode("parts").alias("chunk_index", "chunk"))


def function_chunks(rows: DataFrame, keys: list[str], card: Column, header: Column, body: Column, most: int = 2000) -> DataFrame:
    """keys, chunk_index, chunk: the card, or header and body where there is none; cut only beyond `most` characters."""
    content = F.coalesce(card, F.concat(header, body))
    tagged = rows.select(*keys, content.alias("_content")).withColumn("_key", F.xxhash64(*keys, "_content"))
    whole = tagged.where(F.length("_content") <= most).select(*keys, F.lit(0).alias("chunk_index"), F.col("_content").alias("chunk"))
    long = tagged.where(F.length("_content") > most)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t))

    return whole.unionByName(long.select(*keys, F.posexplode(cut("_content")).alias("chunk_index", "chunk")))


def metadata_text(path: Column, kind: Column, name: Column, properties: Column) -> Column:
    """What is embedded of a metadata object: path, kind, name and its properties, a line each."""
    lines = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", path, kind, name, F.array_join(lines, "\n"))
