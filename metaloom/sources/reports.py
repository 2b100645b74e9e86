"""Metadata reports in plain text: objects by `- path`, and below them deeper lines of Key: "value".

The text is one row; a short walk over its lines keeps the state (which object is open, how deep,
which value is unfinished), and its objects come out some thousand at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import vocabulary as words

ONE_LINE = re.compile(r'([^:]+):\s*"(.*)"')
OPEN = re.compile(r"([^:]+):")
#: Objects that leave a task at a time.
PART = 2000


def indentation(line: str) -> int:
    head = line[: len(line) - len(line.lstrip(" \t"))]
    return len(head.replace("\t", " " * 4))


def objects_of(text: str) -> list[tuple[str, dict[str, str]]]:
    """Path and properties of each object of a report."""
    return list(each_object(text))


def lines_of(text: str, size: int = 1 << 16) -> Iterator[str]:
    """The lines of a text, cut from one stretch of it at a time."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size) + 1 or len(text)
        yield from text[at:end].splitlines()
        at = end


def each_object(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """The same one by one: neither all lines nor all objects are held."""
    depth, found, lines = None, None, lines_of(text)
    line = next(lines, None)
    while line is not None:
        deep, own = indentation(line), line.strip()
        line = next(lines, None)
        if own.startswith("- "):
            if found is not None:
                yield found
            found = own[2:].strip(), {}
            depth = deep
        elif own and depth is not None:
            if deep <= depth:
                depth = None
            elif m := ONE_LINE.fullmatch(own):
                found[1][m[1].strip()] = m[2]
            elif m := OPEN.fullmatch(own):
                found[1][m[1].strip()], line = _quoted(line, lines, deep)
    if found is not None:
        yield found


def _quoted(line: str | None, lines: Iterator[str], depth: int) -> tuple[str, str | None]:
    """A value in quotes over several deeper lines from this one on, and the line after it."""
    parts: list[str] = []
    level = None
    while line is not None:
        deep, own = indentation(line), line.strip()
        if level is None and not (deep > depth and own.startswith('"')):
            break
        level = deep if level is None else level
        if own and (deep < level or deep == level and ":" in own and not own.startswith('"')):
            break
        line = next(lines, None)
        ends = own.endswith('"') and not own.endswith('\\"') and (own != '"' or bool(parts))
        bare = own[1:] if own.startswith('"') and len(own) > 1 else own
        parts.append(bare[:-1] if ends else bare.removeprefix('"') if own == '"' else bare)
        if ends:
            break
    return "\n".join(parts), line


def kind_and_name(path: Column) -> Column:
    """What kind of thing a dotted path names, and its last part."""
    table = lambda m: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))
    parts = F.split(path, "\\.")
    n, first, before = F.size(parts), F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-2))
    known = F.try_element_at(table(words.REPORT_SINGULARS), first)
    part = F.try_element_at(table(words.REPORT_PARTS), before)
    kind = F.when(n == 1, F.coalesce(known, first)).when((n > 2) & part.isNotNull(), part).when(known.isNotNull() & (n > 2), before).otherwise(first)
    return F.struct(F.coalesce(kind, F.lit(words.UNKNOWN_TYPE)).alias("object_type"), F.element_at(parts, -1).alias("name"))


def report_objects(texts: DataFrame) -> DataFrame:
    """full_path, object_type, name, properties, source_file. texts: path, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                name, found = path.as_py(), each_object(text.as_py() or "")
                while part := list(islice(found, PART)):
                    yield pa.RecordBatch.from_pylist([{"source_file": name, "full_path": o, "properties": list(x.items())} for o, x in part], schema=made)

    made = pa.schema([("source_file", pa.string()), ("full_path", pa.string()), ("properties", pa.map_(pa.string(), pa.string()))])
    rows = texts.select("path", "text").mapInArrow(run, "source_file string, full_path string, properties map<string,string>")
    return rows.withColumn("_k", kind_and_name(F.col("full_path"))).select("full_path", "_k.object_type", "_k.name", "properties", "source_file")
