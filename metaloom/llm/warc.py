"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are dealt into shards by ranges of page_id. The ranges are cut from a histogram of payload
bytes over intervals; an interval with more than a shard's bytes is cut again between its own least
and greatest page_id, and one page_id (or none) by the payload's digest, so that far-off, repeated
and null ids make no large shard. The ranges depend on the rows alone, and no shard is named after
a task. Within a shard records stand in order of page_id; a shard rolls over to its next file when
the compressed file has `file_bytes`. Headers and digests are made anew from the payload. A task
writes under a temporary name and renames when a file is whole, so a lost executor's second
attempt replaces the same files with the same bytes; the manifest, written last, names every
file with its records, bytes and SHA-1, and a reader follows the manifest alone.

Defined results: a null html is an empty payload; null urls are written as empty; records without
a page_id stand in the last shards, and may refer to one that has it; of equal payloads of
`revisit_from` bytes or more the smallest page_id (nulls last) is the response, and of repeated
rows of it, or if none has a page_id, the first in order of url; an empty table gives an empty
manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_frames, keep, new_dir, text_of


@dataclass(frozen=True)
class Settings:
    """file_bytes: compressed bytes at which a shard goes on in its next file; shard_bytes: payload bytes of a shard, more
    where `shards` of them would not do; date: WARC-Date of every record, so that equal rows give equal files.
    """

    file_bytes: int = 4 << 20
    shard_bytes: int = 32 << 20
    shards: int = 20_000
    intervals: int = 16384
    revisit_from: int = 0
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id, url: str, payload: bytes, digest: str, refers_to, revisit: bool, s: Settings) -> bytes:
    """One record: a whole payload, or for a revisit a header that names the first of its kind."""
    own = "" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {url} {digest}')}>"),
        ("WARC-Date", s.date),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Page-ID", own),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers += [("WARC-Block-Digest", f"sha1:{base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def filesystem(uri: str):
    """A file system that serves the folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class Shard:
    """Files of one shard: each is written under a temporary name and renamed when it is whole."""

    def __init__(self, fs, folder: str, number: int, s: Settings):
        self.fs, self.folder, self.number, self.s = fs, folder, number, s
        self.sequence, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.number:06d}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
        pack = zlib.compressobj(self.s.level, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.s.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.number, self.sequence, self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.sequence = None, self.sequence + 1


MANIFEST = "file string, shard int, sequence int, records long, bytes long, sha1 string"


def planned(pages: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """The pages with shard, digest, revisit and refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), text_of("html").alias("html"))
    small = keep(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size")), "digests")
    first = small.where(F.col("size") >= s.revisit_from).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id", F.lit(True).alias("repeated"))
    first = keep(first, "first")
    most = max(s.shard_bytes, -(-(small.agg(F.sum("size")).first()[0] or 0) // s.shards))
    path_of, sizes = _ranges(small, most, s)
    shards, held, number = [], 0, 0
    for path, size in sizes:
        if held and held + size > most:
            held, number = 0, number + 1
        held += size
        shards.append((path, number))
    cut = pages.sparkSession.createDataFrame(shards, "path array<long>, shard int")
    dealt = path_of(rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))).join(F.broadcast(cut), "path")
    marked = dealt.join(_bounded(first), "sha", "left")
    return marked.select("shard", "page_id", "url", "html", "sha", F.col("first_id").alias("refers_to"), F.col("repeated").isNotNull().alias("repeated")), number + 1


def _ranges(small: DataFrame, most: int, s: Settings):
    """A function that adds `path`, the interval of a row and those within it, to rows with page_id and sha; and the bytes of each path in order.

    At most `intervals` rows come to the driver and, for each range of more than `most` bytes, four for each shard that
    it makes, or 4096 for an id.
    """
    spark, steps, by_digest = small.sparkSession, [], set()
    low, high = small.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = low or 0, high or 0
    digest = F.shiftright(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), 20)
    number = lambda low, width: F.expr(f"cast((cast(page_id as decimal(20,0)) - {low}) div {width} as long)")
    start = F.when(F.col("page_id").isNull(), F.array(F.lit(1).cast("long"), digest)).otherwise(F.array(F.lit(0).cast("long"), number(low, -(-(high - low + 1) // s.intervals))))

    def path_of(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("path", start)
        for step in steps:
            within = F.when(F.col("low").isNull(), digest).otherwise(number("low", "width"))
            rows = rows.join(F.broadcast(step), "path", "left")
            rows = rows.withColumn("path", F.when(F.col("width").isNull(), F.col("path")).otherwise(F.concat("path", F.array(within)))).drop("low", "width")
        return rows

    while True:
        found = path_of(small).groupBy("path").agg(F.sum("size").alias("size"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()
        sizes = sorted((list(r.path), r["size"] or 0, r.low, r.high) for r in found)
        more = []
        for path, size, least, greatest in sizes:
            if size <= most or path[0] == 1 or tuple(path[:-1]) in by_digest:
                continue
            if least == greatest:
                by_digest.add(tuple(path))
                more.append((path, None, Decimal(1)))
            else:
                more.append((path, Decimal(least), Decimal(-(-(greatest - least + 1) // (4 * -(-size // most))))))
        if not more:
            return path_of, [(path, size) for path, size, _, _ in sizes]
        steps.append(spark.createDataFrame(more, "path array<long>, low decimal(20,0), width decimal(20,0)"))


def _bounded(side: DataFrame, most: int = 500_000) -> DataFrame:
    """Broadcast up to a count of rows; beyond, a shuffled join."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def write(pages: DataFrame, folder: str, settings: Settings | None = None) -> DataFrame:
    """Writes the archives and their manifest (as JSON lines) into folder; returns the manifest as read back."""
    s = settings or Settings()
    rows, shards = planned(pages, s)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        shard, last, done = None, None, []
        for frame in frames:
            for r in frame.itertuples():
                if shard is None or shard.number != r.shard:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = Shard(fs, path, r.shard, s)
                page_id, refers = r.page_id, r.refers_to
                payload = r.html.encode("utf-8")
                # repeated rows of the response stand in a row: only the first is the response
                is_first = page_id == refers and last != (page_id, r.sha)
                last = (page_id, r.sha)
                shard.add(record_of(page_id, r.url, payload, base32(payload), refers, bool(r.repeated) and not is_first, s))
        if shard is not None:
            shard.close()
            done += shard.done
        yield pd.DataFrame(done, columns=["file", "shard", "sequence", "records", "bytes", "sha1"])

    sorted_rows = rows.repartitionByRange(max(1, shards), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha", "url")
    temporary = f"{folder}/_manifest"
    texts = sorted_rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    texts.mapInPandas(run, MANIFEST).write.json(temporary)
    return pages.sparkSession.read.schema(MANIFEST).json(temporary)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of each record of the manifest's files.

    A file that isn't as the manifest says, or a payload that isn't as its header says, is an error.
    A revisit's payload is null: its length and digest are those of its headers.
    """
    spark = manifest.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = filesystem(folder)
        for frame in frames:
            for f in frame.itertuples():
                found, held, n = [], 0, 0
                with fs.open_input_stream(f"{path}/{f.file}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(Hashed(raw, whole := hashlib.sha1()), 1 << 20)) as stream:
                    for headers, block in records_of(io.BufferedReader(stream, 1 << 20)):
                        found.append(_row(headers, block))
                        held, n = held + len(block), n + 1
                        if held > 8 << 20:
                            yield pd.DataFrame(found, columns=NAMES)
                            found, held = [], 0
                if whole.hexdigest() != f.sha1 or n != f.records:
                    raise ValueError(f"{f.file} is not as the manifest says")
                yield pd.DataFrame(found, columns=NAMES)

    files = manifest.select("file", "records", "sha1").repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, manifest.count())), "file")
    return in_frames(files, run, RECORDS, ("page_id", "refers_to"))


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


class Hashed(io.RawIOBase):
    """Bytes of a stream, hashed as they pass."""

    def __init__(self, raw, sha):
        self.raw_stream, self.sha = raw, sha

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.raw_stream.read(len(buffer))
        buffer[: len(got)] = got
        self.sha.update(got)
        return len(got)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: headers.get(name) or None
    if f"sha1:{base32(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError("a block is not as its digest says")
    revisit, payload = headers["WARC-Type"] == "revisit", None
    if not revisit:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if base32(payload) != digest:
            raise ValueError("a payload is not as its digest says")
    size = int(headers["WARC-Payload-Length"]) if revisit else len(payload)
    return number("WARC-Page-ID"), size, digest, "revisit" if revisit else "response", number("WARC-Refers-To-Page-ID") if revisit else None, headers.get("WARC-Target-URI", ""), payload and payload.decode("utf-8")


def round_trip(spark: SparkSession, pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    folder = new_dir(spark, "warc")
    return read(write(pages, folder, settings), folder)
