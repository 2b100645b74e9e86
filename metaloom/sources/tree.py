"""An exported tree as a data source: its listing in partitions by folder, and as a stream of what came, changed and went.

    spark.dataSource.register(ExportTree)
    spark.read.format("export_tree").option("path", root).option("glob", "*.bsl").load()

The folders right below the root are the partitions of a listing, and its own files one more, so tasks walk the tree and the
driver lists one folder. A stream's offset is a number of a listing kept under `state`; a batch is the difference of
two listings, so deletions arrive as rows too. The driver makes a stream's listings, a folder at a time, as Spark asks it for
offsets; their differences are taken by tasks. The tree and `state` are folders that driver and executors share.

Defined results: no folder, or an empty one, has no rows (in a stream, all that was there is deleted); a file that goes while it is listed has no row; links to
folders aren't followed; a batch that is asked for again gives the same rows, as listings are never changed.
"""

from __future__ import annotations

import fnmatch
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTING = "path string, mtime timestamp, size long"
CHANGES = "path string, status string, mtime timestamp, size long"


@dataclass
class Folder(InputPartition):
    """A folder below the root, with all below it or (deep=False) its own files alone."""

    name: str
    deep: bool


@dataclass
class Between(InputPartition):
    """Two listings and a folder of the tree."""

    start: int
    end: int
    folder: str


def walk(root: str, folder: Folder, glob: str) -> Iterator[tuple[str, int, int]]:
    """Path below root, time of change in microseconds and size of the files whose name fits."""
    for at, folders, names in os.walk(os.path.join(root, folder.name)):
        if not folder.deep:
            folders.clear()
        for name in fnmatch.filter(names, glob):
            full = os.path.join(at, name)
            try:
                found = os.stat(full)
            except FileNotFoundError:
                continue
            yield os.path.relpath(full, root), found.st_mtime_ns // 1000, found.st_size


def folders_of(root: str) -> list[Folder]:
    if not os.path.isdir(root):
        return []
    with os.scandir(root) as entries:
        return [Folder("", False), *(Folder(n, True) for n in sorted(e.name for e in entries if e.is_dir(follow_symlinks=False)))]


def moment(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1e6, timezone.utc)


class Listing(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")

    def partitions(self) -> list[InputPartition]:
        return folders_of(self.root) or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for path, mtime, size in walk(self.root, partition, self.glob):
            yield path, moment(mtime), size


class Changes(DataSourceStreamReader):
    """Listings are files `state/<number>/<folder>`, renamed into place once they are whole."""

    def __init__(self, options: dict):
        self.root, self.glob, self.state = options["path"], options.get("glob", "*"), options["state"]

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The newest listing's number, a new one if the tree isn't as that one says."""
        os.makedirs(self.state, exist_ok=True)
        last = max((int(n) for n in os.listdir(self.state) if n.isdigit()), default=0)
        draft = os.path.join(self.state, f"draft-{uuid.uuid4().hex}")
        os.makedirs(draft)
        same = True
        for folder in folders_of(self.root):
            rows = sorted(walk(self.root, folder, self.glob))
            same = same and rows == sorted(self._rows(last, folder.name))
            with open(os.path.join(draft, "in-" + folder.name), "w", encoding="utf-8") as out:
                out.writelines(json.dumps(r) + "\n" for r in rows)
        if same and self._names(last) <= set(os.listdir(draft)):
            for n in os.listdir(draft):
                os.remove(os.path.join(draft, n))
            os.rmdir(draft)
            return {"listing": last}
        os.rename(draft, os.path.join(self.state, str(last + 1)))
        return {"listing": last + 1}

    def _names(self, number: int) -> set[str]:
        at = os.path.join(self.state, str(number))
        return set(os.listdir(at)) if number else set()

    def _rows(self, number: int, folder: str) -> list[tuple[str, int, int]]:
        if f"in-{folder}" not in self._names(number):
            return []
        with open(os.path.join(self.state, str(number), f"in-{folder}"), encoding="utf-8") as rows:
            return [tuple(json.loads(r)) for r in rows]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = self._names(start["listing"]) | self._names(end["listing"])
        return [Between(start["listing"], end["listing"], n.removeprefix("in-")) for n in sorted(names)]

    def read(self, partition: Between) -> Iterator[tuple]:
        before, now = ({p: (m, s) for p, m, s in self._rows(n, partition.folder)} for n in (partition.start, partition.end))
        for path in sorted(before.keys() | now.keys()):
            if path not in now:
                yield path, "deleted", None, None
            elif before.get(path) != now[path]:
                mtime, size = now[path]
                yield path, "modified" if path in before else "new", moment(mtime), size


class ExportTree(DataSource):
    """Options: path, glob (of file names), and for a stream state, a folder for listings."""

    @classmethod
    def name(cls) -> str:
        return "export_tree"

    def schema(self) -> str:
        return CHANGES if "state" in self.options else LISTING

    def reader(self, schema) -> DataSourceReader:
        return Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Changes(self.options)
