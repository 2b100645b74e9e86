"""Listings and contents of source trees, read by Spark: any store that Spark reads will do."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .decode import CODE, decoded


def scan(spark: SparkSession, root: str, glob: str, only: str | None = None) -> DataFrame:
    """path (below root), mtime, size, content of files whose name fits; a listing that never selects content doesn't read it.

    only: the path below root of one file; no other is listed, and there is no row where it is gone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if only is None:
        rows = reader.load(root)
    else:
        literal = re.sub(r"([\\\[\]{}*?])", r"\\\1", only)
        try:
            rows = reader.load(f"{root.rstrip('/')}/{literal}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return rows.select(below(root, F.col("path")).alias("path"), F.col("path").alias("full_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def below(root: str, path: Column) -> Column:
    """The path after root, whatever scheme Spark put before it."""
    bare = F.lit(root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/")
    at = F.instr(path, bare)
    return F.when(at > 0, F.expr("substring(path, 1)").substr(at + F.length(bare), F.length(path))).otherwise(path)


def texts(spark: SparkSession, root: str, glob: str, encodings: tuple[str, ...] = CODE, only: str | None = None) -> DataFrame:
    """path, module_key, text, hash of each file."""
    rows = scan(spark, root, glob, only).withColumn("_read", decoded(F.col("content"), encodings))
    return rows.select("path", paths.module_key(F.col("full_path")).alias("module_key"), "mtime", "size", F.sha2("content", 256).alias("hash"), F.col("_read.text").alias("text"))


def in_roots(path: Column, folders: list[str]) -> Column:
    """The kind folder of a file that lies right in it, below the root itself, `cf`, `src` or an extension of `cfe`; else null."""
    found = F.regexp_extract(path, rf"^(?:cf/|src/|cfe/[^/]+/)?({'|'.join(folders)})/[^/]+$", 1)
    return F.nullif(found, F.lit(""))


def skipped(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits one of the shell patterns as a whole."""
    if not patterns:
        return F.lit(False)
    import fnmatch

    return F.rlike(path, F.lit("^(?:" + "|".join(fnmatch.translate(p).replace("\\Z", "").replace("\\z", "") for p in patterns) + ")$"))
