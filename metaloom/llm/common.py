"""What the operators of this subpackage share: reading tables and keeping intermediate results."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new folder where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("metaloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="metaloom-")
        spark.conf.set("metaloom.shared.dir", found)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, so that two runs never meet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    That cuts the lineage, and what is read later survives lost executors.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column whose nulls are empty texts."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some megabytes instead of ten thousand rows of any length, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, "2m")


#: What modules hold in a worker from one partition to the next, by the module's name.
HELD: dict[str, dict] = {}


def trimmed() -> None:
    """Hands back what this process' allocators hold unused."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(owner: str = "") -> None:
    """Forgets what modules other than owner hold, since a later stage finds the workers of earlier ones and would stand beside all that."""
    others = [held for name, held in HELD.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
        trimmed()


def releasing(run: Callable, owner: str = "") -> Callable:
    """run, whose worker first forgets what others hold, and hands back unused memory once a partition is done."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        released(owner)
        yield from run(frames)
        trimmed()

    return whole


def in_frames(rows: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",), owner: str = "") -> DataFrame:
    """mapInPandas with ids carried as text: beside a null, pandas turns whole numbers into floats, and those over 2 ** 53 change."""
    small_batches(rows.sparkSession)
    declared = StructType.fromDDL(schema)
    carried = StructType([StructField(f.name, StringType()) if f.name in ids else f for f in declared])
    found = rows.withColumns({c: F.col(c).cast("string") for c in ids if c in rows.columns}).mapInPandas(releasing(run, owner), carried)
    return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in declared if f.name in ids})
