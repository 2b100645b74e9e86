"""Continuous additions from a folder of module files. Beyond what the catalogue asks for: deletions still need a snapshot comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.code import functions
from ..sources.decode import decoded


def module_stream(spark: SparkSession, root: str, glob: str = "*.bsl", per_trigger: int = 1000) -> DataFrame:
    """path, module_key, text, hash of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(root)
    read = rows.withColumn("_r", decoded(F.col("content")))
    return read.select("path", paths.module_key(F.col("path")).alias("module_key"), F.sha2("content", 256).alias("hash"), F.col("_r.text").alias("text"))


def append_functions(stream: DataFrame, target: str, checkpoint: str):
    """A query that writes the definitions of arriving files, each batch into a folder of its own so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        functions(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and time window; rows later than the watermark are left out, so state stays bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
