"""What was indexed, what failed and what is tried again: one row for each file and collection, and one for each definition.

A round compares the listing of a tree with the ledger, tries what is due, and writes both ledgers beside the
vectors of its snapshot. A file of which some chunk has no vector failed; it is due in the next rounds, `most` times
in a row at most, until its content changes. A file without chunks is skipped, and isn't due again as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental

KEYS = ["path", "collection"]
FILES = "path string, collection string, hash string, indexed_at timestamp, status string, error_message string, retry_count int"
DEFINITIONS = "path string, function_name string, collection string, hash string, indexed_at timestamp"


@dataclass
class Ledger:
    files: DataFrame
    definitions: DataFrame

    def save(self, folder: str) -> Ledger:
        """Writes both below a new folder and reads them back."""
        self.files.write.mode("overwrite").parquet(f"{folder}/files")
        self.definitions.write.mode("overwrite").parquet(f"{folder}/definitions")
        return load(self.files.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(spark.read.schema(FILES).parquet(f"{folder}/files"), spark.read.schema(DEFINITIONS).parquet(f"{folder}/definitions"))


def empty(spark: SparkSession) -> Ledger:
    return Ledger(spark.createDataFrame([], FILES), spark.createDataFrame([], DEFINITIONS))


def due(files: DataFrame, listing: DataFrame, most: int = 3) -> DataFrame:
    """path, collection, hash, why (new, modified, retry) of what a round tries. listing: path, collection, hash of all that is there."""
    known = files.select(*KEYS, F.col("hash").alias("_hash"), "status", "retry_count", F.lit(True).alias("_known"))
    again = (F.col("status") == "failed") & (F.col("retry_count") < most)
    why = F.when(F.col("_known").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("_hash")), "modified").when(again, "retry")
    return listing.select(*KEYS, "hash").join(known, KEYS, "left").select(*KEYS, "hash", why.alias("why")).where("why is not null")


def given_up(files: DataFrame, listing: DataFrame, most: int = 3) -> DataFrame:
    """path, collection of what failed too often and is still the same."""
    failed = files.where((F.col("status") == "failed") & (F.col("retry_count") >= most))
    return failed.join(listing.select(*KEYS, "hash"), [*KEYS, "hash"], "left_semi").select(*KEYS)


def outcomes(tried: DataFrame, wanted: DataFrame, made: DataFrame, at: str) -> DataFrame:
    """The updates that a round gives: wanted are the chunks of all files (path, collection, id), made those with a vector; at is a timestamp."""
    counted = wanted.select(*KEYS, "id").join(made.select(*KEYS, "id", F.lit(1).alias("_made")), [*KEYS, "id"], "left").groupBy(*KEYS).agg(F.count("*").alias("_wanted"), F.count("_made").alias("_got"))
    rows = tried.select(*KEYS, "hash").join(counted, KEYS, "left")
    lacking = F.col("_wanted") - F.col("_got")
    status = F.when(F.col("_wanted").isNull(), "skipped").when(lacking > 0, "failed").otherwise("indexed")
    reason = F.when(F.col("_wanted").isNull(), F.lit("no chunks")).when(lacking > 0, F.concat(lacking.cast("string"), F.lit(" of "), F.col("_wanted").cast("string"), F.lit(" chunks have no vector")))
    return rows.select(*KEYS, "hash", F.lit(at).cast("timestamp").alias("indexed_at"), status.alias("status"), reason.alias("error_message"))


def files_after(files: DataFrame, listing: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger of files with the updates, without files that are gone."""
    present = files.join(listing.select(*KEYS), KEYS, "left_semi")
    return incremental.ledger_after(present, updates)


def definitions_after(definitions: DataFrame, bodies: DataFrame, files: DataFrame, at: str, collection: str = "code") -> tuple[DataFrame, DataFrame]:
    """The ledger of definitions, and those whose body it didn't know (path, function_name, hash). bodies: path, function_name, body of all there are.

    Definitions of files that failed stay unknown; those that are gone are forgotten. Of equal names in a file the
    last in the file, and then the greatest body, stands for all.
    """
    order = ["line_start", "body"] if "line_start" in bodies.columns else ["body"]
    one = incremental.last_write_wins(bodies, ["path", "function_name"], order)
    own, others = definitions.where(F.col("collection") == collection), definitions.where(~F.col("collection").eqNullSafe(collection))
    changed = incremental.changed_bodies(one.select("path", "function_name", "body"), own).select("path", "function_name", "hash")
    failed = files.where((F.col("collection") == collection) & (F.col("status") == "failed")).select("path")
    updates = changed.join(failed, "path", "left_anti").withColumns({"collection": F.lit(collection), "indexed_at": F.lit(at).cast("timestamp")})
    present = own.join(one.select("path", "function_name"), ["path", "function_name"], "left_semi")
    return others.unionByName(incremental.functions_after(present, updates)), changed
