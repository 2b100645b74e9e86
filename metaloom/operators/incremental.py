"""Changes between snapshots, and the ledger of what was indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import last_write_wins


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, status (new, modified, unchanged, deleted): a full outer join of two listings."""
    a = old.select(F.col(key), F.col(fingerprint).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(fingerprint).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def detect_changes(stored: DataFrame, listing: DataFrame, contents: DataFrame) -> DataFrame:
    """path, status, hash of files: stat first, and only suspects are read and hashed.

    stored: path, mtime, size, hash. listing: path, mtime, size (a listing without contents).
    contents: path, content. Status `touched` has a new stat and the old content.
    """
    s = stored.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("hash").alias("_hash"), F.lit(True).alias("_stored"))
    both = listing.withColumn("_listed", F.lit(True)).join(s, "path", "full_outer")
    same = (F.abs(F.unix_micros("mtime") - F.unix_micros("_mtime")) <= 1) & (F.col("size") == F.col("_size"))
    suspects = both.where(F.col("_listed") & ~F.coalesce(same, F.lit(False))).select("path")
    hashed = contents.join(suspects, "path", "left_semi").select("path", F.sha2("content", 256).alias("hash"))
    rows = both.join(hashed, "path", "left")
    status = F.when(F.col("_listed").isNull(), "deleted").when(F.col("_stored").isNull(), "new").when(F.col("hash").isNull(), "unchanged")
    status = status.when(F.col("hash") == F.col("_hash"), "touched").otherwise("modified")
    return rows.select("path", status.alias("status"), F.coalesce("hash", "_hash").alias("hash"))


def changed_bodies(bodies: DataFrame, ledger: DataFrame) -> DataFrame:
    """Functions whose body the ledger doesn't know. bodies: path, function_name, body."""
    return bodies.withColumn("hash", F.sha2("body", 256)).join(ledger.select("path", "function_name", "hash"), ["path", "function_name", "hash"], "left_anti")


def replaced(stored: DataFrame, fresh: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The stored rows without those removed or renewed, and the fresh ones: to be written as a new snapshot at once."""
    out = removed.select(key).unionByName(fresh.select(key)).distinct()
    return stored.join(out, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def ledger_after(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger after status updates (path, collection, hash, indexed_at, status, error_message): the last one of a key holds, and a failure counts once."""
    keys = ["path", "collection"]
    last = last_write_wins(updates, keys, ["indexed_at"])
    before = ledger.select(*keys, F.col("retry_count").alias("_count"))
    counted = last.join(before, keys, "left").withColumn("retry_count", F.when(F.col("status") == "failed", F.coalesce("_count", F.lit(0)) + 1).otherwise(F.lit(0)).cast("int")).drop("_count")
    return ledger.join(counted.select(*keys), keys, "left_anti").unionByName(counted.select(ledger.columns))


def functions_after(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger of definitions (path, function_name, collection, hash, indexed_at) after updates: the last one of a key holds."""
    keys = ["path", "function_name", "collection"]
    last = last_write_wins(updates, keys, ["indexed_at"])
    return ledger.join(last.select(*keys), keys, "left_anti").unionByName(last.select(ledger.columns))


def forgotten(ledger: DataFrame, files: DataFrame, collection: str) -> DataFrame:
    """A ledger, of files or of definitions, without what it has of these files (path) in a collection: they are new again."""
    gone = files.select("path", F.lit(collection).alias("collection"))
    return ledger.join(gone, ["path", "collection"], "left_anti")


def cleared(ledger: DataFrame, collection: str | None = None) -> DataFrame:
    """A ledger or a table of vectors without one collection, or empty."""
    return ledger.where(F.lit(False) if collection is None else ~F.col("collection").eqNullSafe(collection))


def file_status(ledger: DataFrame, listing: DataFrame, collection: str) -> DataFrame:
    """path, status of each file for a collection: listing (path, hash) against what the ledger has of it."""
    return snapshot_diff(ledger.where(F.col("collection") == collection), listing, "path", "hash")


def retry_queue(ledger: DataFrame, collection: str | None = None, max_retries: int = 3) -> DataFrame:
    rows = ledger.where((F.col("status") == "failed") & (F.col("retry_count") < max_retries))
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    return rows.orderBy("retry_count", "indexed_at", "path")


def swept(ledger: DataFrame, present: DataFrame, collection: str) -> DataFrame:
    """Ledger rows of a collection whose file is gone."""
    return ledger.where(F.col("collection") == collection).join(present.select("path"), "path", "left_anti")


def status_counts(ledger: DataFrame) -> DataFrame:
    """collection, counts: a map of status to number of files."""
    counted = ledger.groupBy("collection", "status").count()
    return counted.groupBy("collection").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("counts"))


def pivoted(rows: DataFrame, key: str, column: str, values: list, prefix: str) -> DataFrame:
    """Counts of each value of a column by key, the values being given so that no pass is needed to find them."""
    counts: list[Column] = [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]
    return rows.groupBy(key).agg(*counts)
