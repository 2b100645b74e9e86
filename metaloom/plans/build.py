"""From an exported source tree to the tables of the index, and back again after changes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..operators import graph, incremental, joins
from ..operators.lookup import folded
from ..operators.postings import Postings
from ..sources import code, files, xml
from .shared import keep
from .vocabulary import Vocabulary


@dataclass
class Index:
    """The tables, one DataFrame each."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    query_refs: DataFrame
    bodies: DataFrame
    objects: DataFrame
    attributes: DataFrame
    tab_parts: DataFrame
    tab_part_attributes: DataFrame
    register_movements: DataFrame
    subscriptions: DataFrame
    entry_points: DataFrame

    def save(self, folder: str) -> Index:
        """Writes all tables below a new folder and reads them back; a reader of another snapshot isn't disturbed.

        Tables that are looked up by a name carry it in lower case, are sorted by it within their files, and have a Bloom
        filter of it, so that a lookup by equality reads the row groups alone that may hold the name.
        """
        spark = self.files.sparkSession
        for name in TABLES:
            rows = getattr(self, name)
            if name in LOOKED_UP:
                column, key = LOOKED_UP[name]
                rows = rows.drop(key).withColumn(key, folded(column)).sortWithinPartitions(key)
                rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{folder}/{name}")
            else:
                rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return load(spark, folder)


TABLES = tuple(f.name for f in fields(Index))
#: The column of a table that lookups compare, and the one that has it in lower case.
LOOKED_UP = {"symbols": ("name", "name_key"), "objects": ("name", "name_key"), "edges": ("callee_name", "callee_key")}


def named(rows: DataFrame, table: str, name: str) -> Column:
    """Whether a row's name is this one whatever its case: by the stored key where there is one, so that Parquet can skip."""
    column, key = LOOKED_UP[table]
    return (F.col(key) if key in rows.columns else folded(column)) == name.lower()


def load(spark: SparkSession, folder: str) -> Index:
    return Index(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})


def rebuild(spark: SparkSession, root: str, folder: str, v: Vocabulary | None = None) -> Index:
    """Reads a tree, parses everything, resolves edges and handlers, ranks symbols, and writes the tables."""
    v = v or Vocabulary()
    modules = code.tables(files.texts(spark, root, "*.bsl"), v)
    found = xml.flat(xml.objects(files.scan(spark, root, "*.xml")))
    index = Index(subscriptions=xml.subscriptions(files.scan(spark, root, "*.xml")), entry_points=xml.entry_points(files.scan(spark, root, "*.xml")), **modules, **found)
    return resolved(index.save(f"{folder}/parsed")).save(f"{folder}/tables")


def resolved(index: Index) -> Index:
    """Edges with their ends and kinds, handlers with their symbols, symbols with their rank."""
    placed = index.symbols.join(index.files.select("file_id", "object_name", "module_type"), "file_id")
    edges = graph.classify(index.edges.drop("dst_symbol_id", "resolved", "edge_type"), placed)
    ranks = graph.pagerank(index.symbols.select(F.col("symbol_id").alias("id")), edges.where("resolved").select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst")))
    symbols = index.symbols.drop("centrality").join(ranks.select(F.col("id").alias("symbol_id"), F.col("rank").alias("centrality")), "symbol_id", "left")
    handled = lambda df: handlers(df.drop("handler_symbol_id"), placed)
    return Index(**{name: getattr(index, name) for name in TABLES} | {"edges": edges, "symbols": symbols, "subscriptions": handled(index.subscriptions), "entry_points": handled(index.entry_points)})


def handlers(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """handler_symbol_id of rows with handler_module and handler_method; null where there is no such symbol."""
    targets = symbols.select(F.col("object_name").alias("handler_module"), folded("name").alias("_method"), "symbol_id")
    return joins.resolve_least(rows.withColumn("_method", folded("handler_method")), targets, ["handler_module", "_method"], "symbol_id", "handler_symbol_id").drop("_method")


def changes(index: Index, spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """path (module key), status, hash of the modules of a tree, or of `only` one, against the index; only files whose stat differs are read."""
    rows = files.scan(spark, root, "*.bsl", only)
    listing = rows.select(paths.module_key(F.col("full_path")).alias("path"), "mtime", "size")
    contents = rows.select(paths.module_key(F.col("full_path")).alias("path"), "content")
    stored = index.files.select("path", "mtime", "size", F.col("file_hash").alias("hash"))
    if only is not None:
        stored = stored.where(F.col("path") == paths.module_key(F.lit(f"{root.rstrip('/')}/{only}")))
    return incremental.detect_changes(stored, listing, contents)


def update(index: Index, spark: SparkSession, root: str, folder: str, v: Vocabulary | None = None, only: str | None = None) -> tuple[Index, dict[str, int]]:
    """Replaces what changed, purges what is gone, resolves what that touches; ranks stay as they were until `resolved` is called.

    With `only`, a path below root, no other module is looked at.
    The new snapshot is written whole into folder before anyone reads it.
    """
    status = changes(index, spark, root, only).cache()
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    touched = status.where("status in ('new', 'modified', 'touched')").select(F.col("path").alias("module_key"))
    fresh = code.tables(files.texts(spark, root, "*.bsl", only=only).join(touched, "module_key", "left_semi"), v)
    out = status.where("status in ('modified', 'deleted', 'touched')").select(ids.file_id("path").alias("file_id"))
    tables = {"files": incremental.replaced(index.files, fresh["files"], out, "file_id")}
    gone = index.symbols.join(out, "file_id", "left_semi").select("symbol_id")
    tables["symbols"] = incremental.replaced(index.symbols, fresh["symbols"], out, "file_id")
    tables["bodies"] = incremental.replaced(index.bodies, fresh["bodies"], out, "file_id")
    refs = index.query_refs.join(gone.withColumnRenamed("symbol_id", "src_symbol_id"), "src_symbol_id", "left_anti")
    tables["query_refs"] = refs.unionByName(fresh["query_refs"])
    kept = index.edges.join(gone.withColumnRenamed("symbol_id", "src_symbol_id"), "src_symbol_id", "left_anti")
    placed = tables["symbols"].join(tables["files"].select("file_id", "object_name", "module_type"), "file_id")
    before = index.symbols.join(out, "file_id", "left_semi").select("symbol_id", "name")
    tables["edges"] = re_resolved(kept, fresh["edges"], before, fresh["symbols"].select("symbol_id", "name"), placed)
    for name in ("subscriptions", "entry_points"):
        tables[name] = handlers(getattr(index, name).drop("handler_symbol_id"), placed)
    after = Index(**{name: tables.get(name, getattr(index, name)) for name in TABLES}).save(folder)
    status.unpersist()
    return after, counts


def re_resolved(kept: DataFrame, fresh: DataFrame, gone: DataFrame, come: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges after a change of symbols: those that mention a changed name and the fresh ones are resolved, all others stay.

    An edge's end and kind depend on the symbols of its callee's name alone. Names of symbols that went or
    came (symbol_id, name) are the delta; one that went and came back as it was has not changed.
    """
    keys = ["symbol_id", "name"]
    delta = gone.join(come, keys, "left_anti").unionByName(come.join(gone, keys, "left_anti"))
    names = keep(delta.select(folded("name").alias("_callee")).distinct(), "changed_names")
    few = F.broadcast(names) if names.limit(200_001).count() <= 200_000 else names
    with_key = kept.drop("callee_key").withColumn("_callee", folded("callee_name"))
    open_again = with_key.join(few, "_callee", "left_semi").drop("_callee", "dst_symbol_id", "resolved", "edge_type")
    stale = keep(open_again.unionByName(fresh), "stale_edges")
    wanted = stale.select(folded("callee_name").alias("_callee")).distinct()
    targets = placed.withColumn("_callee", folded("name")).join(wanted, "_callee", "left_semi").drop("_callee")
    still = with_key.join(few, "_callee", "left_anti").drop("_callee")
    return still.unionByName(graph.classify(stale, targets).select(still.columns))


def index_words(index: Index, folder: str) -> Postings:
    """The words of all bodies with their positions, for greps."""
    return Postings.write(_bodies(index.bodies), "words", folder)


def index_types(index: Index, folder: str) -> Postings:
    """The trigrams of all types that attributes have, each type once."""
    types = index.attributes.select("type_ref").unionByName(index.tab_part_attributes.select("type_ref")).where("type_ref is not null").distinct()
    return Postings.write(types.select(F.xxhash64("type_ref").alias("doc"), F.col("type_ref").alias("text")), "trigrams", folder)


def reindexed_words(words: Postings, before: Index, after: Index, folder: str) -> Postings:
    """The index of `before` with a segment of what `update` changed: bodies that are gone, new, or another text under their id."""
    old, new = (i.bodies.select("symbol_id", F.xxhash64("body", "path", "function_name", "line_start").alias("print")) for i in (before, after))
    gone = old.join(new, ["symbol_id", "print"], "left_anti").select(F.col("symbol_id").alias("doc"))
    fresh = after.bodies.join(new.join(old, ["symbol_id", "print"], "left_anti").select("symbol_id"), "symbol_id", "left_semi")
    return words.updated(_bodies(fresh), gone, folder)


def _bodies(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.col("symbol_id").alias("doc"), F.col("body").alias("text"), "path", "function_name", "line_start")
