"""Chunks of code, metadata and help as one table of vectors, built whole or by what changed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..operators import chunks, incremental
from ..operators.embedding import Provider, embedded
from ..sources import code, decode, files, reports
from ..sources.help import help_rows
from . import build as build_plans
from . import ledger as ledgers
from . import vocabulary as words
from .build import Index
from .catalog import Catalog, chunk_table
from .shared import keep
from .vocabulary import Vocabulary

COLUMNS = ["id", "source_file", "full_path", "object_type", "name", "functions", "module_type", "is_export", "chunk_index", "content"]


@dataclass(frozen=True)
class Config:
    """Sizes of chunks; bodies of fewer lines than `least_lines` are left out. Mode `fast` makes no vectors, `full` does."""

    mode: str = "fast"
    chunk: int = 1000
    overlap: int = 100
    whole: int = 2000
    least_lines: int = 5
    skip: tuple[str, ...] = ()
    #: How often in a row a file is tried whose chunks can't all be embedded.
    retries: int = 3

    def __post_init__(self):
        if self.mode not in ("fast", "full"):
            raise ValueError(f"mode is fast or full, not {self.mode!r}")
        if not 0 <= self.overlap < self.chunk:
            raise ValueError("overlap is less than a chunk")


def _numbered(rows: DataFrame, source: str, name: str) -> DataFrame:
    return rows.withColumn("id", ids.vector_id(F.col(source), F.col(name), F.col("chunk_index"))).select(*[F.col(c) if c in rows.columns or c == "id" else F.lit(None).cast("boolean" if c == "is_export" else "string").alias(c) for c in COLUMNS])


def code_chunks(catalog: Catalog, config: Config | None = None, path: str | None = None) -> DataFrame:
    """The card of each definition (of one module), or its header and body where there is none; cut where it is long."""
    from ..sources.files import skipped

    c = config or Config()
    bodies = catalog.i.bodies if path is None else catalog.i.bodies.where(F.col("path") == path)
    bodies = bodies.select("symbol_id", "path", "body").where(F.size(F.split("body", "\n")) >= c.least_lines).where(~skipped(F.col("path"), list(c.skip)))
    cards = catalog.cards(path).select("symbol_id", F.col("symbol").alias("name"), "summary", "module_type", "is_export", "owner")
    rows = bodies.join(cards, "symbol_id").withColumns({"source_file": F.col("path"), "full_path": F.concat_ws(".", "owner", "module_type"), "functions": F.col("name")})
    header = F.concat(F.lit("// "), F.col("full_path"), F.lit("."), F.col("name"), F.lit("\n"))
    keys = ["source_file", "full_path", "name", "functions", "module_type", "is_export"]
    return _numbered(chunks.function_chunks(rows, keys, F.col("summary"), header, F.col("body"), c.whole).withColumnRenamed("chunk", "content").withColumn("object_type", F.lit("function")), "source_file", "name")


def file_chunks(records: DataFrame, chunked: DataFrame, config: Config | None = None, v: Vocabulary | None = None) -> DataFrame:
    """Modules of which `chunked` has no definition, cut: names of what they define, then their text.

    records: what sources.code.file_records gives, with module keys as paths.
    """
    from ..sources.files import skipped

    c, v = config or Config(), v or Vocabulary()
    rest = records.where(~skipped(F.col("path"), list(c.skip))).join(chunked.select(F.col("source_file").alias("path")), "path", "left_anti")
    names = F.when(F.size("function_names") > 0, F.concat(F.lit(f"{words.DEFINED}: "), F.array_join("function_names", ", "), F.lit("\n\n"))).otherwise("")
    key = F.to_json(F.struct(F.col("path").alias("source_file"), "name", F.array_join("function_names", ",").alias("functions")))
    parts = chunks.chunks(rest.select(key.alias("_k"), F.concat(names, "content").alias("content")), "_k", "content", c.chunk, c.overlap)
    rows = parts.select(F.from_json("_k", "source_file string, name string, functions string").alias("k"), "chunk_index", F.col("chunk").alias("content")).select("k.*", "chunk_index", "content")
    module_type = paths.module_type(F.col("source_file"))
    rows = rows.withColumns({"module_type": module_type, "full_path": F.concat_ws(".", paths.owner(F.col("source_file"), list(v.owner_folders)), module_type), "object_type": F.lit("module"), "is_export": F.lit(False)})
    return _numbered(rows, "source_file", "name")


def metadata_chunks(objects: DataFrame, config: Config | None = None) -> DataFrame:
    """objects: what sources.reports.report_objects gives."""
    c = config or Config()
    rows = objects.withColumn("content", chunks.metadata_text(F.col("full_path"), F.col("object_type"), F.col("name"), F.col("properties")))
    parts = chunks.chunks(rows.withColumn("_k", F.struct("source_file", "full_path", "object_type", "name")).select(F.to_json("_k").alias("_k"), "content"), "_k", "content", c.chunk, c.overlap)
    keys = F.from_json("_k", "source_file string, full_path string, object_type string, name string")
    return _numbered(parts.select(keys.alias("k"), "chunk_index", F.col("chunk").alias("content")).select("k.*", "chunk_index", "content"), "full_path", "name")


def help_chunks(pages: DataFrame, config: Config | None = None) -> DataFrame:
    """pages: path, html. A title stands before each page's text."""
    c = config or Config()
    rows = help_rows(pages, "html", ["path"]).withColumn("content", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("content")))
    parts = chunks.chunks(rows, "path", "content", c.chunk, c.overlap).join(rows.select("path", F.col("title").alias("name")), "path")
    parts = parts.withColumns({"source_file": F.col("path"), "full_path": paths.help_path(F.col("path"), words.HELP_SKIPPED, words.HELP_TYPE), "object_type": F.lit(words.HELP_TYPE), "content": F.col("chunk")})
    return _numbered(parts, "source_file", "name")


def tree_chunks(spark: SparkSession, index: Index, root: str, config: Config | None = None, v: Vocabulary | None = None) -> dict[str, DataFrame]:
    """Chunks of all collections of a tree: definitions and modules without any; help pages; objects of text reports, where the index has none of its own."""
    modules = files.texts(spark, root, "*.bsl").withColumn("path", F.col("module_key"))
    defined = code_chunks(Catalog(index), config)
    found = {"code": defined.unionByName(file_chunks(code.file_records(modules, v), defined, config, v))}
    pages = files.texts(spark, root, "*.html", decode.HELP).select("path", F.col("text").alias("html"))
    found["help"] = help_chunks(pages, config)
    if index.objects.isEmpty():
        found["metadata"] = metadata_chunks(reports.report_objects(files.texts(spark, root, "*.txt", decode.REPORT).select("path", "text")), config)
    return found


def listing(spark: SparkSession, root: str, metadata: bool, only: str | None = None) -> DataFrame:
    """path, collection, hash of the files that chunks are made of, as chunks name them; text reports where `metadata` is."""
    kinds = {"code": ("*.bsl", decode.CODE, "module_key"), "help": ("*.html", decode.HELP, "path")} | ({"metadata": ("*.txt", decode.REPORT, "path")} if metadata else {})
    return reduce(DataFrame.unionByName, (files.texts(spark, root, glob, encodings, only).select(F.col(name).alias("path"), F.lit(kind).alias("collection"), "hash") for kind, (glob, encodings, name) in kinds.items()))


def file_parts(spark: SparkSession, index: Index, root: str, path: str, config: Config | None = None, v: Vocabulary | None = None) -> tuple[str, DataFrame]:
    """The collection of one file, a path below root, and its chunks; of a file that is gone there are none."""
    if path.endswith(".bsl"):
        key = spark.range(1).select(paths.module_key(F.lit(f"{root.rstrip('/')}/{path}"))).first()[0]
        modules = files.texts(spark, root, "*.bsl", only=path).withColumn("path", F.col("module_key"))
        defined = code_chunks(Catalog(index), config, key)
        return "code", defined.unionByName(file_chunks(code.file_records(modules, v), defined, config, v))
    if path.endswith(".html"):
        return "help", help_chunks(files.texts(spark, root, "*.html", decode.HELP, path).select("path", F.col("text").alias("html")), config)
    if path.endswith(".txt"):
        return "metadata", metadata_chunks(reports.report_objects(files.texts(spark, root, "*.txt", decode.REPORT, path).select("path", "text")), config)
    raise ValueError(f"no collection takes {path!r}")


def refresh_file(spark: SparkSession, root: str, path: str, before: str, after: str, provider: Provider, config: Config | None = None, v: Vocabulary | None = None) -> dict:
    """One file, a path below root, into its collection: the snapshot `after` has its tables, vectors and ledgers renewed, all else as in `before`.

    The answer has status (new, modified, retry, deleted, unchanged), the number of its chunks with vectors, and the snapshot to go on
    with: `before` itself where nothing was to be done. Vectors of another provider are refused, as one file can't renew them.
    """
    c = config or Config()
    old, stored, book = build_plans.load(spark, f"{before}/tables"), spark.read.parquet(f"{before}/vectors"), ledgers.load(spark, f"{before}/ledger")
    if not stored.where(~F.col("provider").eqNullSafe(provider.name)).isEmpty():
        raise ValueError("the vectors are of another provider: refresh the whole tree")
    kind = {"bsl": "code", "html": "help", "txt": "metadata"}.get(path.rpartition(".")[2])
    key = paths.module_key(F.lit(f"{root.rstrip('/')}/{path}")) if kind == "code" else F.lit(path)
    own = (F.col("collection") == F.lit(kind)) & (F.col("path") == key)
    there = keep(listing(spark, root, True, path), "listing")
    why = ledgers.due(book.files.where(own), there, c.retries).first()
    status = why["why"] if why else "deleted" if there.isEmpty() and not book.files.where(own).isEmpty() else "unchanged"
    if status == "unchanged":
        return {"status": status, "chunks": 0, "snapshot": before}
    index = build_plans.update(old, spark, root, f"{after}/tables", v, path)[0] if kind == "code" else old.save(f"{after}/tables")
    fresh = file_parts(spark, index, root, path, c, v)[1].withColumn("collection", F.lit(kind))
    mine = stored.where((F.col("collection") == kind) & (F.col("source_file") == key)).drop("provider")
    wanted = keep(fresh, "chunks")
    made = keep(delta(mine, wanted, mine, provider).withColumn("provider", F.lit(provider.name)), "vectors")
    rest = stored.where(~((F.col("collection") == kind) & F.col("source_file").eqNullSafe(key)))
    rest.unionByName(made.select(rest.columns)).write.mode("overwrite").partitionBy("collection").parquet(f"{after}/vectors")
    at = datetime.now(UTC).isoformat()
    source = F.col("source_file").alias("path")
    updates = ledgers.outcomes(there, wanted.select(source, "collection", "id"), made.select(source, "collection", "id"), at)
    mine_after = ledgers.files_after(book.files.where(own), there, updates)
    files_now = keep(book.files.where(~own).unionByName(mine_after), "ledger")
    definitions = book.definitions
    if kind == "code":
        others = definitions.where(F.col("path") != key)
        definitions = others.unionByName(ledgers.definitions_after(definitions.where(F.col("path") == key), index.bodies.where(F.col("path") == key), files_now, at)[0])
    ledgers.Ledger(files_now, definitions).save(f"{after}/ledger")
    return {"status": status, "chunks": made.count(), "snapshot": after}


def refresh(spark: SparkSession, root: str, before: str | None, after: str, provider: Provider | None = None, config: Config | None = None, v: Vocabulary | None = None, force: bool = False) -> dict:
    """Brings an index up to date as a new snapshot in the folder `after`, and tells what was done.

    Without `before`, with an empty index there, or by `force` all is built; else what changed. Vectors are made in
    mode `full`, which needs a provider; those of unchanged chunks are taken over if a provider of the same name made
    them, else all are made anew, so a table never mixes vectors of two models. A ledger of files and one of definitions are
    written beside them; chunks of a file that failed `retries` times in a row are not tried again until it changes. The
    answer has changed_files, deleted_files, mode, stats, counts of vectors, changed_definitions, tried (files by why)
    and ledger (files by collection and status).
    """
    c = config or Config()
    if c.mode == "full" and provider is None:
        raise ValueError("mode full needs a provider")
    old = None if before is None or force else build_plans.load(spark, f"{before}/tables")
    if old is None or old.files.isEmpty():
        index, old = build_plans.rebuild(spark, root, after, v), None
        changed, deleted = index.files.count(), 0
    else:
        index, counts = build_plans.update(old, spark, root, f"{after}/tables", v)
        changed, deleted = sum(counts.get(x, 0) for x in ("new", "modified")), counts.get("deleted", 0)
    done = {"changed_files": changed, "deleted_files": deleted, "mode": c.mode, "stats": Catalog(index).stats().first().asDict()}
    if c.mode == "full":
        parts = tree_chunks(spark, index, root, c, v)
        fresh = keep(reduce(DataFrame.unionByName, (df.withColumn("collection", F.lit(name)) for name, df in parts.items())), "chunks")
        there = keep(listing(spark, root, "metadata" in parts), "listing")
        kept = old is not None and _has(spark, f"{before}/vectors")
        book = ledgers.load(spark, f"{before}/ledger") if kept and _of(spark, f"{before}/vectors", provider) and _has(spark, f"{before}/ledger/files") else ledgers.empty(spark)
        tried = keep(ledgers.due(book.files, there, c.retries), "due")
        if not kept:
            rows = _written(embedded(fresh, "content", provider).where("embedding is not null"), provider, f"{after}/vectors")
        else:
            stored = spark.read.parquet(f"{before}/vectors")
            same = F.col("provider").eqNullSafe(provider.name) if "provider" in stored.columns else F.lit(False)
            stored = stored.withColumn("embedding", F.when(same, F.col("embedding"))).drop("provider")
            hopeless = ledgers.given_up(book.files, there, c.retries).withColumnRenamed("path", "source_file")
            known = stored.where("embedding is not null").select("id", "collection", "content")
            barred = fresh.join(hopeless, ["source_file", "collection"], "left_semi").join(known, ["id", "collection", "content"], "left_anti").select("id", "collection")
            rows = _written(delta(stored, fresh.join(barred, ["id", "collection"], "left_anti"), stored, provider), provider, f"{after}/vectors")
        at, source = datetime.now(UTC).isoformat(), F.col("source_file").alias("path")
        lost = fresh.select(source, "collection", "id").join(rows.select("id", "collection"), ["id", "collection"], "left_anti").select("path", "collection").distinct()
        stale = there.join(lost, ledgers.KEYS, "left_semi").join(tried, ledgers.KEYS, "left_anti").join(ledgers.given_up(book.files, there, c.retries), ledgers.KEYS, "left_anti")
        updates = keep(ledgers.outcomes(tried.drop("why").unionByName(stale), fresh.select(source, "collection", "id"), rows.select(source, "collection", "id"), at), "outcomes")
        files_now = keep(ledgers.files_after(book.files, there, updates), "ledger")
        definitions, bodies = ledgers.definitions_after(book.definitions, index.bodies, files_now, at)
        done["changed_definitions"] = bodies.count()
        ledgers.Ledger(files_now, definitions).save(f"{after}/ledger")
        done["tried"] = {r["why"]: r["count"] for r in tried.groupBy("why").count().collect()}
        done["ledger"] = {r["collection"]: dict(r["counts"]) for r in incremental.status_counts(files_now).collect()}
        done["vectors"] = {r["collection"]: r["count"] for r in rows.groupBy("collection").count().collect()}
    return done


def _of(spark: SparkSession, folder: str, provider: Provider) -> bool:
    """Whether all vectors there were made by a provider of this name."""
    rows = spark.read.parquet(folder)
    return "provider" in rows.columns and rows.where(~F.col("provider").eqNullSafe(provider.name)).isEmpty()


def _has(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there."""
    try:
        return bool(spark.read.parquet(folder).columns)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _written(rows: DataFrame, provider: Provider, folder: str) -> DataFrame:
    """The vectors written, partitioned by collection, with the name of who made them."""
    rows.withColumn("provider", F.lit(provider.name)).write.mode("overwrite").partitionBy("collection").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def build(spark: SparkSession, parts: dict[str, DataFrame], provider: Provider, folder: str) -> DataFrame:
    """Embeds and writes all collections, partitioned by collection, with the name of who made the vectors."""
    return _written(chunk_table(spark, parts, provider), provider, folder)


def delta(stored: DataFrame, fresh: DataFrame, removed: DataFrame, provider: Provider) -> DataFrame:
    """The vectors after some sources changed: chunks of equal id and content keep their vector, others are embedded.

    fresh: chunks with `collection` of the changed sources; removed: source_file of changed and deleted ones.
    To be written as a new snapshot: nothing is deleted before its replacement is there.
    """
    old = stored.select("id", "collection", F.col("content").alias("_content"), "embedding")
    known = fresh.join(old, ["id", "collection"], "left").withColumn("embedding", F.when(F.col("content") == F.col("_content"), F.col("embedding"))).drop("_content")
    ready = known.where("embedding is not null")
    made = embedded(known.where("embedding is null").drop("embedding"), "content", provider).where("embedding is not null")
    # written first: a provider's work is done once, however often the rows are read
    return incremental.replaced(stored, keep(ready.unionByName(made), "vectors"), removed.select("source_file"), "source_file")
