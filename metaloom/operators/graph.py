"""The call graph: resolution, ranking, removal."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import keep
from .lookup import folded


def classify(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """dst_symbol_id, resolved and edge_type of every edge, in one pass of left joins.

    edges: edge_id, src_symbol_id, src_file_id, qualifier, callee_name. symbols: symbol_id, file_id,
    name, object_name, module_type. A qualified callee is looked for in the common module of that
    name, an unqualified one in its own file; the least id of several is taken.
    """
    named = symbols.withColumn("_name", folded("name"))
    common = named.where("module_type = 'CommonModule'").groupBy(F.col("object_name").alias("_q"), F.col("_name").alias("_c")).agg(F.min("symbol_id").alias("_common"))
    local = named.groupBy(F.col("file_id").alias("src_file_id"), F.col("_name").alias("_c")).agg(F.min("symbol_id").alias("_local"))
    known = named.select(F.col("_name").alias("_c"), F.lit(True).alias("_known")).distinct()
    rows = edges.withColumn("qualifier", F.nullif("qualifier", F.lit(""))).withColumn("_c", folded("callee_name")).withColumn("_q", F.col("qualifier"))
    rows = rows.join(common, ["_q", "_c"], "left").join(local, ["src_file_id", "_c"], "left").join(known, "_c", "left")
    bare = F.col("qualifier").isNull()
    kind = F.when(~bare & F.col("_common").isNotNull(), "call_commonmodule").when(bare & F.col("_local").isNotNull(), "call_local")
    kind = kind.when(~bare, "call_dynamic").when(F.col("_known").isNull(), "call_platform").otherwise("call_unresolved")
    dst = F.when(bare, F.col("_local")).otherwise(F.col("_common"))
    return rows.select(*[c for c in edges.columns if c not in ("dst_symbol_id", "resolved", "edge_type")], dst.alias("dst_symbol_id"), dst.isNotNull().alias("resolved"), kind.alias("edge_type"))


def demote(edges: DataFrame, removed: DataFrame, dst: str, key: str) -> DataFrame:
    """Edges into removed vertices lose their end and count as unresolved."""
    gone = removed.select(F.col(key).alias(dst), F.lit(True).alias("_gone")).distinct()
    rows = edges.join(gone, dst, "left")
    lost = F.col("_gone").isNotNull()
    return rows.withColumn(dst, F.when(~lost, F.col(dst))).withColumn("edge_type", F.when(lost, F.lit("call_unresolved")).otherwise(F.col("edge_type"))).drop("_gone")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, start: DataFrame | None = None) -> DataFrame:
    """id, rank. Parallel edges count as often as they stand; the mass of vertices without edges goes to all.

    Vertices: id. Edges: src, dst. start: id, rank to begin with (a warm start after a small change needs few
    iterations); vertices it doesn't have begin with the average.

    Edges are first summed to weights src -> dst. Weights and ranks are tables with equal buckets, weights by
    src and ranks by id, so an iteration joins them where they lie; its one shuffle carries what each task sends to
    each vertex, already summed. What it gives is written as the next table of ranks, which cuts the lineage.
    """
    spark = vertices.sparkSession
    ids = keep(vertices.select("id").where("id is not null").distinct(), "vertices")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
    out = counted.groupBy("src").agg(F.sum("times").alias("degree"))
    tables = Buckets(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        weights = tables.write(counted.join(out, "src").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", (F.col("times") / F.col("degree")).alias("weight")), "src")
        first = F.lit(1.0 / n) if start is None else F.coalesce("rank", F.lit(1.0 / n))
        known = ids.join(out.select(F.col("src").alias("id"), F.lit(False).alias("loose")), "id", "left")
        begun = known if start is None else known.join(start.select("id", "rank"), "id", "left")
        ranks = tables.write(begun.select("id", first.alias("rank"), F.coalesce("loose", F.lit(True)).alias("loose")), "id")
        if start is not None:
            total = ranks.agg(F.sum("rank")).first()[0]
            ranks = tables.write(ranks.withColumn("rank", F.col("rank") / total), "id")
        for _ in range(iterations):
            ranks = tables.write(_round(ranks, weights, n, damping), "id", dealt=True)
        return keep(ranks.select("id", "rank"), "ranks")
    finally:
        tables.drop()


def _round(ranks: DataFrame, weights: DataFrame, n: int, damping: float) -> DataFrame:
    sent = ranks.select(F.col("id").alias("src"), "rank").join(weights.hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("weight")).alias("got"))
    loose = F.broadcast(ranks.where("loose").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("mass")))
    rank = F.lit((1 - damping) / n) + damping * F.col("mass") / n + damping * F.coalesce("got", F.lit(0.0))
    return ranks.select("id", "loose").join(sent.hint("merge"), "id", "left").join(loose).select("id", rank.alias("rank"), "loose")


def adjacency(edges: DataFrame, key: Column, other: Column, name: str, most: int) -> DataFrame:
    """For each key the first different others, in the order of the edge's id. Ranked before they are listed, so a hub's list is never whole."""
    pairs = edges.groupBy(key.alias("id"), other.alias("_other")).agg(F.min("edge_id").alias("_order"))
    placed = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("id").orderBy("_order", "_other"))).where(F.col("_place") <= most)
    return placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_other"))), lambda x: x["_other"]).alias(name))


#: Lets a join rely on the order in which a bucket's only file was written, instead of sorting all weights again in each iteration.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Buckets:
    """Tables with the same number of buckets, dropped together. Until then their files count as sorted."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []
        self.before = spark.conf.get(ORDERED)
        spark.conf.set(ORDERED, "true")

    def write(self, rows: DataFrame, key: str, dealt: bool = False) -> DataFrame:
        """Rows as a table bucketed and sorted by a key, a file for each bucket. dealt: they come from a join of such tables by the key, and lie as they should."""
        name = f"bucketed_{uuid.uuid4().hex[:12]}"
        self.names.append(name)
        (rows if dealt else rows.repartition(self.n, key)).write.bucketBy(self.n, key).sortBy(key).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        self.spark.conf.set(ORDERED, self.before)
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
