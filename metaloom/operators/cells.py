"""Vectors in cells: an exact search that reads the cells alone which can hold an answer.

A coarse quantiser, k-means over a sample of a stated size, cuts the space into cells. Every vector is filed
under its nearest centre, and each cell knows its radius: no vector of it is farther from the centre. By the
triangle inequality none is nearer to a query than the centre's distance less the radius. A search reads
the cells nearest to the query, takes the distance of the k-th row found there, and then reads exactly the cells
whose bound is not beyond it. The rows are those of a scan, ties included.

Additions are segments that are never changed, filed under the same centres; radii are the greatest over segments.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors

#: Distances are sums of doubles in different orders; bounds give way by so much.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """cells: at most; sample: rows that the centres are fitted on, those of the least hashes of their key."""

    cells: int = 256
    sample: int = 100_000
    rounds: int = 10
    seed: int = 7


class Cells:
    """key and vector name two columns of the rows; other columns go along."""

    def __init__(self, spark: SparkSession, key: str, vector: str, segments: tuple[str, ...]):
        self.spark, self.key, self.vector, self.segments = spark, key, vector, segments
        # a row for each cell and segment: bounded by the settings
        known = [r for s in segments for r in spark.read.parquet(f"{s}/cells").collect()]
        self.centres = {r["cell"]: np.array(r["centre"]) for r in known}
        self.radius = {c: max(r["radius"] for r in known if r["cell"] == c) for c in self.centres}
        self.rows_in = {c: sum(r["rows"] for r in known if r["cell"] == c) for c in self.centres}

    @classmethod
    def write(cls, rows: DataFrame, key: str, vector: str, folder: str, settings: Settings | None = None) -> Cells:
        """Fits centres and files the rows. Rows without a vector, or with nulls or numbers that aren't finite in it, have no cell and are left out."""
        s = settings or Settings()
        sound = _sound(rows, vector)
        sample = sound.orderBy(F.xxhash64(key), key).limit(s.sample).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
        n = sample.count()
        if not n:
            centres = []
        else:
            model = KMeans(k=max(1, min(s.cells, n // 4 or 1)), featuresCol="v", maxIter=s.rounds, seed=s.seed).fit(sample)
            centres = [[float(x) for x in c] for c in model.clusterCenters()]
        _file(sound, vector, centres, folder)
        return cls(rows.sparkSession, key, vector, (folder,))

    def added(self, rows: DataFrame, folder: str) -> Cells:
        """With more rows, in a segment of their own."""
        _file(_sound(rows, self.vector), self.vector, [self.centres[c].tolist() for c in sorted(self.centres)], folder)
        return Cells(self.spark, self.key, self.vector, (*self.segments, folder))

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self.spark.read.parquet(f"{s}/rows") for s in self.segments))
        return (every if cells is None else every.where(F.col("cell").isin(cells))).drop("cell", "_gap")

    def bounds(self, query: list[float]) -> list[tuple[float, int]]:
        """(least distance, cell), the nearest centre first; no row of the cell is nearer."""
        gaps = sorted((float(np.linalg.norm(c - np.array(query, float))), n) for n, c in self.centres.items())
        return [(max(0.0, gap - self.radius[n]), n) for gap, n in gaps]

    def cells_for(self, query: list[float], k: int, where: Column | None = None) -> list[int]:
        """The cells that can hold one of the k nearest rows: the nearest ones until they have k rows, then all within what these give."""
        bounds, first, held = self.bounds(query), [], 0
        for _, n in bounds:
            first.append(n)
            held += self.rows_in[n]
            if held >= k:
                break
        found = vectors.nearest(self.rows(first), self.vector, query, self.key, k, where).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
        if found["n"] < k:
            return sorted(n for _, n in bounds)
        far = found["far"] ** 0.5
        return sorted({n for least, n in bounds if least <= far * (1 + SLACK) + SLACK} | set(first))

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """What vectors.nearest gives over all rows."""
        return vectors.nearest(self.rows(self.cells_for(query, k, where)), self.vector, query, self.key, k, where)


def _sound(rows: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _file(rows: DataFrame, vector: str, centres: list[list[float]], folder: str) -> None:
    """Rows under the folder of their nearest centre, and cell, centre, radius, rows of each."""
    known = F.array(*(F.struct(F.lit(n).alias("cell"), F.array(*map(F.lit, c)).alias("centre")) for n, c in enumerate(centres))) if centres else F.array()
    if centres:
        best = F.array_min(F.transform(known, lambda c: F.struct(vectors.squared_l2(F.col(vector), c["centre"]).alias("gap"), c["cell"].alias("cell"))))
        placed = rows.withColumn("_best", best).withColumns({"cell": F.col("_best.cell"), "_gap": F.col("_best.gap")}).drop("_best")
    else:
        placed = rows.withColumns({"cell": F.lit(0), "_gap": F.lit(0.0)})
    placed.write.partitionBy("cell").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    far = spark.read.schema(placed.schema).parquet(f"{folder}/rows").groupBy("cell").agg(F.sqrt(F.max("_gap")).alias("radius"), F.count("*").alias("rows"))
    table = spark.createDataFrame([(n, c) for n, c in enumerate(centres)], "cell int, centre array<double>")
    table.join(far, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.parquet(f"{folder}/cells")
