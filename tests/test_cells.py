"""Search by cells against a scan of all vectors."""

import random

from pyspark.sql import functions as F

from metaloom.operators import vectors
from metaloom.operators.cells import Cells, Settings


def test_equals_a_scan_and_reads_few_cells(spark, tmp_path):
    rng = random.Random(4)
    centres = [[rng.uniform(-20, 20) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 12]], i % 5) for i in range(600)]
    odd = [(1000, None, 1), (1001, [1.0, None] * 3, 1), (1002, [float("nan")] * 6, 1), (1003, rows[0][1], 0), (1004, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, kind int")
    cells = Cells.write(df.where("id % 4 <> 1"), "id", "v", str(tmp_path / "a"), Settings(cells=12)).added(df.where("id % 4 = 1"), str(tmp_path / "b"))
    sound = df.where("v is not null and id not in (1001, 1002)")
    share = []
    for i in (0, 7, 100):
        query = [x + 0.1 for x in rows[i][1]]
        for k, where in ((1, None), (7, F.col("kind") == 3), (700, None)):
            want = [(r.id, r.distance) for r in vectors.nearest(sound, "v", query, "id", k, where).collect()]
            assert [(r.id, r.distance) for r in cells.nearest(query, k, where).collect()] == want
        share.append(len(cells.cells_for(query, 7)) / len(cells.centres))
    assert max(share) <= 0.5  # clusters apart from each other are not read
    plan = cells.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan or "cell#" in plan.split("PartitionFilters")[1]


def test_no_vectors(spark, tmp_path):
    cells = Cells.write(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", str(tmp_path / "none"))
    assert cells.bounds([1.0]) == [] and not cells.centres
