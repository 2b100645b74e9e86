import math
import random

from pyspark.sql import functions as F

from metaloom.llm import topk


def brute(rows, k=5):
    fine = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * x) for x in v]))
    out = set()
    for q in {i for i, _ in fine if i % 50 == 0}:
        own = min(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q)
        out |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    return {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, settings=topk.Settings(**more)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    same = [0.5, -0.25, 0.125, 0, 0, 0, 0, 1.0]
    rows += [(i, same) for i in range(300, 420)]
    rows += [(500, None), (501, [None] * 8), (550, [float("nan")] * 8), (551, [float("inf")] + [0.0] * 7), (None, same), (600, [0.0] * 8)]
    rows = [(i, v and [x if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, bins=16, query_block=2, candidate_block=20, lanes=3) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -3.0]), (2, [-0.5, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0])]) == set()
