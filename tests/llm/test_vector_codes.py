"""Vector codes against a plain Lloyd over all vectors."""

import hashlib
import math

import numpy as np
import pytest

from metaloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds):
    """Every round from nothing, in Python's own integers."""
    kept = []
    for i, x, label, *_ in rows:
        if x and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, tuple(math.floor(256 * float(np.float32(v))) for v in x), label))
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (gap(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(r[1], p) for p in range(parts)] for r in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = tuple(sum(v) // len(mine) for v in zip(*mine))
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, x, label in kept:
        code = [nearest(x, p) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(gap(cut(x, p), books[p][c]) for p, c in enumerate(code)), label))
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(i, c, e, total[label], sha) for i, c, e, label in out]


def table(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(int(i), [float(np.float32(v)) for v in centres[i % 5] + rng.normal(scale=0.3, size=dims)], int(i % 3) if i % 7 else None, "x") for i in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_equals_full_passes(spark, rounds):
    rows = table(300, rounds)
    rows += [(900, None, 1, ""), (901, [1.0, None] * 4, 1, ""), (902, [float("nan")] * 8, 1, ""), (903, [float("inf")] * 8, 1, ""), (904, [], 1, ""), (905, [1.0] * 16, 1, "")]
    rows += [rows[3], rows[3], (None, rows[5][1], None, "null id")]
    s = vc.Settings(parts=4, entries=6, rounds=rounds)
    got = vc.digest(spark.createDataFrame(rows, SCHEMA).repartition(5), s)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, 4, 6, rounds), key=repr)


def test_few_empty_and_refused(spark):
    s = vc.Settings(parts=2, entries=64)
    some = table(3, 1, 4)
    assert sorted(map(tuple, vc.digest(spark.createDataFrame(some, SCHEMA), s).collect())) == sorted(brute(some, 2, 64, 2))
    assert vc.digest(spark.createDataFrame([], SCHEMA), s).collect() == []
    assert vc.digest(spark.createDataFrame([(1, None, 1, "")], SCHEMA), s).collect() == []
    with pytest.raises(ValueError):
        vc.digest(spark.createDataFrame([(1, [1.0] * 3, 1, "")], SCHEMA), s)
    with pytest.raises(Exception, match="over"):
        vc.digest(spark.createDataFrame([(1, [1e30] * 4, 1, "")], SCHEMA), s)


def test_large_components_and_equal_rows(spark):
    big = [(i, [float(np.float32((i * 7919 % 97 - 48) * 5000.5 + j)) for j in range(4)], None, "") for i in range(60)]
    same = [(i, [0.25, -0.25, 0.5, 0.0], 1, "") for i in range(200)]
    for rows in (big, same):
        s = vc.Settings(parts=2, entries=5)
        assert sorted(map(tuple, vc.digest(spark.createDataFrame(rows, SCHEMA), s).collect())) == sorted(brute(rows, 2, 5, 2))


def test_many_labels_are_joined_in_salts(spark):
    rows = [(i, x, None if i % 2 else i % 9, c) for i, x, _, c in table(120, 4)]
    few, joined = vc.Settings(parts=4, entries=6), vc.Settings(parts=4, entries=6, broadcast_labels=2, salts=5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vc.digest(df, few).collect())) == sorted(map(tuple, vc.digest(df, joined).collect())) == sorted(brute(rows, 4, 6, 2))


def test_only_changes_are_shuffled(spark):
    """Parts that keep their entry give no row: with an unchanged code there is nothing to add or take away."""
    q = [1, 2, 3, 4]
    rows = spark.createDataFrame([(1, q, bytes([0, 1]), bytes([0, 1])), (2, q, bytes([0, 1]), bytes([0, 2]))], "vec_id long, q array<long>, old binary, code binary")
    got = {(r["part"], r["entry"]): (r["sums"], r["times"]) for r in vc._changes(rows, 2, 2).collect()}
    assert got == {(1, 1): ([-3, -4], -1), (1, 2): ([3, 4], 1)}
