import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from metaloom.llm import lm_score as lm


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out_of(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, out_of(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows]


@pytest.mark.parametrize("settings", [lm.Settings(), lm.Settings(frequent=20, flush=50, cache=10, bits=2000)])
def test_base_against_brute_force(spark, settings):
    rows = [(i, f"The the of É É w{i % 7} w{i % 7}\tX{i}\nend ") for i in range(120)] + [(121, None), (122, ""), (None, "the of"), (5, "again five \x1c x")]
    got = lm.score(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int"), settings).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] <= 0


def test_levels_come_back(spark):
    """No count is ever underestimated by more than its level, and pairs raise held-out scores."""
    s = lm.Settings()
    rows = [(i, " ".join(f"a{(i + j) % 40} b{(i + j) % 40}" for j in range(60))) for i in range(200)]
    model, vocabulary = lm.fitted(spark.createDataFrame(rows, "doc_id long, text string"), s)
    exact = {r.word: r.c for r in vocabulary.collect()}
    words = np.array(list(exact), np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        levels = model.levels(lm.mixed(words))
    assert (levels >= lm.levels_of(np.array(list(exact.values())), s)).all()
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), s).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_beyond_one_broadcast(spark):
    """A filter too big to broadcast gives the scores of one that isn't, and held-out texts are still told apart."""
    rows = [(i, " ".join(f"a{(i + j) % 40} b{(i + j) % 40} c{i % 30}" for j in range(60))) for i in range(200)] + [(300, None), (None, "a1 new")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    of = lambda **k: {r.doc_id: (r.held_out, r.n_tokens, r.score) for r in lm.score(documents, lm.Settings(**k)).collect()}
    whole, apart = of(), of(bits=4096)
    assert whole.keys() == apart.keys() and len(whole) == len(rows)
    for i, (held_out, n, score) in whole.items():
        assert apart[i][:2] == (held_out, n)
        assert apart[i][2] == pytest.approx(score, rel=1e-9)
    assert all(score < 0 for _, _, score in apart.values())
    assert len({score for held_out, _, score in apart.values() if held_out}) > 5


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty).count() == 0
