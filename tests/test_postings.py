"""The index of words and of trigrams against scans of the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from metaloom.operators import joins, text
from metaloom.operators.postings import Postings, Settings

WORDS = "Over oVer fast_path the тест Тестовый naïve x1 a ß 東京 end".split()


def texts(seed, ids):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(WORDS) + rng.choice([" ", "\n", ".", "_", " - "]) for _ in range(rng.randint(0, 40)))) for i in ids]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Two updates of a first index: what the texts are now, and the index after each step."""
    root = tmp_path_factory.mktemp("postings")
    now = dict(texts(1, range(60)))
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    out = {}
    for kind in ("words", "trigrams"):
        one = Postings.write(frame([*texts(1, range(60)), (None, "no id")]), kind, f"{root}/{kind}0", Settings(buckets=8, text_parts=4))
        changed = texts(2, range(50, 70))
        two = one.updated(frame(changed), frame([(3, ""), (4, "")]).select("doc"), f"{root}/{kind}1")
        three = two.updated(frame([(3, "over the тест again")]), None, f"{root}/{kind}2")
        out[kind] = (one, three, three.compacted(f"{root}/{kind}3"))
    first = dict(now)
    now.update(texts(2, range(50, 70)))
    del now[4]
    now[3] = "over the тест again"
    return out, first, now


def ids(df):
    return sorted(r["doc"] for r in df.select("doc").collect())


@pytest.mark.parametrize("pattern", ["ov", "тест", "Over oVer", "fast_path", "_a_", "___", "...", "nothing here", "a a a"])
def test_words_equal_a_scan(spark, built, pattern):
    found, first, now = built
    for index, rows in zip(found["words"], (first, now, now)):
        df = spark.createDataFrame(list(rows.items()), "doc long, text string")
        parts = re.findall(r"\w+", pattern)
        want = text.token_prefix(df, "text", parts[0]) if len(parts) == 1 and "_" not in parts[0] else text.phrase(df, "text", pattern) if parts else df
        assert ids(index.words(pattern)) == ids(want)


@pytest.mark.parametrize("needle", ["", "o", "т_", "OVER", "path.the", "京", "zzz", "naïve x1 a naïve"])
def test_substrings_equal_a_scan(spark, built, needle):
    found, first, now = built
    for index, rows in zip(found["trigrams"], (first, now, now)):
        got = {r["doc"]: r["text"] for r in index.containing(needle).collect()}
        assert got == {i: t for i, t in rows.items() if needle.lower() in t.lower()}


def test_plan_reads_the_buckets_of_its_words_alone(built):
    plan = built[0]["words"][0].of_tokens(["over", "the"])._jdf.queryExecution().executedPlan().toString()
    folders = re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan).group(1)
    assert "bucket" in folders and "xxhash64" not in folders and "In(token, [over,the])" in plan


def test_a_span_over_all_points_stays_logarithmic(spark):
    points = spark.createDataFrame([(i, i - 500) for i in range(1000)], "p int, at long")
    spans = spark.createDataFrame([(0, -500, 499), (1, -3, 4), (2, 7, 7), (3, 9, 2), (4, None, 5), (5, -10_000, 10_000), (6, 100, 131)], "s int, start long, end long")
    assert spans.where("s = 5").select(F.explode(joins._cover(F.col("start"), F.col("end") + 1, 14))).count() <= 2 * 15
    got = {(r.p, r.s) for r in joins.within(points, "at", spans, "start", "end").collect()}
    rows = [(s.s, s.start, s.end) for s in spans.collect() if s.start is not None]
    assert got == {(i, s) for i in range(1000) for s, a, b in rows if a <= i - 500 <= b}
    assert {(r.p, r.s) for r in joins.within(points, "at", spans, "start", "end", 10).collect()} == got
    assert joins.within(points, "at", spans.limit(0), "start", "end").isEmpty()
