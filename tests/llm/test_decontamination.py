import itertools
import math
import random
import re

from metaloom.llm import decontamination as dc


def brute(docs, items):
    found = set()
    for d, text in docs:
        h = re.findall(r"[^\W_]+", (text or "").lower())
        for i, t in items:
            item = re.findall(r"[^\W_]+", (t or "").lower())
            wide = min(20, len(item))
            if len(item) < dc.SHORT:
                continue
            for diagonal in range(-len(item), len(h)):
                same = [int(0 <= diagonal + k < len(h) and h[diagonal + k] == w) for k, w in enumerate(item)]
                if max(sum(same[k : k + wide]) for k in range(len(item) - wide + 1)) * 5 >= wide * 4:
                    found.add((d, i))
                    break
    return found


def fixture():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 15, 45, 12, 9, 3, 20))] + [(7, None), (8, "")]
    docs = []
    for i, t in items:
        own = (t or "").split()
        for changed in (0, 1, 2):
            copy = list(own)
            for k in range(changed):
                if len(copy) > 15:
                    copy[4 + 9 * k] = "changed"
            docs.append(" ".join([word() for _ in range(40)] + copy + [word() for _ in range(25)]))
        docs.append(" ".join(own[: len(own) // 3] + [word() for _ in range(30)]))
    docs += [None, "", items[0][1].upper().replace(" ", ", "), (items[2][1] + " ") * 30, " ".join(word() for _ in range(5000))]
    return list(enumerate(docs)), items


def test_against_brute_force(spark):
    docs, items = fixture()
    documents = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, seed string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for s in (dc.Settings(), dc.Settings(broadcast_rows=1)):
        got = {(r.doc_id, r.item_id) for r in dc.overlaps(documents, benchmark, s).collect()}
        assert got == want
    clean = {r.doc_id for r in dc.drop_contaminated(documents, benchmark).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert dc.overlaps(documents.limit(0), benchmark).count() == 0
    assert dc.drop_contaminated(documents, benchmark.limit(0)).count() == len(docs)


def test_no_allowed_substitutions_miss_all_seeds():
    for n in range(dc.SHORT, 21):
        masks = next(m for least, m in dc.TIERS if n >= least)
        placed = [{k + o for o in m} for m in masks for k in range(n - max(m))]
        for changed in itertools.combinations(range(n), n - math.ceil(n * 4 / 5)):
            assert any(p.isdisjoint(changed) for p in placed), (n, changed)


def test_substitutions_at_random_places(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(dc.SHORT, 21)] + [(30, " ".join(word() for _ in range(33)))]
    docs = []
    for _, t in items:
        own = t.split()
        allowed = min(len(own), 20) - math.ceil(min(len(own), 20) * 4 / 5)
        for changed in (0, *[allowed] * 12, allowed + 1):
            copy = list(own)
            for k in rng.sample(range(min(len(own), 20)), changed):
                copy[k] = "changed"
            around = rng.choice((0, 3, 30))
            docs.append(" ".join([word() for _ in range(around)] + copy + [word() for _ in range(around)]))
    docs = list(enumerate(docs))
    want = brute(docs, items)
    assert len(want) >= 13 * len(items)
    # each alone, so that masks of one tier don't stand in for those of another
    for some in (items, items[:3], items[10:12]):
        got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {x for x in want if x[1] in dict(some)}


def test_only_found_texts_go(spark):
    """Clean rows that share their doc_id, or the want of one, with a contaminated row stay."""
    item = " ".join(f"q{k}" for k in range(25))
    rows = [(None, item), (None, "clean one"), (None, None), (7, f"before {item} after"), (7, "clean two"), (8, item), (8, item), (9, "clean three")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for s in (dc.Settings(), dc.Settings(broadcast_rows=0)):
        left = dc.drop_contaminated(documents, benchmark, s)
        assert sorted(map(tuple, left.collect()), key=repr) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)
    assert {(r.doc_id, r.agreed) for r in dc.overlaps(documents, benchmark).collect()} == {(None, 20), (7, 20), (8, 20)}


def test_settings_that_the_masks_do_not_cover():
    import pytest

    for bad in ({"agree": 0.5}, {"window": 12}, {"agree": 1.2}):
        with pytest.raises(ValueError):
            dc.Settings(**bad)
