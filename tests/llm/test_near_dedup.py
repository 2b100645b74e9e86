import random

import numpy as np

from metaloom.llm import near_dedup as nd
from metaloom.llm.components import components


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def items_of(t):
    w = nd.WORD.findall((t or "").lower())
    seen, out = {}, []
    for i in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[i : i + 5])
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def brute_similarity(x, y):
    a, b = items_of(x), items_of(y)
    if not a or not b:
        return float(a == b)
    kept = longest_common(a, b)
    return kept / (len(a) + len(b) - kept)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(25)]
    texts += [texts[0], texts[0].upper(), "", None, "one two", "one two", "a " * 50, "a " * 51, "word " * 3000]
    return texts


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = [items_of(t) for t in texts]
    sets = [set(x) for x in lists]
    for i in range(len(texts)):
        for j in range(i):
            # an alignment keeps no more than both have
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (lists[i] == lists[j] or brute_similarity(texts[i], texts[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_classes_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in nd.classes(documents).collect()}
    assert got == brute_classes(texts)


def test_similarity_equals_full_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a = [f"v{rng.randrange(60)}" for _ in range(rng.randint(5, 80))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [f"v{rng.randrange(60)}"]
        with np.errstate(over="ignore"):
            items = [nd.labelled(nd.shingled(nd.Words().of(" ".join(w)), 5)) for w in (a, b)]
        want = brute_similarity(" ".join(a), " ".join(b))
        got = nd.similarity(*items, 0.8)
        assert abs(got - (want if want >= 0.8 else 0)) < 1e-9


def test_one_document_of_each_class_stays(spark):
    texts = ["x y z u v w " * 4, "x y z u v w " * 4, "other words stand here now and then", None, ""]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(2, texts[2], "en", "s", 1), (None, "x y z u v w " * 4, "en", "s", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = nd.drop_copies(documents)
    assert out.columns == documents.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
    assert nd.drop_copies(documents.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_one_row_of_each_class_without_unique_ids(spark):
    """Null and repeated doc_ids with different texts: each class keeps one row, and no class is lost."""
    long = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcd"]
    near = [t + " more" for t in long]
    rows = [(None, long[0]), (None, near[0]), (5, long[1]), (5, near[1]), (6, long[2]), (6, "other words stand here alone"), (None, near[2]), (5, long[3]), (9, near[3]), (9, near[3]), (10, "single"), (None, None), (None, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (nd.Settings(), nd.Settings(broadcast_rows=0)):
        left = [tuple(r) for r in nd.drop_copies(documents, s).collect()]
        assert all(r in rows for r in left)
        kinds = sorted((r[1] or "")[:1] for r in left)
        assert kinds == ["", "a", "b", "c", "d", "o", "s"]
        assert {r[0] for r in left if (r[1] or "")[:1] in ("c", "d")} == {6, 5}


def test_blocks_lose_no_link(spark):
    """Buckets cut into blocks of four give the classes of whole ones."""
    texts = corpus()
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.classes(documents, nd.Settings(block=4, broadcast_rows=0)).collect()}
    assert got == brute_classes(texts)


def test_recall_at_the_threshold(spark):
    """Pairs whose alignment keeps 0.80 to 0.81: at least 0.99 of them are one class."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        text = [f"{rng.randrange(5000)}" for _ in range(1000)]
        other = list(text)
        for i in range(22):
            other[10 + 44 * i] = f"x{k}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    assert 0.8 <= brute_similarity(rows[0][1], rows[1][1]) < 0.81
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 149
    assert all(got[i] in (i, i - 1) for i in got)


def test_ids_of_any_size_beside_null(spark):
    rows = [(2**60 + 1, "a b c d e f"), (None, "a b c d e f"), (2**60 + 3, "other words here")]
    got = [(r.doc_id, r.class_id) for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(2**60 + 1, 2**60 + 1), (None, 2**60 + 1), (2**60 + 3, 2**60 + 3)], key=str)
