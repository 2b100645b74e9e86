"""Alignment against a plain one over whole texts, encoded whole."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from metaloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, groups string, unit int"


def one(text):
    """Groups of (ids of A, ids of B); none where a side doesn't give back the bytes."""
    (a, a_bytes), (b, b_bytes) = alignment._byte_level(A), alignment._pieces(B)
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not text or not b"".join(a_bytes[i] for i in a_ids) == (" " + text).encode() == b"".join(b_bytes[i] for i in b_ids):
        return []
    ends = []
    for ids, of in ((a_ids, a_bytes), (b_ids, b_bytes)):
        at, found = 0, []
        for i in ids:
            at += len(of[i])
            found.append(at)
        ends.append(found)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    side = lambda ids, found, low, high: [i for i, e in zip(ids, found) if low < e <= high]
    return [(side(a_ids, ends[0], low, high), side(b_ids, ends[1], low, high)) for low, high in zip([0, *cuts], cuts)]


def brute(rows):
    every = [(r[0], one(r[1] or "")) for r in rows]
    docs = Counter(p for _, groups in every for p in {(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in every:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), sha))
    return out


def texts():
    rng = random.Random(5)
    words = "the of tokenization naïve Übergröße 日本語 москва <|endoftext|> </s> <0x41> don't it's 12,345.67 e-mail@x.org \U0001d538 é  x".split(" ")
    blanks = [" ", "  ", "\n", "\t", " \n ", "\r\n", "　", "\x1c", "\x85", "  "]
    mixed = ["".join(rng.choice(words) + rng.choice(blanks if rng.random() < 0.3 else [" "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    odd = ["", None, " ", "   ", "\n", " a", "a ", "\x00", "x" * 3000, "ab" * 800, "▁", "plain ▁ text", "\x1c  x", "a\x1c b", "᠎ y", "'s 's", "!!! ???", "a" * 40 + " " + "é" * 50]
    return mixed + odd


@pytest.mark.parametrize("settings", [None, alignment.Settings(frequent=3), alignment.Settings(frequent=0)])
def test_equals_whole_texts(spark, settings):
    rows = [(n if n % 9 else n // 2, t, "clash", n) for n, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, "a null id here", "", 0), (None, "a null id here", "", 0)]
    got = alignment.digest(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B, settings)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_whole_texts_as_units(spark, monkeypatch):
    """Without the promise of cuts at blanks a unit is a text; the rows are the same."""
    monkeypatch.setattr(alignment, "cuts_at_blanks", lambda a, b: False)
    rows = [(n, t, "", 0) for n, t in enumerate(texts()[-40:])]
    got = alignment.digest(spark.createDataFrame(rows, SCHEMA), A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty(spark):
    assert alignment.digest(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert [r["n_a"] for r in alignment.digest(spark.createDataFrame([(1, None, "", 0)], SCHEMA), A, B).collect()] == [0]


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = alignment.digest(docs, A, B)
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs.select("doc_id", "text").collect()))


def test_sides_are_read_once_for_groups_and_links(spark):
    """Each side is read for its tokens and for its ends, not again for the links."""
    fields = "task int, no long, ok boolean, a_ids array<int>, a_sizes array<int>, b_ids array<int>, b_sizes array<int>"
    # A ends at 1, 2, 4 and B at 2, 3, 4: groups 5,5|7 and 6|8,8
    found = alignment.aligned(spark.createDataFrame([(0, 1, True, [5, 5, 6], [1, 1, 2], [7, 8, 8], [2, 1, 1]), (0, 2, False, [], [], [], [])], fields))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 4
    (row,) = found.collect()
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups"]) == (3, 3, 2, 4, "5,5|7;6|8,8")
    assert sorted(map(tuple, row["links"])) == [(5 * alignment.SHIFT + 7, 2), (6 * alignment.SHIFT + 8, 2)]


def test_digest_writes_no_groups_and_leaves_no_tables(spark, monkeypatch):
    """The groups of a text are longer than it; of them only a digest goes to disk, and what was written on the way is gone."""
    kept, keep = [], alignment.keep
    monkeypatch.setattr(alignment, "keep", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    before = {t.name for t in spark.catalog.listTables()}
    got = alignment.digest(spark.createDataFrame([(1, "the tokens of a text " * 40, "", 0)], SCHEMA), A, B)
    (row,), (found,) = got.collect(), kept
    assert len(row["groups_sha256"]) == 64 and row["n_groups"] > 100
    assert max(len(v) for v in found.first() if isinstance(v, str)) == 64
    assert {t.name for t in spark.catalog.listTables()} == before


def test_units_of_a_task_are_aligned_as_one_text(spark):
    """Units that fail and units without tokens move no other's ends."""
    fields = "task int, no long, ok boolean, a_ids array<int>, a_sizes array<int>, b_ids array<int>, b_sizes array<int>"
    rows = [(0, 1, True, [1, 2], [1, 2], [3], [3]), (0, 2, False, [], [], [], []), (0, 3, True, [4, 5], [2, 1], [6, 7], [2, 1]), (0, 4, True, [], [], [], []), (0, 5, True, [1], [5], [2], [5])]
    found = alignment.aligned(spark.createDataFrame(rows, fields))
    assert sorted((r["no"], r["groups"]) for r in found.collect()) == [(1, "1,2|3"), (3, "4|6;5|7"), (5, "1|2")]
