import pytest
from pyspark.sql import functions as F

from metaloom.functions import paths, text
from metaloom.operators import chunks, graph, incremental, joins, lookup, ranking
from metaloom.operators.embedding import Provider, provider, with_fallback
from metaloom.sources import decode, files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_paths(spark):
    p = F.lit("/x/src/old/src/CommonModules/Курсы/Ext/Module.bsl")
    key = "CommonModules/Курсы/Ext/Module.bsl"
    got = one(spark, paths.module_key(p).alias("k"), paths.owner(F.lit(key), ["CommonModules"]).alias("o"), paths.module_type(F.lit(key)).alias("t"), paths.owner(F.lit("a/b"), ["X"]).alias("n"), paths.help_path(F.lit("Help/A/B/index.html"), ["Help"], "S").alias("h"), paths.help_path(F.lit("Help/index.html"), ["Help"], "S").alias("i"))
    assert tuple(got) == (key, "Курсы", "CommonModule", None, "A.B.S", "S.index")
    kinds = {"Documents/З/Forms/Ф/Ext/Form/Module.bsl": "FormModule", "Documents/З/Ext/ManagerModule.bsl": "ManagerModule", "X/Y/Ext/CommandModule.bsl": "CommandModule", "R/Ext/RecordSetModule.bsl": "RecordSetModule", "X/Module.bsl": "Module"}
    for name, kind in kinds.items():
        assert one(spark, paths.module_type(F.lit(name)))[0] == kind
    assert [one(spark, files.in_roots(F.lit(x), ["Documents"]))[0] for x in ("Documents/a.xml", "cfe/E/Documents/a.xml", "Documents/a/b.xml", "x/Documents/a.xml")] == ["Documents", "Documents", None, None]
    assert one(spark, files.skipped(F.lit("/a/b.bsl"), ["*.bsl"]), files.skipped(F.lit("/a/b.bsl"), ["b.bsl"]))[:] == (True, False)


def test_text_functions(spark):
    got = one(spark, text.params_of(F.lit("Знач А, Б = 1, , В")).alias("p"), text.handler_of(F.lit("CommonModule. М . Метод")).alias("h"), text.handler_of(F.lit("Метод")).alias("g"), text.handler_of(F.lit("")).alias("e"))
    assert got.p == ["А", "Б", "В"] and tuple(got.h) == ("М", "Метод") and tuple(got.g) == ("", "Метод") and tuple(got.e) == ("", "")


def test_decoding():
    russian = "Процедура Тест()"
    for encoding in ("utf-8", "utf-8-sig", "cp1251", "utf-16"):
        assert decode.decode(russian.encode(encoding))[0] == russian
    assert decode.decode(b"")[0] == "" and decode.decode(None)[0] == ""
    assert decode.decode("ab".encode("utf-16-le"), decode.REPORT)[0] in ("ab", "a\0b\0")


def test_lookup_takes_text_literally(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("ПОИСК_Цены",), (None,)], "name string")
    assert [r.name for r in df.where(lookup.has_substring("name", "A%B")).collect()] == ["a%b"]
    assert [r.name for r in lookup.find_tiered(df, "name", "цены").collect()] == ["ПОИСК_Цены"]
    assert lookup.find_tiered(df, "name", "nothing").count() == 0
    assert df.where(lookup.has_words(["name"], "%%")).count() == 0


def test_range_join(spark):
    points = spark.createDataFrame([(i, i * 7) for i in range(50)], "p long, at long")
    spans = spark.createDataFrame([(0, 3, 40), (1, 39, 39), (2, 100, 99), (3, 0, 400), (4, 42, 42)], "s long, start long, end long")
    got = {(r.p, r.s) for r in joins.within(points, "at", spans, "start", "end", 25).collect()}
    assert got == {(i, s) for i in range(50) for s, a, b in ((0, 3, 40), (1, 39, 39), (3, 0, 400), (4, 42, 42)) if a <= i * 7 <= b}


def test_pagerank_against_a_loop(spark):
    edges = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 1), (5, 5)]
    rank = dict.fromkeys(range(1, 8), 1 / 7)
    for _ in range(20):
        loose = sum(rank[v] for v in rank if all(a != v for a, _ in edges))
        rank = {v: 0.15 / 7 + 0.85 * loose / 7 + 0.85 * sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v) for v in rank}
    got = graph.pagerank(spark.range(1, 8), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: pytest.approx(r.rank, abs=1e-12) for r in got.collect()} == rank


def test_fusion_and_budget(spark):
    lists = [spark.createDataFrame(list(enumerate(x)), "place long, id string") for x in (["a", "b", "c"], ["b", "d"])]
    got = ranking.fuse(lists, "id", "place").orderBy(F.desc("score"), "first_list", "id").collect()
    assert [r.id for r in got] == ["b", "a", "d", "c"] and got[0].score == pytest.approx(1 / 61 + 1 / 60)
    df = spark.createDataFrame([(i, 10) for i in range(5)], "i long, size long")
    assert [r.i for r in ranking.within_budget(df, [F.asc("i")], 10, F.col("size"), 25).collect()] == [0, 1]
    assert [r.i for r in ranking.within_budget(df, [F.asc("i")], 10, F.col("size"), 1).collect()] == [0]


def test_changes_by_stat_and_hash(spark):
    import datetime
    import hashlib

    t, u = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    stored = spark.createDataFrame([("same", t, 1, sha(b"a")), ("touched", t, 1, sha(b"b")), ("changed", t, 1, sha(b"c")), ("gone", t, 1, sha(b"d"))], "path string, mtime timestamp, size long, hash string")
    now = [("same", t, 1, b"a"), ("touched", u, 1, b"b"), ("changed", u, 1, b"x"), ("new", t, 1, b"n")]
    listing = spark.createDataFrame([r[:3] for r in now], "path string, mtime timestamp, size long")
    contents = spark.createDataFrame([(r[0], r[3]) for r in now], "path string, content binary")
    got = {r.path: r.status for r in incremental.detect_changes(stored, listing, contents).collect()}
    assert got == {"same": "unchanged", "touched": "touched", "changed": "modified", "new": "new", "gone": "deleted"}


def test_ledger(spark):
    schema = "path string, collection string, hash string, indexed_at long, status string, error_message string, retry_count int"
    ledger = spark.createDataFrame([("a", "code", "1", 1, "failed", "e", 1), ("b", "code", "2", 1, "indexed", None, 0)], schema)
    updates = spark.createDataFrame([("a", "code", "1", 5, "failed", "e"), ("a", "code", "1", 4, "indexed", None), ("c", "help", "3", 5, "failed", "e"), ("b", "help", "2", 5, "skipped", None)], "path string, collection string, hash string, indexed_at long, status string, error_message string")
    after = incremental.ledger_after(ledger, updates)
    assert {(r.path, r.collection): (r.status, r.retry_count) for r in after.collect()} == {("a", "code"): ("failed", 2), ("b", "code"): ("indexed", 0), ("c", "help"): ("failed", 1), ("b", "help"): ("skipped", 0)}
    assert [r.path for r in incremental.retry_queue(after).collect()] == ["c", "a"]
    assert {r.collection: r.counts for r in incremental.status_counts(after).collect()} == {"code": {"failed": 1, "indexed": 1}, "help": {"failed": 1, "skipped": 1}}
    assert [r.path for r in incremental.swept(after, after.where("path = 'a'"), "code").collect()] == ["b"]


def test_ledger_of_definitions(spark):
    schema = "path string, function_name string, collection string, hash string, indexed_at long"
    ledger = spark.createDataFrame([("a", "f", "code", "1", 1), ("a_b", "f", "code", "2", 1), ("a", "f", "help", "3", 1)], schema)
    after = incremental.functions_after(ledger, spark.createDataFrame([("a", "f", "code", "old", 4), ("a", "f", "code", "new", 5), ("c", None, "code", "9", 5)], schema))
    have = lambda df: sorted((r.path, r.collection, r.hash) for r in df.collect())
    assert have(after) == [("a", "code", "new"), ("a", "help", "3"), ("a_b", "code", "2"), ("c", "code", "9")]
    assert have(incremental.forgotten(after, spark.createDataFrame([("a",), ("a%",)], "path string"), "code")) == [("a", "help", "3"), ("a_b", "code", "2"), ("c", "code", "9")]
    assert have(incremental.cleared(after, "code")) == [("a", "help", "3")] and incremental.cleared(after).isEmpty()
    listing = spark.createDataFrame([("a", "new"), ("a_b", "x"), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in incremental.file_status(after, listing, "code").collect()} == {"a": "unchanged", "a_b": "modified", "c": "deleted", "d": "new"}


def test_chunks(spark):
    long = "\n\n".join(f"Paragraph {i}. " + "word " * 80 for i in range(20)) + "x" * 2500
    parts = chunks.split(long)
    assert all(len(p) <= 1000 for p in parts) and parts[0].startswith("Paragraph 0.")
    assert chunks.split("") == [] and chunks.split("short") == ["short"]
    words_ = " ".join(f"w{i}" for i in range(500))
    parts = chunks.split(words_, 100, 20)
    assert {w for p in parts for w in p.split()} == set(words_.split())
    assert all(a.split()[-1] in b for a, b in zip(parts, parts[1:], strict=False))
    rows = spark.createDataFrame([("a", None, "h\n", "b" * 2500), ("b", "card", "h\n", "b" * 2500)], "id string, card string, header string, body string")
    got = chunks.function_chunks(rows, ["id"], F.col("card"), F.col("header"), F.col("body")).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {"a": 4, "b": 1}


def test_providers():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise OSError
        return [[1.0]] * len(texts)

    assert Provider(flaky, 2, 1, 0)(["a", "bad", "c"]) == [[1.0], None, [1.0]]
    assert with_fallback(flaky, lambda t: [[2.0]] * len(t))(["bad"]) == [[2.0]]
    with pytest.raises(ValueError):
        provider("none")


def test_pagerank_shuffles_once_an_iteration(spark):
    """Weights and ranks are joined where they lie; what is sent is shuffled by its target."""
    tables = graph.Buckets(spark, 4)
    try:
        weights = tables.write(spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5)], "src long, dst long, weight double"), "src")
        ranks = tables.write(spark.createDataFrame([(1, 0.3, False), (2, 0.3, False), (3, 0.4, True)], "id long, rank double, loose boolean"), "id")
        plan = graph._round(ranks, weights, 3, 0.85)._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.drop()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pagerank_sorts_its_weights_once(spark):
    """They are written in order; no iteration sorts them, or the ranks they are joined with."""
    before = spark.conf.get(graph.ORDERED)
    tables = graph.Buckets(spark, 4)
    try:
        weights = tables.write(spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5)], "src long, dst long, weight double"), "src")
        ranks = tables.write(spark.createDataFrame([(1, 0.3, False), (2, 0.3, False), (3, 0.4, True)], "id long, rank double, loose boolean"), "id")
        ranks = tables.write(graph._round(ranks, weights, 3, 0.85), "id", dealt=True)
        plan = graph._round(ranks, weights, 3, 0.85)._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.drop()
    assert plan.count("Sort [") == 1 and "Sort [src" not in plan  # what was sent alone
    assert spark.conf.get(graph.ORDERED) == before


def test_pagerank_from_a_warm_start(spark):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 40) for i in range(40) for j in range(3)], "src long, dst long")
    vertices = spark.range(40).select("id")
    whole = {r.id: r["rank"] for r in graph.pagerank(vertices, edges, iterations=30).collect()}
    more = edges.unionByName(spark.createDataFrame([(0, 5), (50, 1)], "src long, dst long"))
    again = vertices.unionByName(spark.createDataFrame([(50,)], "id long"))
    cold = {r.id: r["rank"] for r in graph.pagerank(again, more, iterations=30).collect()}
    begun = spark.createDataFrame(list(whole.items()), "id long, rank double")
    warm = {r.id: r["rank"] for r in graph.pagerank(again, more, iterations=8, start=begun).collect()}
    assert abs(sum(warm.values()) - 1) < 1e-9 and max(abs(warm[i] - cold[i]) for i in cold) < 1e-3
