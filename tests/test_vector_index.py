import pytest
from pyspark.sql import functions as F

from metaloom.operators.embedding import Provider, hashed
from metaloom.plans import vector_index as vi
from metaloom.streaming import refresh


def test_help_and_metadata_chunks(spark, tmp_path):
    pages = spark.createDataFrame([("Help/A/x.html", "<title>T</title><body><p>" + "long text. " * 300 + "</p></body>"), ("help/y.html", "<h1>Y</h1>")], "path string, html string")
    rows = vi.help_chunks(pages).orderBy("source_file", "chunk_index").collect()
    assert rows[0].full_path == "A.Справка" and rows[0].content.startswith("# T") and len({r.id for r in rows}) == len(rows) > 3
    objects = spark.createDataFrame([("Справочники.В", "Справочники", "В", {"b": "2", "a": "1"}, "r.txt")], "full_path string, object_type string, name string, properties map<string,string>, source_file string")
    one = vi.metadata_chunks(objects).first()
    assert one.content == "Справочники.В\nСправочники\nВ\na: 1\nb: 2" and one.source_file == "r.txt"

    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return hashed(texts)

    stored = vi.build(spark, {"help": vi.help_chunks(pages), "metadata": vi.metadata_chunks(objects)}, Provider(counted), str(tmp_path / "v"))
    before = stored.count()
    fresh = vi.help_chunks(pages.where("path = 'help/y.html'")).withColumn("collection", F.lit("help"))
    fresh = fresh.unionByName(fresh.limit(1).withColumns({"id": F.lit("new"), "content": F.lit("new text")}))
    after = vi.delta(stored, fresh, spark.createDataFrame([("help/y.html",), ("r.txt",)], "source_file string"), Provider(counted))
    start = calls.value
    assert after.where("collection = 'metadata'").count() == 0 and calls.value - start <= 1
    assert {r.id for r in after.where("source_file = 'help/y.html'").collect()} > {"new"} and after.count() == before


def test_config():
    for bad in ({"mode": "other"}, {"chunk": 10, "overlap": 10}):
        with pytest.raises(ValueError):
            vi.Config(**bad)


def test_refresh_of_a_tree(spark, tmp_path):
    root, long = tmp_path / "in", "Процедура Длинная()\n" + "    А = 1;\n" * 6 + "КонецПроцедуры\n"
    put = {"src/CommonModules/M/Ext/Module.bsl": long, "src/CommonModules/N/Ext/Module.bsl": "// only statements\nА = 1;\n", "src/CommonModules/K/Ext/Module.bsl": "Процедура Мала()\nКонецПроцедуры\n", "Help/A/x.html": "<title>T</title><body><p>text</p></body>", "r.txt": '- Справочники.Валюты\n\tСиноним: "Все"\n'}
    for name, text in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return hashed(texts)

    with pytest.raises(ValueError):
        vi.refresh(spark, str(root), None, str(tmp_path / "v0"), config=vi.Config(mode="full"))
    first = vi.refresh(spark, str(root), None, str(tmp_path / "v1"), Provider(counted), vi.Config(mode="full"))
    assert first["changed_files"] == 3 and first["deleted_files"] == 0 and first["stats"]["symbols"] == 2
    assert first["vectors"] == {"code": 3, "help": 1, "metadata": 1}
    rows = {r.source_file.split("/")[1]: r for r in spark.read.parquet(str(tmp_path / "v1/vectors")).where("collection = 'code'").collect()}
    assert rows["M"].object_type == "function" and rows["M"].name == "Длинная"
    assert (rows["N"].object_type, rows["N"].full_path, rows["N"].content) == ("module", "N.CommonModule", "// only statements\nА = 1;")
    assert rows["K"].functions == "Мала" and rows["K"].content.startswith("Определяет: Мала\n\n") and rows["K"].is_export is False

    (root / "src/CommonModules/N/Ext/Module.bsl").write_text("// other statements\n")
    (root / "src/CommonModules/K/Ext/Module.bsl").unlink()
    start = calls.value
    second = vi.refresh(spark, str(root), str(tmp_path / "v1"), str(tmp_path / "v2"), Provider(counted), vi.Config(mode="full"))
    assert (second["changed_files"], second["deleted_files"], second["vectors"]) == (1, 1, {"code": 2, "help": 1, "metadata": 1})
    assert calls.value - start == 1
    third = vi.refresh(spark, str(root), str(tmp_path / "v2"), str(tmp_path / "v3"), force=True)
    assert third["mode"] == "fast" and third["changed_files"] == 2 and "vectors" not in third


def test_stream_of_modules(spark, tmp_path):
    root = tmp_path / "in" / "src" / "CommonModules" / "M" / "Ext"
    root.mkdir(parents=True)
    (root / "Module.bsl").write_text("Процедура А()\nКонецПроцедуры\n")
    for _ in range(2):
        stream = refresh.module_stream(spark, str(tmp_path / "in"))
        refresh.append_functions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.module_key, r.name) for r in rows] == [("CommonModules/M/Ext/Module.bsl", "А")]


def tree(root, put):
    for name, text in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def book(spark, folder):
    return {(r.path, r.collection): (r.status, r.retry_count) for r in spark.read.parquet(f"{folder}/ledger/files").collect()}


def test_ledger_of_a_tree(spark, tmp_path):
    root, full = tmp_path / "in", vi.Config(mode="full", retries=2)
    body = "Процедура Длинная()\n" + "    А = 1;\n" * 6 + "КонецПроцедуры\n"
    tree(root, {"src/CommonModules/M/Ext/Module.bsl": body, "src/CommonModules/E/Ext/Module.bsl": "\n", "Help/A/bad[1].html": "<title>T</title><body><p>broken</p></body>", "Help/A/y.html": "<title>Y</title><body><p>fine</p></body>"})
    calls = spark.sparkContext.accumulator(0)

    def some(texts):
        calls.add(len(texts))
        return [None if "broken" in t else v for t, v in zip(texts, hashed(texts))]

    model = Provider(some, name="some")
    bad, module, blank = ("Help/A/bad[1].html", "help"), ("CommonModules/M/Ext/Module.bsl", "code"), ("CommonModules/E/Ext/Module.bsl", "code")
    go = lambda n: (vi.refresh(spark, str(root), str(tmp_path / f"v{n - 1}") if n > 1 else None, str(tmp_path / f"v{n}"), model, full), book(spark, tmp_path / f"v{n}"))
    done, rows = go(1)
    assert done["tried"] == {"new": 4} and done["changed_definitions"] == 1 and done["vectors"] == {"code": 1, "help": 1}
    assert rows[bad] == ("failed", 1) and rows[module] == ("indexed", 0) and rows[blank] == ("skipped", 0)
    assert done["ledger"] == {"code": {"indexed": 1, "skipped": 1}, "help": {"failed": 1, "indexed": 1}}
    before = calls.value
    done, rows = go(2)
    assert done["tried"] == {"retry": 1} and rows[bad] == ("failed", 2) and done["changed_definitions"] == 0 and calls.value > before
    before = calls.value
    done, rows = go(3)
    assert done["tried"] == {} and rows[bad] == ("failed", 2) and calls.value == before  # given up as it is
    (root / bad[0]).write_text("<title>T</title><body><p>mended</p></body>")
    (root / "Help/A/y.html").unlink()
    done, rows = go(4)
    assert done["tried"] == {"modified": 1} and rows[bad] == ("indexed", 0) and ("Help/A/y.html", "help") not in rows and done["vectors"] == {"code": 1, "help": 1}

    # one file at a time
    one = lambda path, a, b, m=model: vi.refresh_file(spark, str(root), path, str(tmp_path / a), str(tmp_path / b), m, full)
    assert one("src/CommonModules/M/Ext/Module.bsl", "v4", "x") == {"status": "unchanged", "chunks": 0, "snapshot": str(tmp_path / "v4")}
    (root / "src/CommonModules/M/Ext/Module.bsl").write_text(body + body.replace("Длинная", "Другая"))
    assert one("src/CommonModules/M/Ext/Module.bsl", "v4", "v5")["status"] == "modified"
    code = spark.read.parquet(str(tmp_path / "v5/vectors")).where("collection = 'code'")
    assert {r.name for r in code.collect()} == {"Длинная", "Другая"} and book(spark, tmp_path / "v5").keys() == rows.keys()
    assert {r.function_name for r in spark.read.parquet(str(tmp_path / "v5/ledger/definitions")).collect()} == {"Длинная", "Другая"}
    (root / bad[0]).unlink()
    assert one(bad[0], "v5", "v6")["status"] == "deleted"
    assert bad not in book(spark, tmp_path / "v6") and spark.read.parquet(str(tmp_path / "v6/vectors")).where("collection = 'help'").count() == 0
    with pytest.raises(ValueError):
        one(bad[0], "v5", "x", Provider(some, name="other"))
    assert one("notes.md", "v6", "x")["status"] == "unchanged"


def test_metadata_search_without_structure(spark):
    from metaloom.plans.build import Index, TABLES
    from metaloom.plans.catalog import Catalog, Retrieval, chunk_table

    empty = Index(**{name: spark.createDataFrame([], "object_id long, symbol_id long, file_id long, path string, module_type string, object_name string, name string, synonym string, full_name string, object_type string") for name in TABLES})
    empty.files, empty.symbols = empty.files.select("file_id", "path", "module_type", "object_name"), empty.symbols.select("symbol_id", "file_id", "name")
    objects = spark.createDataFrame([("Справочники.В", "Справочники", "В", {"a": "1"}, "r.txt"), ("Справочники.Г", "Справочники", "Г", {}, "r.txt")], "full_path string, object_type string, name string, properties map<string,string>, source_file string")
    model = Provider(hashed, name="hashed")
    chunks = chunk_table(spark, {"metadata": vi.metadata_chunks(objects)}, model)
    rows = Catalog(empty).metadatasearch("a: 1 В", 5, Retrieval(chunks, model)).collect()
    assert {r.source for r in rows} == {"semantic"} and {r.full_path for r in rows} == {"Справочники.В", "Справочники.Г"}
    assert Catalog(empty).metadatasearch("В", 5).count() == 0
