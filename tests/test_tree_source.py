"""The tree as a data source: listing, and the stream with deletions, against the files themselves."""

import os

from metaloom.sources import files
from metaloom.sources.tree import ExportTree


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_listing_and_stream(spark, tmp_path):
    spark.dataSource.register(ExportTree)
    root, state = tmp_path / "tree", tmp_path / "state"
    for name in ("Documents/A/Module.bsl", "Documents/B/Ext/Module.bsl", "CommonModules/М/Module.bsl", "top.bsl", "Documents/A/A.xml"):
        put(root, name, name)

    def listed():
        rows = spark.read.format("export_tree").option("path", str(root)).option("glob", "*.bsl").load()
        return rows

    scanned = files.scan(spark, str(root), "*.bsl").select("path", "size")
    assert sorted(map(tuple, listed().select("path", "size").collect())) == sorted(map(tuple, scanned.collect()))
    assert listed().rdd.getNumPartitions() == 3

    seen = []

    def step():
        stream = spark.readStream.format("export_tree").option("path", str(root)).option("glob", "*.bsl").option("state", str(state)).load()
        batch = lambda rows, number: seen.append(sorted((r.path, r.status) for r in rows.collect()))
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        assert query.awaitTermination(60)
        return seen.pop() if seen else []

    assert step() == sorted((r.path, "new") for r in listed().collect())
    put(root, "Documents/A/Module.bsl", "longer than it was before")
    put(root, "Catalogs/C/Module.bsl", "c")
    os.remove(root / "CommonModules/М/Module.bsl")
    os.rmdir(root / "CommonModules/М")
    os.rmdir(root / "CommonModules")
    assert step() == [("Catalogs/C/Module.bsl", "new"), ("CommonModules/М/Module.bsl", "deleted"), ("Documents/A/Module.bsl", "modified")]
    assert step() == []


def test_no_folder(spark, tmp_path):
    spark.dataSource.register(ExportTree)
    assert spark.read.format("export_tree").option("path", str(tmp_path / "none")).load().count() == 0
