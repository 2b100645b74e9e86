"""What keeps queries in bounds on large tables, seen in plans and small tables."""

import tracemalloc
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from metaloom import tree_queries as tq
from metaloom.operators import postings
from metaloom.operators.postings import Postings
from metaloom.plans.vocabulary import Vocabulary
from metaloom.sources import code, reports, xml


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attributes_are_joined_by_shuffles(spark, small):
    assert "Broadcast" not in plan(tq.tree_attributes(spark, small))


def test_tables_of_objects_parse_no_file_again(spark, small):
    made = xml.flat(xml.objects(tq.catalogues(spark, small)))
    assert not [name for name, rows in made.items() if "EvalPython" in plan(rows)]


def test_objects_are_joined_by_shuffles(spark, small):
    assert "Broadcast" not in plan(tq.tree_objects(spark, small))


def test_files_are_dealt_by_number_whatever_their_size(spark, small):
    files = tq.catalogues(spark, small)
    assert files.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert files.count() == spark.read.parquet(f"{small}/customer.parquet").count()


def test_children_of_an_attribute_are_looked_through_once():
    class Counting(ET.Element):
        passes = 0

        def __getitem__(self, at):
            Counting.passes += self.tag == "Properties"
            return super().__getitem__(at)

    at = "<Attribute><Properties><Name>%s</Name><Name>no</Name><Type>%s</Type><FillChecking>ErrorIfNotFilled</FillChecking></Properties></Attribute>"
    content = "<Catalog><ChildObjects>" + at % ("a", "<Type>xs:string</Type><Type> </Type><Type>cfg:CatalogRef.C</Type>") + at % ("b", "<TypeSet><Type>T</Type></TypeSet>") + at % ("c", "own") + at % (" ", "x") + "</ChildObjects></Catalog>"
    found = xml.attributes(ET.fromstring(content, ET.XMLParser(target=ET.TreeBuilder(element_factory=Counting))))
    assert [(x["name"], x["type_ref"], x["is_required"]) for x in found] == [("a", "Строка, СправочникСсылка.C", True), ("b", "T", True), ("c", "own", True)]
    assert Counting.passes <= 4


def test_of_equal_names_the_first_stays(spark):
    a = [("a", "t1", True), ("b", "t2", False), ("a", "t3", False)]
    row = [("p", "Kind.N", "N", "Kind", "s", a, [("S", a), ("S", a[:1]), ("T", a[1:])], ["R", "Q", "R"])]
    fields = "array<struct<name:string,type_ref:string,is_required:boolean>>"
    found = spark.createDataFrame(row, f"path string, full_name string, name string, object_type string, synonym string, attributes {fields}, tab_parts array<struct<name:string,attributes:{fields}>>, registers array<string>")
    made = xml.flat(found)
    of = lambda name, *columns: sorted(map(tuple, made[name].select(*columns).collect()))
    assert of("attributes", "pos", "name", "type_ref", "is_required") == [(0, "a", "t1", True), (1, "b", "t2", False)]
    assert of("tab_parts", "pos", "name") == [(0, "S"), (2, "T")]
    assert of("tab_part_attributes", "pos", "name", "type_ref") == [(0, "a", "t1"), (0, "b", "t2"), (1, "a", "t3"), (1, "b", "t2")]
    assert of("register_movements", "register_name") == [("Q",), ("R",)]


def test_an_index_cuts_its_texts_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def told(text):
        asked.add(1)
        return text

    texts = spark.createDataFrame([(i, f"word {i} ab") for i in range(10)], "doc long, text string").withColumn("text", F.udf(told, "string").asNondeterministic()("text"))
    index = Postings.write(texts, "trigrams", f"{tmp_path}/index")
    assert asked.value == 20  # once for the postings, once for the texts that are stored
    assert {r["doc"] for r in index.containing("d 7 a").collect()} == {7}


def test_trigrams_of_letters_beyond_two_bytes(spark):
    found = postings.tokens_of(spark.createDataFrame([(1, "A😀b\nb"), (2, ""), (3, None), (4, "x")], "doc long, text string"), "trigrams")
    end = postings.END
    assert sorted((r["doc"], r["token"]) for r in found.collect()) == sorted([(1, "a😀b"), (1, "😀b\n"), (1, "b\nb"), (1, "\nb" + end), (1, "b" + 2 * end), (4, "x" + 2 * end)])


def test_a_long_report_is_neither_held_whole_nor_read_otherwise():
    text = "- A.B\r\n\tT: \"x\"\n\tC:\n\t\t\"first\n\t\tsecond\" \tD: \"y\"\n- A.C\n" * 20_000
    whole = [("A.B", {"T": "x", "C": "first\nsecond", "D": "y"}), ("A.C", {})] * 20_000
    assert list(reports.lines_of(text, 7)) == text.splitlines()
    assert list(reports.each_object(text)) == whole
    tracemalloc.start()
    assert sum(1 for _ in reports.each_object(text)) == 40_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_a_comment_names_the_lines_above_once(spark):
    made = code.doc_comment(F.col("lines"), F.col("line_start"), Vocabulary())
    assert str(made).count("line_start") <= 2
    rows = [(["x", "// ====", "//  One ", "// two", "// Параметры:", "//  p", "F()"], 7), (["F()"], 1), (["// a", "", "F()"], 3), (["// ----", "// only", "F()"], 3)]
    found = spark.createDataFrame(rows, "lines array<string>, line_start int").select(made.alias("doc")).collect()
    assert [r["doc"] for r in found] == ["One two", "", "", "only"]


def test_postings_of_words_are_sorted_once(spark):
    """The sort that groups them is the one that the files are written by."""
    rows = spark.createDataFrame([(1, "over the over")], "doc long, text string")
    dealt = postings.tokens_of(rows, "words").withColumns({"bucket": F.length("token"), "slot": F.lit(0) + F.col("doc") % 4}).repartition("bucket", "slot")
    with postings._by_sorting(spark):
        grouped = postings._in_order(dealt).select("bucket", "token", "doc", "positions")
        seen = plan(grouped.sortWithinPartitions("bucket", "token", "doc"))
        assert sorted(map(tuple, grouped.collect())) == [(3, "the", 1, [1]), (4, "over", 1, [0, 2])]
    assert seen.count("Sort [") == 1 and "ObjectHash" not in seen and seen.count("Exchange") == 1


def test_postings_of_trigrams_are_shuffled_bare(spark):
    """Places, the same for all, are added after the sort."""
    rows = postings.tokens_of(spark.createDataFrame([(1, "over")], "doc long, text string"), "trigrams").withColumn("bucket", F.length("token"))
    found = postings._once(rows, F.col("doc") % 4)
    seen = plan(found)
    assert seen.count("Sort [") == 1 and "positions" not in seen[seen.index("Sort [") :] and "pos#" not in seen[: seen.index("Generate")]
    assert {(r.token, *r.positions) for r in found.collect()} >= {("ove", 0), ("ver", 0)}
