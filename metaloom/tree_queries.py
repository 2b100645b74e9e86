"""The parsers of an exported tree, over files whose contents are written from the given tables.

Parts stand for definitions, eight to a module; customers for catalogues with their orders as attributes; nations
for subscriptions and reports; suppliers for forms. What each file must yield is said in SQL from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import graph
from .sources import code, reports, xml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def said(*parts: str | Column) -> Column:
    """Constant texts and columns, one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def listed(order: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def modules(spark: SparkSession, d: str) -> DataFrame:
    """path, module_key, text, hash, mtime, size: a definition of twelve lines for each part."""
    p = {c: F.col(f"p_{c}") for c in ("partkey", "name", "type", "size", "brand")}
    owner = F.floor(p["partkey"] / 8)
    proc = p["size"] % 2 == 0
    block = lines(
        said("// About ", p["name"], "."), said("//   ", p["type"]), "//", "// Параметры:",
        said(F.when(proc, "Процедура").otherwise("функция"), " F", p["partkey"], "(Знач A", p["size"], ", B = 1)", F.when(p["size"] > 25, " Экспорт").otherwise("")),
        said('    Запрос = "ВЫБРАТЬ 1 ИЗ справочник.', F.translate(p["brand"], "#", "_"), ' КАК Б";'),
        said("    Object", owner + 2, ".F", p["partkey"] + 16, "(1);"), said("    F", owner * 8, "();"), "    Если Сообщить(1) Тогда КонецЕсли;", said("    Strange", p["size"], "();"),
        F.when(proc, "КонецПроцедуры").otherwise("КонецФункции"), "",
    )
    text = F.array_join(listed("p_partkey", block), "\n")
    rows = read(spark, d, "part").groupBy(owner.alias("owner")).agg(text.alias("text"))
    place = F.when(F.col("owner") % 3 == 0, said("CommonModules/Object", F.col("owner"), "/Ext/Module.bsl")).otherwise(said("Documents/Object", F.col("owner"), "/Ext/ObjectModule.bsl"))
    rows = rows.withColumns({"path": F.concat(F.lit("src/"), place), "module_key": paths.module_key(F.concat(F.lit("in/src/"), place))})
    return rows.select("path", "module_key", "text", F.sha2("text", 256).alias("hash"), F.timestamp_seconds(F.lit(1)).alias("mtime"), F.octet_length("text").cast("long").alias("size"))


DEFINED = """d AS (SELECT p_partkey AS k, p_partkey // 8 AS m, p_size AS s, p_name, p_type, p_brand, 'F' || p_partkey AS name, p_size % 2 = 0 AS proc, p_size > 25 AS is_export,
  12 * (row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1) AS above FROM part),
m AS (SELECT *, CASE WHEN m % 3 = 0 THEN 'CommonModules/Object' || m || '/Ext/Module.bsl' ELSE 'Documents/Object' || m || '/Ext/ObjectModule.bsl' END AS module_key FROM d)"""


@query(f"""WITH {DEFINED} SELECT module_key, name, CASE WHEN proc THEN 'Процедура' ELSE 'Функция' END AS type, 'A' || s || ',B' AS params, is_export, (above + 5)::INTEGER AS line_start, (above + 11)::INTEGER AS line_end,
'About ' || p_name || '. ' || p_type AS doc, 'Object' || (m + 2) || '.F' || (k + 16) || CASE WHEN k % 8 <> 0 THEN ',F' || (m * 8) ELSE '' END || ',Strange' || s AS calls, 'Справочник.' || replace(p_brand, '#', '_') AS query_refs FROM m""")
def tree_definitions(spark, d):
    """Definitions with their parameters, comments, calls and references."""
    rows = code.functions(modules(spark, d))
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(".", c["qualifier"], c["name"])), ",").alias("calls")
    return rows.select("module_key", "name", "type", F.array_join("params", ",").alias("params"), "is_export", "line_start", "line_end", "doc", calls, F.array_join("query_refs", ",").alias("query_refs"))


@query(f"""WITH {DEFINED}, calls AS (SELECT m, name AS caller, 'Object' || (m + 2) AS qualifier, 'F' || (k + 16) AS callee FROM m UNION ALL SELECT m, name, NULL, 'F' || (m * 8) FROM m WHERE k % 8 <> 0 UNION ALL SELECT m, name, NULL, 'Strange' || s FROM m),
t AS (SELECT c.*, EXISTS (SELECT 1 FROM m x WHERE x.name = callee) AS known, (SELECT name FROM m x WHERE x.name = callee AND 'Object' || x.m = qualifier AND x.m % 3 = 0) AS common, (SELECT name FROM m x WHERE x.name = callee AND x.m = c.m) AS local FROM calls c)
SELECT caller, qualifier, callee AS callee_name, CASE WHEN qualifier IS NULL THEN local ELSE common END AS found,
CASE WHEN common IS NOT NULL THEN 'call_commonmodule' WHEN qualifier IS NOT NULL THEN 'call_dynamic' WHEN local IS NOT NULL THEN 'call_local' WHEN known THEN 'call_unresolved' ELSE 'call_platform' END AS edge_type FROM t""")
def tree_edges(spark, d):
    """The tables made of modules, and their edges resolved."""
    made = code.tables(modules(spark, d))
    placed = made["symbols"].join(made["files"].select("file_id", "object_name", "module_type"), "file_id")
    names = made["symbols"].select(F.col("symbol_id").alias("src_symbol_id"), F.col("name").alias("caller"))
    ends = made["symbols"].select(F.col("symbol_id").alias("dst_symbol_id"), F.col("name").alias("found"))
    return graph.classify(made["edges"], placed).join(names, "src_symbol_id").join(ends, "dst_symbol_id", "left").select("caller", "qualifier", "callee_name", "found", "edge_type")


@query(f"""WITH {DEFINED} SELECT module_key AS path, CASE WHEN m % 3 = 0 THEN 'CommonModule' ELSE 'ObjectModule' END AS module_type, 'Object' || m AS object_name, CASE WHEN m % 3 = 0 THEN 'Module' ELSE 'ObjectModule' END AS name,
string_agg(name, ',' ORDER BY k) AS function_names, coalesce(string_agg(name, ',' ORDER BY k) FILTER (is_export), '') AS export_functions, (12 * count(*))::INTEGER AS line_count FROM m GROUP BY module_key, m""")
def tree_files(spark, d):
    """A record of each module, and what its path says."""
    texts = modules(spark, d)
    files = code.tables(texts)["files"].select("path", "module_type", "object_name")
    records = code.file_records(texts.withColumn("path", F.col("module_key")))
    names = [F.array_join(c, ",").alias(c) for c in ("function_names", "export_functions")]
    return files.join(records.select("path", "name", *names, "line_count"), "path")


def as_files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """What a scan of a tree gives."""
    return rows.select(path.alias("path"), F.concat(F.lit("in/"), path).alias("full_path"), F.timestamp_seconds(F.lit(1)).alias("mtime"), F.octet_length(content).cast("long").alias("size"), F.encode(content, "utf-8").alias("content"))


def catalogues(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer, with its orders.

    What is shuffled are keys, the texts are made behind it; and rows are dealt to four tasks a core, however small they are
    compressed, since each becomes kilobytes of XML to parse.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    typed = said("<v8:Type>cfg:CatalogRef.C", F.col("o_orderkey") % 50, "</v8:Type>", F.when(F.col("o_orderstatus") == "O", "<v8:Type>xs:string</v8:Type>").otherwise(""))
    attribute = said("<Attribute><Properties><Name>a", F.col("o_orderkey") % 7, "</Name><Type>", typed, "</Type>", F.when(F.col("o_orderstatus") == "F", "<FillChecking>ErrorIfNotFilled</FillChecking>").otherwise(""), "</Properties></Attribute>")
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus").repartition(tasks, "c_custkey")
    own = orders.groupBy("c_custkey").agg(F.array_join(listed("o_orderkey", attribute), "").alias("attributes"))
    rows = read(spark, d, "customer").repartition(tasks, "c_custkey").join(own.hint("merge"), "c_custkey", "left")
    section = said("<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>", F.coalesce("attributes", F.lit("")), "</ChildObjects></TabularSection>")
    records = said("<RegisterRecords><v8:Item>AccumulationRegister.", F.col("c_mktsegment"), "</v8:Item><v8:Item>AccumulationRegister.R", F.col("c_nationkey"), "</v8:Item></RegisterRecords>")
    synonym = said("<Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>", F.col("c_name"), "</v8:content></v8:item></Synonym>")
    content = said(
        '<MetaDataObject xmlns="urn:m" xmlns:v8="urn:v8"><Catalog uuid="1"><Properties><Name>C', F.col("c_custkey"), "</Name>", synonym, records,
        "</Properties><ChildObjects>", F.coalesce("attributes", F.lit("")), section, "</ChildObjects></Catalog></MetaDataObject>",
    )
    broken = F.when(F.col("c_custkey") % 10 == 0, F.lit("<MetaDataObject>")).otherwise(content)
    return as_files(rows, said(F.when(F.col("c_custkey") % 2 == 0, "src/").otherwise(""), "Catalogs/C", F.col("c_custkey"), ".xml"), broken)


@query("""SELECT 'Справочник.C' || c_custkey AS full_name, 'C' || c_custkey AS name, 'Справочник' AS object_type, c_name AS synonym, (SELECT count(DISTINCT o_orderkey % 7) FROM orders WHERE o_custkey = c_custkey)::INTEGER AS attributes,
list_aggregate(list_sort(list_distinct(['AccumulationRegister.' || c_mktsegment, 'AccumulationRegister.R' || c_nationkey])), 'string_agg', ',') AS registers FROM customer WHERE c_custkey % 10 <> 0""")
def tree_objects(spark, d):
    """Metadata objects, without those whose file is no XML."""
    made = xml.flat(xml.objects(catalogues(spark, d)))
    attributes = made["attributes"].groupBy("object_id").agg(F.count("*").cast("int").alias("attributes"))
    moves = made["register_movements"].groupBy(F.col("document_id").alias("object_id")).agg(F.array_join(F.array_sort(F.collect_list("register_name")), ",").alias("registers"))
    rows = made["objects"].join(attributes.hint("merge"), "object_id", "left").join(moves.hint("merge"), "object_id", "left")
    return rows.select("full_name", "name", "object_type", "synonym", F.coalesce("attributes", F.lit(0)).alias("attributes"), "registers")


ATTRIBUTES = """o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 10 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY pos) AS n FROM o)"""


@query(f"""WITH {ATTRIBUTES}, r AS (SELECT 'Справочник.C' || o_custkey AS full_name, pos::INTEGER AS pos, 'a' || (o_orderkey % 7) AS name, 'СправочникСсылка.C' || (o_orderkey % 50) || CASE WHEN o_orderstatus = 'O' THEN ', Строка' ELSE '' END AS type_ref, o_orderstatus = 'F' AS is_required FROM f WHERE n = 1)
SELECT full_name, NULL AS part, pos, name, type_ref, is_required FROM r UNION ALL SELECT full_name, 'Rows', pos, name, type_ref, NULL FROM r""")
def tree_attributes(spark, d):
    """Attributes of objects and of their tabular sections, with types in the platform's words; of equal names the first stays.

    Joined by shuffles: compressed files look small, and the planner would broadcast all objects through the driver.
    """
    made = xml.flat(xml.objects(catalogues(spark, d)))
    objects = made["objects"].select("object_id", "full_name").hint("merge")
    own = made["attributes"].join(objects, "object_id").select("full_name", F.lit(None).cast("string").alias("part"), "pos", "name", "type_ref", "is_required")
    parts = made["tab_parts"].join(objects, "object_id").select("tab_part_id", "full_name", F.col("name").alias("part"))
    inner = made["tab_part_attributes"].join(parts.hint("merge"), "tab_part_id").select("full_name", "part", "pos", "name", "type_ref", F.lit(None).cast("boolean").alias("is_required"))
    return own.unionByName(inner)


@query("""SELECT n_name AS name, 'ДокументСсылка.D' || n_nationkey || ', СправочникСсылка.C' || n_regionkey AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'ПередЗаписью' ELSE 'ПриЗаписи' END AS event,
'Object' || n_nationkey AS handler_module, 'F' || (n_nationkey * 8) AS handler_method FROM nation""")
def tree_subscriptions(spark, d):
    name, key = F.col("n_name"), F.col("n_nationkey")
    content = said(
        "<MetaDataObject><EventSubscription><Properties><Name>", name, "</Name><Source><Type>cfg:DocumentRef.D", key, "</Type><Type>cfg:CatalogRef.C", F.col("n_regionkey"), "</Type></Source><Event>",
        F.when(key % 2 == 0, "BeforeWrite").otherwise("OnWrite"), "</Event><Handler>CommonModule.Object", key, ".F", key * 8, "</Handler></Properties></EventSubscription></MetaDataObject>",
    )
    found = xml.subscriptions(as_files(read(spark, d, "nation"), said("src/EventSubscriptions/n", key, ".xml"), content))
    return found.select("name", "source", "event", "handler_module", "handler_method")


@query(f"""WITH {DEFINED}, s AS (SELECT s_suppkey, s_name FROM supplier) SELECT 'Documents/Object' || s_suppkey || '/Forms/Main/Ext/Form.xml' AS path, s_name AS name, 'Object,Total' AS attributes, 'Print' AS commands, 'Field' || s_suppkey || ',Go' AS items,
'OnOpen:F' || (s_suppkey * 8) || ',OnClose:Missing' AS handlers, coalesce((SELECT name FROM d WHERE k = s_suppkey * 8), '') AS resolved FROM s""")
def tree_forms(spark, d):
    """Forms with their parts, and those of their handlers that a module of the form defines."""
    key, rows = F.col("s_suppkey"), read(spark, d, "supplier")
    content = said(
        "<Form><Properties><Name>", F.col("s_name"), '</Name></Properties><Events><Event name="OnOpen">F', key * 8, '</Event><Event name="OnClose">Missing</Event></Events><Attributes><Attribute name="Object"/><Attribute name="Total"/></Attributes>',
        '<Commands><Command name="Print"/></Commands><ChildItems><InputField name="Field', key, '"/><Button name="Go"/></ChildItems></Form>',
    )
    files = as_files(rows, said("Documents/Object", key, "/Forms/Main/Ext/Form.xml"), content)
    names = code.functions(modules(spark, d)).select(said("Documents/Object", (F.substring("name", 2, 20).cast("long") / 8).cast("long"), "/Forms/Main/Ext/Form/Module.bsl").alias("path"), "name")
    found = xml.forms(files, names)
    handlers = F.array_join(F.transform("handlers", lambda h: F.concat_ws(":", h["event"], h["handler"])), ",").alias("handlers")
    return found.select("path", "name", *(F.array_join(c, ",").alias(c) for c in ("attributes", "commands", "items")), handlers, F.array_join("resolved_handlers", ",").alias("resolved"))


@query("""SELECT 'Reports/R' || s_suppkey || '/Templates/T/Ext/Template.xml' AS path, s_name AS dataset, 'Сумма,Дата' AS fields, 'Документ.D' || s_suppkey || ',Справочник.N' || s_nationkey AS query_refs, 'Период' AS parameters FROM supplier""")
def tree_report_schemas(spark, d):
    key = F.col("s_suppkey")
    content = said(
        "<DataCompositionSchema><dataSet><name>", F.col("s_name"), "</name><query>ВЫБРАТЬ 1 ИЗ Документ.D", key, " ПРИСОЕДИНИТЬ справочник.N", F.col("s_nationkey"),
        "</query><field><dataPath>Сумма</dataPath></field><field><dataPath>Дата</dataPath></field><field><dataPath>Сумма</dataPath></field></dataSet><parameter><name>Период</name></parameter></DataCompositionSchema>",
    )
    found = xml.report_schemas(as_files(read(spark, d, "supplier"), said("Reports/R", key, "/Templates/T/Ext/Template.xml"), content))
    one = found.select("path", F.get("datasets", F.lit(0)).alias("s"), F.array_join("query_refs", ",").alias("query_refs"), F.array_join("parameters", ",").alias("parameters"))
    return one.select("path", F.col("s.name").alias("dataset"), F.array_join("s.fields", ",").alias("fields"), "query_refs", "parameters")


@query("""SELECT 'Справочники.C' || c_custkey AS full_path, 'Справочники' AS object_type, 'C' || c_custkey AS name, 'Комментарий=first' || chr(10) || 'second of ' || c_custkey || ';Синоним=' || c_name AS properties FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Справочники.C' || c_custkey || '.Реквизиты.Сумма', 'Реквизит', 'Сумма', 'Тип=Число' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tree_reports(spark, d):
    """Text reports, one of each nation's customers."""
    key = F.col("c_custkey")
    block = lines(
        said("- Справочники.C", key), said('\tСиноним: "', F.col("c_name"), '"'), "\tКомментарий:", '\t\t"first', said("\t\tsecond of ", key, '"'),
        said("- Справочники.C", key, ".Реквизиты.Сумма"), '\tТип: "Число"',
    )
    texts = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(said(F.col("n_name"), ".txt").alias("path")).agg(F.array_join(listed("c_custkey", block), "\n").alias("text"))
    found = reports.report_objects(texts)
    properties = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("full_path", "object_type", "name", properties.alias("properties"))
