"""A small source tree, from files to answers."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from metaloom.operators.embedding import hashed, provider
from metaloom.plans import build, catalog
from metaloom.sources import code, files, reports, xml
from metaloom.sources.help import page

COMMON = """// Returns the rate of a currency.
// Uses the register.
//
// Параметры:
//  Валюта - what for
Функция ПолучитьСтавку(Знач Валюта, Дата = Неопределено) Экспорт
    Запрос = "ВЫБРАТЬ * ИЗ РегистрСведений.Курсы КАК К
    |ЛЕВОЕ СОЕДИНЕНИЕ from справочник.Валюты";
    Возврат Округлить(ПрочитатьКурс(Валюта));
КонецФункции

Функция ПрочитатьКурс(Валюта)
    Если ЗначениеЗаполнено(Валюта) Тогда
        Сообщить("x");
    КонецЕсли;
    Возврат 1;
КонецФункции
"""
OBJECT = """Перем М;

Процедура ПередЗаписью(Отказ)
    Ставка = Курсы.ПолучитьСтавку(Валюта);
    Курсы.НетТакой();
    Неизвестная();
    ПрочитатьКурс();
    ПересчитатьИтоги();
КонецПроцедуры

Procedure ПересчитатьИтоги() Export
    ПересчитатьИтоги();
    ЭтотОбъект.ПересчитатьИтоги();
EndProcedure
"""
DOCUMENT = """<?xml version="1.0"?><MetaDataObject xmlns="urn:m" xmlns:v8="urn:v8"><Document uuid="1"><Properties><Name>Заказ</Name>
<Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Заказ клиента</v8:content></v8:item></Synonym>
<RegisterRecords><v8:Item>AccumulationRegister.Остатки</v8:Item></RegisterRecords></Properties><ChildObjects>
<Attribute><Properties><Name>Валюта</Name><Type><v8:Type>cfg:CatalogRef.Валюты</v8:Type><v8:Type>xs:string</v8:Type></Type><FillChecking>ErrorIfNotFilled</FillChecking></Properties></Attribute>
<TabularSection><Properties><Name>Товары</Name></Properties><ChildObjects><Attribute><Properties><Name>Цена</Name><Type><v8:Type>xs:decimal</v8:Type></Type></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Document></MetaDataObject>"""
CATALOG = "<Catalog><Name>Валюты</Name><Synonym><value>Все валюты</value></Synonym></Catalog>"
SUBSCRIPTION = """<MetaDataObject><EventSubscription><Properties><Name>ПриЗаписиЗаказа</Name><Source><Type>cfg:DocumentRef.Заказ</Type></Source><Event>BeforeWrite</Event>
<Handler>CommonModule.Курсы.ПолучитьСтавку</Handler></Properties></EventSubscription></MetaDataObject>"""
JOB = "<MetaDataObject><ScheduledJob><Properties><Name>Ночное</Name><MethodName>CommonModule.Курсы.Нет</MethodName></Properties></ScheduledJob></MetaDataObject>"
FORM = """<Form><Properties><Name>Форма1</Name></Properties><Events><Event name="OnOpen">ПриОткрытии</Event><Event name="OnClose">НетТакого</Event></Events>
<Attributes><Attribute name="Объект"/></Attributes><Commands><Command name="Печать"/></Commands><ChildItems><InputField name="Поле1"/><Button name="Кнопка1"/></ChildItems></Form>"""
SCHEMA = """<DataCompositionSchema><dataSet><name>Набор</name><query>ВЫБРАТЬ 1 ИЗ Документ.Заказ</query><field><dataPath>Сумма</dataPath></field><field><dataPath>Сумма</dataPath></field></dataSet>
<parameter><name>Период</name></parameter></DataCompositionSchema>"""
REPORT = '- Справочники.Валюты\n\tСиноним: "Все валюты"\n\tКомментарий:\n\t\t"первая\n\t\tвторая"\n- Документы.Заказ.Реквизиты.Валюта\n\tТип: "Строка"\nend\n\tx: "y"\n'


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put = {
        "src/CommonModules/Курсы/Ext/Module.bsl": "﻿" + COMMON,
        "src/Documents/Заказ/Ext/ObjectModule.bsl": OBJECT.replace("\n", "\r\n"),
        "src/Documents/Заказ/Forms/Форма1/Ext/Form/Module.bsl": "Процедура ПриОткрытии(Отказ)\nКонецПроцедуры\n",
        "src/Documents/Заказ/Forms/Форма1/Ext/Form.xml": FORM,
        "src/Documents/Заказ.xml": DOCUMENT,
        "src/Catalogs/Валюты.xml": CATALOG,
        "src/Catalogs/broken.xml": "<Catalog>",
        "src/EventSubscriptions/a.xml": SUBSCRIPTION,
        "src/ScheduledJobs/b.xml": JOB,
        "src/Reports/Отчет/Templates/Схема/Ext/Template.xml": SCHEMA,
        "src/CommonModules/Пустой/Ext/Module.bsl": "",
    }
    for name, text in put.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode("cp1251" if name.endswith("ObjectModule.bsl") else "utf-8"))
    return root


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    return build.rebuild(spark, str(tree), str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def c(index):
    return catalog.Catalog(index)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_definitions(spark, tree):
    found = code.functions(files.texts(spark, str(tree), "*.bsl"))
    got = {r.name: r for r in found.collect()}
    rate = got["ПолучитьСтавку"]
    assert (rate.type, rate.params, rate.is_export, rate.line_start, rate.line_end) == ("Функция", ["Валюта", "Дата"], True, 6, 10)
    assert rate.doc == "Returns the rate of a currency. Uses the register."
    assert [(x.qualifier, x.name) for x in rate.calls] == [(None, "Округлить"), (None, "ПрочитатьКурс")]
    assert rate.query_refs == ["РегистрСведений.Курсы", "Справочник.Валюты"]
    assert got["ПрочитатьКурс"].calls == [] and not got["ПрочитатьКурс"].is_export
    again = got["ПересчитатьИтоги"]
    assert [(x.qualifier, x.name) for x in again.calls] == [("ЭтотОбъект", "ПересчитатьИтоги")] and again.is_export
    record = {r.name + str(r.line_count): r for r in code.file_records(files.texts(spark, str(tree), "*.bsl")).collect()}
    assert record["Module18"].export_functions == ["ПолучитьСтавку"]


def test_edges_and_handlers(index):
    edges = index.edges.join(index.symbols.select(F.col("symbol_id").alias("src_symbol_id"), F.col("name").alias("caller")), "src_symbol_id")
    kinds = {(r.caller, r.qualifier, r.callee_name): r.edge_type for r in edges.collect()}
    assert kinds[("ПередЗаписью", "Курсы", "ПолучитьСтавку")] == "call_commonmodule"
    assert kinds[("ПередЗаписью", "Курсы", "НетТакой")] == "call_dynamic"
    assert kinds[("ПередЗаписью", None, "Неизвестная")] == "call_platform"
    assert kinds[("ПередЗаписью", None, "ПрочитатьКурс")] == "call_unresolved"
    assert kinds[("ПередЗаписью", None, "ПересчитатьИтоги")] == "call_local"
    assert index.edges.where("resolved and dst_symbol_id is null").isEmpty()
    assert abs(index.symbols.agg(F.sum("centrality")).first()[0] - 1) < 1e-9
    assert rows(index.subscriptions, "event", "source", "handler_module", F.col("handler_symbol_id").isNotNull()) == [("ПередЗаписью", "ДокументСсылка.Заказ", "Курсы", True)]
    assert rows(index.entry_points, "kind", "name", "handler_method", F.col("handler_symbol_id").isNull()) == [("scheduled_job", "Ночное", "Нет", True)]


def test_metadata(c, index):
    assert sorted(rows(index.objects, "full_name", "synonym")) == [("Документ.Заказ", "Заказ клиента"), ("Справочник.Валюты", "Все валюты")]
    one = c.get_object_details("Неверно.заказ").first()
    assert [(a.name, a.type, a.required) for a in one.attributes] == [("Валюта", "СправочникСсылка.Валюты, Строка", True)]
    assert one.tab_parts[0].name == "Товары" and one.tab_parts[0].attributes[0].type == "Число"
    assert one.registers == ["AccumulationRegister.Остатки"]
    assert rows(c.metadatasearch("ВСЕ"), "full_name") == [("Справочник.Валюты",)]
    assert rows(c.find_references_to("Справочник.Валюты"), "referencing_object", "attribute_name") == [("Документ.Заказ", "Валюта")]
    assert c.verify_field("Документ.Заказ", "цена").first()["where"] == "tab_part:Товары"
    assert c.verify_field("Документ.Заказ", "нет").first().available == ["Валюта"]


def test_functions_queries(c):
    assert rows(c.search_function("получитьставку"), "name") == [("ПолучитьСтавку",)]
    assert rows(c.search_function("Ставк"), "name") == [("ПолучитьСтавку",)]
    assert [r[0] for r in rows(c.get_module_functions("Курсы"), "name")] == ["ПолучитьСтавку", "ПрочитатьКурс"]
    context = c.get_function_context("ПолучитьСтавку").first()
    assert context.calls == ["Округлить", "ПрочитатьКурс"] and [x.name for x in context.called_by] == ["ПередЗаписью"]
    bundle = c.read_function("ПередЗаписью", budget_chars=20, object_name="Заказ").first()
    assert bundle.object_matched and bundle.body.endswith("[truncated]") and bundle.registers == ["AccumulationRegister.Остатки"]
    assert [x.name for x in bundle.callees][:2] == ["ПолучитьСтавку", "ПересчитатьИтоги"]
    assert "body" not in c.read_function("ПередЗаписью", include_body=False).columns
    assert c.verify_call("ПередЗаписью", "получитьставку").first().holds and not c.verify_call("ПередЗаписью", "Х").first().holds
    assert len(rows(c.repomap(token_budget=1), "signature")) == 1 and len(rows(c.repomap(scope="Курсы"), "signature")) == 2
    kinds = [r[0] for r in rows(c.triggers_on_write("Документ.Заказ"), "kind")]
    assert kinds == ["handler", "movement", "subscription"]
    card = c.card("ПередЗаписью").first()
    assert card.summary == 'перед записью объекта. Процедура ПередЗаписью(Отказ) — ObjectModule Документ "Заказ клиента". Вызывает: ПолучитьСтавку, ПересчитатьИтоги'
    stats = c.stats().first()
    assert (stats.files, stats.symbols, stats.objects, stats.edges_by_type["call_local"]) == (3, 5, 2, 2)  # a file without bytes has no row


def test_all_touched_objects(spark, index):
    symbol = catalog.Catalog(index).placed.where("name = 'ПередЗаписью' and object_name = 'Заказ'").first().symbol_id
    many = index.query_refs.limit(0).unionByName(spark.range(1200).select(F.lit(symbol).alias("src_symbol_id"), F.concat(F.lit("Catalog.C"), "id").alias("object_full_name"), F.col("id").cast("int").alias("pos")), allowMissingColumns=True)
    row = catalog.Catalog(replace(index, query_refs=many)).read_function("ПередЗаписью", object_name="Заказ").first()
    assert row.touched_objects == [f"Catalog.C{i}" for i in range(1200)]


def test_greps(spark, c, tree):
    found = rows(c.code_grep("возврат", limit=1), "line", "text", "function", "truncated")
    assert found[0][1:] == ("Возврат Округлить(ПрочитатьКурс(Валюта));", "ПолучитьСтавку", False) and found[-1][-1]
    assert c.code_grep("Округлить(Прочитать").isEmpty()  # the last word of a phrase is whole
    texts = files.texts(spark, str(tree), "*.bsl").select(F.col("module_key").alias("path"), "text")
    functions = code.functions(files.texts(spark, str(tree), "*.bsl")).select(F.col("module_key").alias("path"), "name", "line_start", "line_end")
    found = rows(catalog.scan_grep(texts, functions, "перем", limit=5), "line", "function", "module_type", "truncated")
    assert found == [(1, "module level", "ObjectModule", False)]


def test_forms_schemas_reports(spark, tree):
    names = code.functions(files.texts(spark, str(tree), "*.bsl")).select("path", "name")
    form = xml.forms(files.scan(spark, str(tree), "Form.xml"), names).first()
    assert (form.name, form.attributes, form.commands, form.items, form.resolved_handlers) == ("Форма1", ["Объект"], ["Печать"], ["Поле1", "Кнопка1"], ["ПриОткрытии"])
    schema = xml.report_schemas(files.scan(spark, str(tree), "*.xml")).first()
    assert schema.query_refs == ["Документ.Заказ"] and schema.parameters == ["Период"] and schema.datasets[0].fields == ["Сумма"]
    found = reports.report_objects(spark.createDataFrame([("r.txt", REPORT)], "path string, text string")).collect()
    assert [(r.object_type, r.name, r.properties) for r in found] == [("Справочники", "Валюты", {"Синоним": "Все валюты", "Комментарий": "первая\nвторая"}), ("Реквизит", "Валюта", {"Тип": "Строка"})]


def test_help_pages():
    title, text = page("<html><head><title> T </title></head><body><div class='navbar'>no</div><main><h2>Head</h2><p>a <a href=x>link</a></p><ul><li>one<li>two</ul><script>no</script></main>rest</body></html>")
    assert title == "T" and text == "## Head\n\na link\n\n- one\n- two"
    assert page("<h1>One</h1>")[0] == "One" and page("")[1] == ""


def test_update_equals_rebuild(spark, index, tree, tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(tree, copy)
    unchanged = build.changes(index, spark, str(tree))
    assert {r.status for r in unchanged.collect()} == {"unchanged"}
    (copy / "src/CommonModules/Курсы/Ext/Module.bsl").write_text(COMMON.replace("ПолучитьСтавку", "ДатьСтавку"))
    (copy / "src/Documents/Заказ/Forms/Форма1/Ext/Form/Module.bsl").unlink()
    after, counts = build.update(index, spark, str(copy), str(tmp_path / "after"))
    assert counts["modified"] == 1 and counts["deleted"] == 1
    fresh = build.rebuild(spark, str(copy), str(tmp_path / "fresh"))
    for name, columns in (("symbols", ["symbol_id", "name", "line_end"]), ("edges", ["edge_id", "dst_symbol_id", "edge_type", "resolved"]), ("query_refs", ["src_symbol_id", "object_full_name"]), ("subscriptions", ["name", "handler_symbol_id"])):
        assert sorted(rows(getattr(after, name), *columns), key=str) == sorted(rows(getattr(fresh, name), *columns), key=str), name
    gone = after.edges.where("callee_name = 'ПолучитьСтавку'").first()
    assert gone.dst_symbol_id is None and not gone.resolved


def test_retrieval(spark):
    texts = [f"alpha beta {i}" for i in range(20)] + ["gamma"]
    part = spark.createDataFrame([(f"id{i:02}", t, f"p{i}", "Type", f"n{i}", "CommonModule" if i % 2 else "Module", i % 3 == 0, "f") for i, t in enumerate(texts)], "id string, content string, full_path string, object_type string, name string, module_type string, is_export boolean, functions string")
    chunks = catalog.chunk_table(spark, {"code": part, "help": part, "metadata": part}, provider("hashed", batch=4))
    found = catalog.Retrieval(chunks, provider("hashed"))
    query = hashed(["alpha beta 3"])[0]
    top = found.codesearch("alpha beta 3", 3).collect()
    assert top[0].name == "n3" and abs(top[0].score - 1) < 1e-3 and len(query) == 16
    assert [r.name for r in found.codesearch("gamma").collect()] == ["n20"]
    assert all(r.module_type == "CommonModule" for r in found.search_code_filtered("alpha beta 3", "CommonModule", True).collect())
    assert found.search_all("gamma").count() == 3 and {r["count"] for r in found.counts().collect()} == {21}
    assert found.helpsearch("gamma").first().title == "n20" and found.search_metadata("gamma").count() == 1
    longest = catalog.Retrieval(chunks, provider("hashed"), lambda q, c: [-len(x) for x in c])
    assert longest.codesearch("alpha beta", 1).first().content == "gamma"
    broken = catalog.Retrieval(chunks, provider("hashed"), lambda q, c: 1 / 0)
    assert broken.codesearch("alpha beta 3", 1).first().name == "n3"
    assert catalog.prepared("Документ и Документов") == "Документы и Документов"
