"""The named queries of the catalogue, run as they are over an index whose tables are made from the given ones.

Suppliers stand for files, parts for definitions, line items for calls, customers for objects, orders for
their attributes, sections and registers, nations for subscriptions. Lists are joined into texts, so that
other engines can say the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, incremental
from .operators.cells import Cells
from .operators.postings import Postings
from .plans import build, ledger, sql
from .plans.build import Index, handlers
from .plans.catalog import Catalog, scan_grep
from .plans.shared import keep, new_dir
from .streaming.ledger import append_told, ledger_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = """files AS (SELECT s_suppkey AS file_id, 'src/' || s_name || '/Module.bsl' AS path, CASE WHEN s_nationkey % 2 = 0 THEN 'ObjectModule' ELSE 'CommonModule' END AS module_type, 'Object' || s_nationkey AS object_name FROM supplier),
symbols AS (SELECT p_partkey AS symbol_id, p_partkey % 50 AS file_id, p_name AS name, p_type AS type, p_brand AS param, p_size > 25 AS is_export, p_size AS line_start, p_size + 10 AS line_end, p_retailprice / 1000 AS centrality FROM part),
edges AS (SELECT l_orderkey * 100 + l_linenumber AS edge_id, l_partkey AS src_symbol_id, CASE WHEN l_quantity > 25 THEN l_suppkey END AS dst_symbol_id, p_name AS callee_name, l_quantity > 25 AS resolved, l_returnflag AS edge_type, l_linestatus AS qualifier, l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_suppkey),
query_refs AS (SELECT o_custkey AS src_symbol_id, o_orderkey AS pos, o_orderpriority AS object_full_name FROM orders),
objects AS (SELECT c_custkey AS object_id, c_mktsegment AS object_type, c_name AS name, 'Client ' || c_custkey AS synonym, c_mktsegment || '.' || c_name AS full_name FROM customer),
attributes AS (SELECT o_custkey AS object_id, o_orderkey AS pos, 'a' || (o_orderkey % 7) AS name, 'Ref.Customer#' || lpad((o_orderkey % 150)::VARCHAR, 9, '0') AS type_ref, o_orderstatus = 'F' AS is_required FROM orders),
tab_parts AS (SELECT o_orderkey AS tab_part_id, o_custkey AS object_id, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'P'),
tab_part_attributes AS (SELECT l_orderkey AS tab_part_id, l_linenumber AS pos, 'x' || l_linenumber AS name, 'Ref.Customer#' || lpad(l_suppkey::VARCHAR, 9, '0') AS type_ref FROM lineitem),
register_movements AS (SELECT o_custkey AS document_id, o_orderpriority AS register_name FROM orders),
subscriptions AS (SELECT n_name AS name, 'Ref.Customer#' || lpad((n_nationkey * 7)::VARCHAR, 9, '0') AS source, CASE WHEN n_regionkey % 2 = 0 THEN 'BeforeWrite' ELSE 'OnWrite' END AS event, 'Object' || n_nationkey AS handler_module, CASE WHEN n_nationkey % 3 = 0 THEN 'RED widget' ELSE 'none' END AS handler_method FROM nation),
placed AS (SELECT symbols.*, path AS module_path, module_type, object_name FROM symbols JOIN files USING (file_id))"""


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {TABLES} {sql}"
        return f

    return register


def index(spark: SparkSession, d: str) -> Index:
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    customer_of = lambda column: F.concat(F.lit("Ref.Customer#"), F.lpad(column.cast("string"), 9, "0"))
    supplier, part, lineitem, orders, nation = map(read, ("supplier", "part", "lineitem", "orders", "nation"))
    module_type = F.when(F.col("s_nationkey") % 2 == 0, "ObjectModule").otherwise("CommonModule")
    files = supplier.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("src/"), "s_name", F.lit("/Module.bsl")).alias("path"), module_type.alias("module_type"), F.concat(F.lit("Object"), "s_nationkey").alias("object_name"))
    symbols = part.select(
        F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 50).alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_brand").alias("params"),
        (F.col("p_size") > 25).alias("is_export"), F.col("p_size").alias("line_start"), (F.col("p_size") + 10).alias("line_end"), (F.col("p_retailprice") / 1000).alias("centrality"), F.lit(None).cast("string").alias("doc"),
    )
    sure = F.col("l_quantity") > 25
    edges = lineitem.join(part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("callee_name")), "l_suppkey").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("src_symbol_id"), F.when(sure, F.col("l_suppkey")).alias("dst_symbol_id"), "callee_name",
        sure.alias("resolved"), F.col("l_returnflag").alias("edge_type"), F.col("l_linestatus").alias("qualifier"), F.col("l_linenumber").alias("pos"),
    )
    refs = orders.select(F.col("o_custkey").alias("src_symbol_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("object_full_name"))
    bodies = read("documents").select(F.col("doc_id").alias("symbol_id"), F.concat(F.lit("src/"), "source").alias("path"), F.col("lang").alias("function_name"), F.lit(1).alias("line_start"), F.col("text").alias("body"))
    objects = read("customer").select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("object_type"), F.col("c_name").alias("name"), F.concat(F.lit("Client "), "c_custkey").alias("synonym"), F.concat_ws(".", "c_mktsegment", "c_name").alias("full_name"))
    attributes = orders.select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("a"), F.col("o_orderkey") % 7).alias("name"), customer_of(F.col("o_orderkey") % 150).alias("type_ref"), (F.col("o_orderstatus") == "F").alias("is_required"))
    tab_parts = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("tab_part_id"), F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"))
    inner = lineitem.select(F.col("l_orderkey").alias("tab_part_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("x"), "l_linenumber").alias("name"), customer_of(F.col("l_suppkey")).alias("type_ref"))
    moves = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("register_name"))
    event = F.when(F.col("n_regionkey") % 2 == 0, "BeforeWrite").otherwise("OnWrite")
    method = F.when(F.col("n_nationkey") % 3 == 0, "RED widget").otherwise("none")
    subscribed = nation.select(F.col("n_name").alias("name"), customer_of(F.col("n_nationkey") * 7).alias("source"), event.alias("event"), F.concat(F.lit("Object"), "n_nationkey").alias("handler_module"), method.alias("handler_method"))
    subscribed = handlers(subscribed, symbols.join(files.select("file_id", "object_name"), "file_id"))
    return Index(files, symbols, edges, refs, bodies, objects, attributes, tab_parts, inner, moves, subscribed, subscribed)


def catalog(spark: SparkSession, d: str) -> Catalog:
    return Catalog(index(spark, d))


def joined(column: str):
    return F.array_join(column, ",").alias(column)


FOUND = "name, type, param AS params, is_export, line_start, line_end, module_path, module_type"


@query(f"SELECT {FOUND}, symbol_id FROM placed WHERE lower(name) = 'small ring'")
def catalog_search_function(spark, d):
    return catalog(spark, d).search_function("Small RING").withColumn("params", joined("params"))


@query(f"SELECT {FOUND}, symbol_id FROM placed WHERE contains(lower(name), 'idge')")
def catalog_search_part_of_name(spark, d):
    return catalog(spark, d).search_function("IDGE").withColumn("params", joined("params"))


@query(f"SELECT {FOUND} FROM placed WHERE contains(lower(module_path), '#00000000')")
def catalog_module_functions(spark, d):
    return catalog(spark, d).get_module_functions("#00000000").withColumn("params", joined("params"))


DETAILS = """o AS (SELECT * FROM objects WHERE name = 'Customer#000000007'),
a AS (SELECT object_id, string_agg(name || ':' || type_ref || ':' || is_required, ',' ORDER BY pos) AS attributes FROM attributes GROUP BY object_id),
i AS (SELECT tab_part_id, string_agg(name || ':' || type_ref, '+' ORDER BY pos, name, type_ref) AS inner_ FROM tab_part_attributes GROUP BY tab_part_id),
t AS (SELECT object_id, count(*) AS tab_parts FROM tab_parts GROUP BY object_id),
r AS (SELECT document_id AS object_id, string_agg(DISTINCT register_name, ',' ORDER BY register_name) AS registers FROM register_movements GROUP BY document_id)"""


@query(f", {DETAILS} SELECT name, object_type, synonym, full_name, attributes, coalesce(tab_parts, 0)::INTEGER AS tab_parts, registers FROM o LEFT JOIN a USING (object_id) LEFT JOIN t USING (object_id) LEFT JOIN r USING (object_id)")
def catalog_object_details(spark, d):
    rows = catalog(spark, d).get_object_details("any.customer#000000007")
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat_ws(":", a["name"], a["type"], a["required"].cast("string"))), ",")
    return rows.select("name", "object_type", "synonym", "full_name", attributes.alias("attributes"), F.size(F.coalesce("tab_parts", F.array())).alias("tab_parts"), joined("registers"))


@query("""SELECT DISTINCT full_name AS referencing_object, a.name AS attribute_name, type_ref AS attribute_type FROM attributes a JOIN objects USING (object_id) WHERE contains(type_ref, 'Customer#000000007')
UNION SELECT full_name || '.' || p.name, a.name, type_ref FROM tab_part_attributes a JOIN tab_parts p USING (tab_part_id) JOIN objects USING (object_id) WHERE contains(type_ref, 'Customer#000000007')""")
def catalog_references(spark, d):
    return catalog(spark, d).find_references_to("MACHINERY.Customer#000000007")


PICKED = "picked AS (SELECT * FROM placed WHERE lower(name) = 'red widget' ORDER BY is_export DESC, centrality DESC, symbol_id LIMIT 1)"
CALLERS = "callers AS (SELECT DISTINCT src_symbol_id FROM edges, picked WHERE dst_symbol_id = picked.symbol_id OR dst_symbol_id IS NULL AND lower(callee_name) = lower(picked.name))"


@query(f""", {PICKED}, {CALLERS} SELECT name, type, param AS params, is_export, module_path, module_type, line_start,
(SELECT string_agg(DISTINCT callee_name, ',' ORDER BY callee_name) FROM edges WHERE src_symbol_id = picked.symbol_id) AS calls,
(SELECT string_agg(object_name || ':' || p.name || ':' || p.line_start, ',' ORDER BY object_name, p.name, p.line_start) FROM callers c JOIN placed p ON p.symbol_id = c.src_symbol_id) AS called_by,
(SELECT count(*) FROM callers c JOIN placed p ON p.symbol_id = c.src_symbol_id)::INTEGER AS called_by_count,
(SELECT count(*) FROM placed WHERE lower(name) = 'red widget') AS ambiguous_definitions FROM picked""")
def catalog_function_context(spark, d):
    rows = catalog(spark, d).get_function_context("red widget")
    called = F.array_join(F.transform("called_by", lambda c: F.concat_ws(":", c["module"], c["name"], c["line_start"])), ",")
    return rows.withColumns({"params": joined("params"), "calls": joined("calls"), "called_by": called})


@query(f""", {PICKED}, {CALLERS}, one AS (SELECT callee_name, qualifier, bool_or(resolved) AS resolved, min(edge_type) AS edge_type, min(pos) AS pos FROM edges JOIN picked ON src_symbol_id = symbol_id GROUP BY callee_name, qualifier)
SELECT name, module_path, object_name AS owner,
(SELECT string_agg(callee_name || ':' || qualifier || ':' || edge_type || ':' || resolved, ',' ORDER BY resolved DESC, pos, callee_name, qualifier) FROM one) AS callees,
(SELECT string_agg(p.name || ':' || object_name || ':' || p.line_start, ',' ORDER BY p.name, object_name, p.line_start) FROM callers c JOIN placed p ON p.symbol_id = c.src_symbol_id) AS callers,
(SELECT string_agg(object_full_name, ',' ORDER BY pos) FROM (SELECT object_full_name, min(pos) AS pos FROM query_refs JOIN picked ON src_symbol_id = symbol_id GROUP BY object_full_name)) AS touched_objects FROM picked""")
def catalog_read_function(spark, d):
    rows = catalog(spark, d).read_function("Red Widget", include_body=False)
    callees = F.array_join(F.transform("callees", lambda c: F.concat_ws(":", c["name"], c["qualifier"], c["edge_type"], c["resolved"].cast("string"))), ",")
    callers = F.array_join(F.transform("callers", lambda c: F.concat_ws(":", c["name"], c["module"], c["line_start"])), ",")
    return rows.select("name", "module_path", "owner", callees.alias("callees"), callers.alias("callers"), joined("touched_objects"))


@query("""SELECT 'subscription' AS kind, s.name, source, event, handler_module || '.' || handler_method AS handler,
EXISTS (SELECT 1 FROM placed p WHERE p.object_name = s.handler_module AND lower(p.name) = lower(s.handler_method)) AS resolved FROM subscriptions s WHERE contains(source, 'Customer#000000007')
UNION ALL SELECT DISTINCT 'movement', register_name, NULL, NULL, NULL, NULL FROM register_movements JOIN objects ON document_id = object_id WHERE objects.name = 'Customer#000000007'""")
def catalog_triggers(spark, d):
    return catalog(spark, d).triggers_on_write("X.Customer#000000007").select("kind", "name", "source", "event", "handler", "resolved")


CALLS_BETWEEN = """, found AS (SELECT w.callee, e.* FROM (VALUES ('small ring'), ('blue widget'), ('nothing of this name')) w(callee) JOIN edges e ON lower(callee_name) = w.callee JOIN placed p ON p.symbol_id = src_symbol_id WHERE lower(p.name) = 'red widget'),
best AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY NOT resolved, edge_id, edge_type) AS place FROM found)
SELECT w.callee, edge_id IS NOT NULL AS holds, edge_type, resolved, qualifier, CASE WHEN edge_id IS NULL THEN 'no such call' END AS reason
FROM (VALUES ('small ring'), ('blue widget'), ('nothing of this name')) w(callee) LEFT JOIN best ON best.callee = w.callee AND place = 1"""


@query(CALLS_BETWEEN)
def catalog_verify_call(spark, d):
    c = catalog(spark, d)
    one, *more = (c.verify_call("RED widget", name).withColumn("callee", F.lit(name)) for name in ("small ring", "blue widget", "nothing of this name"))
    return one.unionByName(more[0]).unionByName(more[1])


ASKED = "('A0'), ('a3'), ('a6'), ('X1'), ('x4'), ('none')"


@query(f""", f(field) AS (VALUES {ASKED}), o AS (SELECT * FROM objects WHERE name = 'Customer#000000007'),
own AS (SELECT field, count(*) AS n FROM f JOIN attributes a ON lower(a.name) = lower(field) JOIN o USING (object_id) GROUP BY field),
part AS (SELECT field, arg_min(p.name, p.tab_part_id) AS name FROM f JOIN tab_part_attributes i ON lower(i.name) = lower(field) JOIN tab_parts p USING (tab_part_id) JOIN o USING (object_id) GROUP BY field),
w AS (SELECT field, CASE WHEN own.n > 0 THEN 'attribute' WHEN part.name IS NOT NULL THEN 'tab_part:' || part.name END AS place FROM f LEFT JOIN own USING (field) LEFT JOIN part USING (field))
SELECT field, place IS NOT NULL AS holds, place AS "where", CASE WHEN place IS NULL THEN (SELECT string_agg(name, ',' ORDER BY pos) FROM (SELECT a.name, pos FROM attributes a JOIN o USING (object_id) ORDER BY pos LIMIT 30)) END AS available FROM w, o""")
def catalog_verify_field(spark, d):
    c = catalog(spark, d)
    one, *more = (c.verify_field("Customer#000000007", name).withColumn("field", F.lit(name)) for name in ("A0", "a3", "a6", "X1", "x4", "none"))
    return reduce(DataFrame.unionByName, more, one).withColumn("available", joined("available"))


ALL_CARDS = """, c AS (SELECT src_symbol_id AS symbol_id, list(callee_name ORDER BY pos, callee_name) AS calls FROM (SELECT src_symbol_id, callee_name, min(pos) AS pos FROM edges WHERE resolved GROUP BY src_symbol_id, callee_name) GROUP BY src_symbol_id),
q AS (SELECT src_symbol_id AS symbol_id, list(object_full_name ORDER BY pos) AS touches FROM (SELECT src_symbol_id, object_full_name, min(pos) AS pos FROM query_refs GROUP BY src_symbol_id, object_full_name) GROUP BY src_symbol_id),
r AS (SELECT placed.*, type || ' ' || name || '(' || param || ')' || CASE WHEN is_export THEN ' Экспорт' ELSE '' END AS signature, coalesce(calls[1:15], []) AS calls, coalesce(touches[1:15], []) AS touches FROM placed LEFT JOIN c USING (symbol_id) LEFT JOIN q USING (symbol_id))
SELECT symbol_id, name AS symbol, signature, module_type, object_name AS owner, array_to_string(calls, ',') AS calls, array_to_string(touches, ',') AS touches,
signature || ' — ' || module_type || ' ' || object_name || CASE WHEN len(calls) > 0 THEN '. Вызывает: ' || array_to_string(calls[1:8], ', ') ELSE '' END || CASE WHEN len(touches) > 0 THEN '. Работает с: ' || array_to_string(touches[1:8], ', ') ELSE '' END AS summary FROM r"""


@query(ALL_CARDS)
def catalog_cards(spark, d):
    rows = catalog(spark, d).cards()
    return rows.select("symbol_id", "symbol", "signature", "module_type", "owner", joined("calls"), joined("touches"), "summary")


@query("""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM objects) AS objects, (SELECT count(*) FROM attributes) AS attributes,
(SELECT count(*) FROM edges) AS edges_total, (SELECT count(*) FROM edges WHERE resolved) AS edges_resolved, (SELECT string_agg(edge_type || ':' || n, ',' ORDER BY edge_type) FROM (SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type)) AS edges_by_type""")
def catalog_stats(spark, d):
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("edges_by_type")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return catalog(spark, d).stats().withColumn("edges_by_type", kinds)


@query("""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN CASE WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' ELSE 'touched' END ELSE 'modified' END AS status
FROM (SELECT doc_id::VARCHAR AS path, 1 AS mtime, length(text) AS size, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL) o
FULL JOIN (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS mtime, length(t) AS size, sha256(t) AS hash FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL)) n ON o.path = n.path""")
def ledger_changes(spark, d):
    """A stored state of some files against a listing of others: only those whose stat differs are hashed."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    path = F.col("doc_id").cast("string").alias("path")
    stored = docs.where("doc_id % 5 <> 0").select(path, F.timestamp_seconds(F.lit(1)).alias("mtime"), F.length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    listing = now.select(path, F.timestamp_seconds(F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)).alias("mtime"), F.length("text").alias("size"))
    return incremental.detect_changes(stored, listing, now.select(path, F.encode("text", "utf-8").alias("content"))).select("path", "status")


@query("""SELECT path, collection, status, error_message, retry_count FROM (
WITH there AS (SELECT doc_id::VARCHAR AS path, source AS collection, doc_id, sha256(text) AS hash, doc_id % 4 = 0 AS changed, doc_id % 3 = 0 AS bad, (doc_id % 6)::INTEGER AS times, doc_id % 5 <> 0 AS known, doc_id % 4 AS wanted FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL),
tried AS (SELECT *, NOT known OR changed OR (bad AND times < 3) AS due, (SELECT count(*) FROM generate_series(1, wanted) g(n) WHERE (doc_id + n) % 11 = 0) AS lacking FROM there)
SELECT path, collection, CASE WHEN NOT due THEN CASE WHEN bad THEN 'failed' ELSE 'indexed' END WHEN wanted = 0 THEN 'skipped' WHEN lacking > 0 THEN 'failed' ELSE 'indexed' END AS status,
CASE WHEN NOT due THEN CASE WHEN bad THEN 'before' END WHEN wanted = 0 THEN 'no chunks' WHEN lacking > 0 THEN lacking || ' of ' || wanted || ' chunks have no vector' END AS error_message,
CASE WHEN NOT due THEN CASE WHEN bad THEN times ELSE 0 END WHEN wanted > 0 AND lacking > 0 THEN CASE WHEN known AND bad THEN times ELSE 0 END + 1 ELSE 0 END AS retry_count FROM tried WHERE known OR due)""")
def ledger_round(spark, d):
    """A round over documents as files: what is due by the ledger, what their chunks came to, and the ledger after it."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source is not null").withColumns({"path": F.col("doc_id").cast("string"), "collection": F.col("source"), "now": F.sha2("text", 256)})
    there = docs.where("doc_id % 7 <> 0").select("path", "collection", F.col("now").alias("hash"))
    bad = F.col("doc_id") % 3 == 0
    status, times = F.when(bad, "failed").otherwise("indexed").alias("status"), F.when(bad, F.col("doc_id") % 6).otherwise(0).cast("int").alias("retry_count")
    was = F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.col("now")).alias("hash")
    files = docs.where("doc_id % 5 <> 0").select("path", "collection", was, F.lit("2024-01-01").cast("timestamp").alias("indexed_at"), status, F.when(bad, F.lit("before")).alias("error_message"), times)
    wanted = docs.where("doc_id % 4 <> 0").select("path", "collection", "doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))).alias("n")).withColumn("id", F.concat_ws("-", "doc_id", "n"))
    updates = ledger.outcomes(ledger.due(files, there), wanted, wanted.where("(doc_id + n) % 11 <> 0"), "2024-02-01")
    return ledger.files_after(files, there, updates).select("path", "collection", "status", "error_message", "retry_count")


@query("""SELECT doc_id::VARCHAR AS path, source AS function_name, CASE WHEN doc_id % 3 = 0 OR (doc_id % 2 = 1 AND doc_id % 5 <> 0) THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END::VARCHAR AS day, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'old' ELSE text END) AS hash
FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND (doc_id % 3 <> 0 OR doc_id % 5 <> 0)""")
def ledger_definitions(spark, d):
    """The ledger of definitions after a round: bodies it didn't know are written, but those of failed files stay as they were."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source is not null and text is not null").withColumn("path", F.col("doc_id").cast("string"))
    bodies = docs.select("path", F.col("source").alias("function_name"), F.col("text").alias("body"))
    old = docs.where("doc_id % 5 <> 0").select("path", F.col("source").alias("function_name"), F.lit("code").alias("collection"), F.sha2(F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.col("text")), 256).alias("hash"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at"))
    files = docs.select("path", F.lit("code").alias("collection"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("indexed").alias("status"))
    gone = old.limit(1).withColumn("function_name", F.lit("gone"))
    after, _ = ledger.definitions_after(old.unionByName(gone), bodies, files, "2024-02-01")
    return after.select("path", "function_name", F.date_format("indexed_at", "yyyy-MM-dd").alias("day"), "hash")


@query("""SELECT path, hash, status, retry_count, due FROM (WITH done AS (SELECT user_id, max((ts, coalesce(props, ''))) FILTER (event_type <> 'error') AS d, max(ts) FILTER (event_type <> 'error') AS done_at FROM events GROUP BY user_id),
f AS (SELECT e.user_id, count(DISTINCT ts)::INTEGER AS n, max(ts) AS last, arg_max(props, (ts, coalesce(props, ''))) AS hash FROM events e JOIN done USING (user_id) WHERE event_type = 'error' AND (done_at IS NULL OR ts > done_at) GROUP BY e.user_id),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT done.user_id::VARCHAR AS path, CASE WHEN f.n IS NULL THEN (SELECT max(props) FROM events x WHERE x.user_id = done.user_id AND ts = done_at AND event_type <> 'error') ELSE f.hash END AS hash,
CASE WHEN f.n IS NULL THEN 'indexed' ELSE 'failed' END AS status, coalesce(f.n, 0) AS retry_count, coalesce(f.n < 3 AND f.last + INTERVAL 10 MINUTE < (SELECT mark FROM w), false) AS due FROM done LEFT JOIN f USING (user_id) WHERE done.user_id IS NOT NULL)""")
def ledger_stream_state(spark, d):
    """Events as a stream of attempts: how each file stands at its end, and whether its timer told that it is due again."""
    table = f"{d}/events.parquet"
    # a pattern, as a stream takes one file for the folder of its partitions
    events = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{d}/events.parque[t]")
    failed = F.when(F.col("event_type") == "error", "failed").otherwise("indexed")
    attempts = events.select(F.col("user_id").cast("string").alias("path"), F.lit("code").alias("collection"), F.col("props").alias("hash"), failed.alias("status"), F.col("ts").alias("at"))
    target = new_dir(spark, "ledger_stream")
    append_told(ledger_stream(attempts), target, new_dir(spark, "ledger_checkpoint")).awaitTermination()
    told = spark.read.parquet(target)
    last = told.where("event = 'status'").groupBy("path").agg(F.max_by(F.struct("hash", "status", "retry_count"), "batch").alias("s"))
    due = told.where("event = 'retry'").select("path", F.lit(True).alias("due")).distinct()
    return last.select("path", "s.*").join(due, "path", "left").select("path", "hash", "status", "retry_count", F.coalesce("due", F.lit(False)).alias("due"))


# indexes


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as they were, what is new of them, and which are gone."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text", "source", "lang")
    fresh = docs.where("doc % 5 = 1 and doc % 7 <> 0").withColumn("text", F.concat(F.lit("Changed Words\nof the "), F.lower("text")))
    return docs.where("doc % 3 <> 0"), fresh, docs.where("doc % 7 = 0").select("doc")


NOW = """now AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 1 THEN 'Changed Words' || chr(10) || 'of the ' || lower(text) ELSE text END AS text, source, lang FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 5 = 1))"""


def updated_index(spark: SparkSession, d: str, kind: str) -> Postings:
    """An index of documents after an update that adds, replaces and deletes."""
    before, fresh, gone = _changed(spark, d)
    return Postings.write(before, kind, new_dir(spark, kind)).updated(fresh, gone, new_dir(spark, kind))


PATTERNS = ("the of", "Of THE with", "inter", "wit", "words\nof", "(of the", "keine", "xq")
PHRASES = ", ".join("('" + p.replace("\n", "' || chr(10) || '") + "')" for p in PATTERNS)


@query(f""", {NOW}, p(pattern) AS (VALUES {PHRASES}), w AS (SELECT pattern, regexp_extract_all(lower(pattern), '[\\p{{L}}\\p{{N}}]+') AS ws FROM p),
t AS (SELECT doc, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS padded FROM now)
SELECT pattern, doc FROM w, t WHERE contains(padded, ' ' || array_to_string(ws, ' ') || CASE WHEN len(ws) > 1 THEN ' ' ELSE '' END)""")
def index_words(spark, d):
    """Phrases, and beginnings of words, from the postings of their words alone."""
    index = updated_index(spark, d, "words")
    return reduce(DataFrame.unionByName, (index.words(p).select(F.lit(p).alias("pattern"), "doc") for p in PATTERNS))


NEEDLES = ("e", "on", "ing t", "THE OF", "ß", "@", "in,", "Words of", "not in any of these texts")


@query(f""", {NOW}, n(needle) AS (VALUES {", ".join(f"('{n}')" for n in NEEDLES)}) SELECT needle, doc, length(text)::INTEGER AS length FROM n, now WHERE contains(lower(text), lower(needle))""")
def index_trigrams(spark, d):
    """Substrings of any length by their rarest trigrams, checked on the texts found."""
    index = updated_index(spark, d, "trigrams")
    return reduce(DataFrame.unionByName, (index.containing(n).select(F.lit(n).alias("needle"), "doc", F.length("text").alias("length")) for n in NEEDLES))


@query(f""", {NOW}, l AS (SELECT *, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, string_split(text, chr(10)) AS lines FROM now
  WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' the of ')),
hits AS (SELECT 'src/' || doc AS file, line, trim(content) AS text, lang AS function, source AS module_type, array_to_string(lines[greatest(1, line - 2):line + 2], chr(10)) AS context FROM l WHERE contains(lower(content), 'the of')),
placed_ AS (SELECT *, row_number() OVER (ORDER BY file, line) AS place FROM hits)
SELECT CASE WHEN place <= 40 THEN file END AS file, CASE WHEN place <= 40 THEN line::INTEGER END AS line, CASE WHEN place <= 40 THEN text END AS text, CASE WHEN place <= 40 THEN function END AS function,
  CASE WHEN place <= 40 THEN module_type END AS module_type, CASE WHEN place <= 40 THEN context END AS context, place > 40 AS truncated FROM placed_ WHERE place <= 41""")
def catalog_code_grep(spark, d):
    """The catalogue's grep over an index of words that was updated."""
    before, fresh, gone = _changed(spark, d)
    as_body = lambda df: df.select("doc", "text", F.concat(F.lit("src/"), "doc").alias("path"), F.col("lang").alias("function_name"), F.lit(1).alias("line_start"))
    words = Postings.write(as_body(before), "words", new_dir(spark, "words")).updated(as_body(fresh), gone, new_dir(spark, "words"))
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("src/"), "doc_id").alias("path"), F.col("source").alias("module_type"), F.col("doc_id").alias("file_id"), F.lit(None).cast("string").alias("object_name"))
    made = index(spark, d)
    made.files = files
    return Catalog(made, words).code_grep("the of", limit=40)


@query(f""", {NOW}, f AS (SELECT 'src/' || (p_partkey % 400) AS path, p_name AS name, p_size % 20 AS line_start, p_size % 20 + p_size AS line_end FROM part),
l AS (SELECT 'src/' || doc AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, string_split(text, chr(10)) AS lines FROM now),
hits AS (SELECT path, line, trim(content) AS text, array_to_string(lines[greatest(1, line - 2):line + 2], chr(10)) AS context FROM l WHERE contains(lower(content), 'ring')),
named AS (SELECT path AS file, line, text, coalesce((SELECT max({{'s': line_start, 'n': name}}).n FROM f WHERE f.path = hits.path AND line BETWEEN line_start AND line_end), 'module level') AS function, context FROM hits),
placed_ AS (SELECT *, row_number() OVER (ORDER BY file, line) AS place FROM named)
SELECT CASE WHEN place <= 500 THEN file END AS file, CASE WHEN place <= 500 THEN line END AS line, CASE WHEN place <= 500 THEN text END AS text, CASE WHEN place <= 500 THEN function END AS function,
  CASE WHEN place <= 500 THEN 'Module' END AS module_type, CASE WHEN place <= 500 THEN context END AS context, place > 500 AS truncated FROM placed_ WHERE place <= 501""")
def catalog_scan_grep(spark, d):
    """Lines with a substring, the texts by trigrams, and the definition each line stands in by dyadic blocks."""
    path = lambda column: F.concat(F.lit("src/"), column)
    texts = updated_index(spark, d, "trigrams").containing("ring").select(path("doc").alias("path"), "text")
    parts = spark.read.parquet(f"{d}/part.parquet")
    functions = parts.select(path(F.col("p_partkey") % 400).alias("path"), F.col("p_name").alias("name"), (F.col("p_size") % 20).alias("line_start"), (F.col("p_size") % 20 + F.col("p_size")).alias("line_end"))
    return scan_grep(texts, functions, "Ring", limit=500)


@query(ORACLE_SQL["catalog_references"].removeprefix(f"WITH {TABLES} "))
def catalog_references_by_trigrams(spark, d):
    made = index(spark, d)
    return Catalog(made, types=build.index_types(made, new_dir(spark, "types"))).find_references_to("MACHINERY.Customer#000000007")


_GAP = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2))"


@query(f""", r AS (SELECT q.vec_id AS query_id, e.vec_id, round({_GAP}, 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_GAP}, e.vec_id) AS place
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3)) q WHERE q.vec_id < 2 OR e.label = 3) SELECT query_id, vec_id, distance FROM r WHERE place <= 10""")
def knn_by_cells(spark, d):
    """Exact neighbours, with and without a filter, from the cells that can hold them; a fifth of the rows came later."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    cells = Cells.write(rows.where("vec_id % 5 <> 4"), "vec_id", "embedding", new_dir(spark, "cells")).added(rows.where("vec_id % 5 = 4"), new_dir(spark, "cells"))
    asked = {r["vec_id"]: list(r["embedding"]) for r in rows.where("vec_id < 4").collect()}
    found = [cells.nearest(v, 10, None if i < 2 else F.col("label") == 3).select(F.lit(i).cast("long").alias("query_id"), "vec_id", F.round("distance", 9).alias("distance")) for i, v in sorted(asked.items())]
    return reduce(DataFrame.unionByName, found)


@query(""", e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS src_symbol_id, l_suppkey AS src_file_id, CASE WHEN l_linestatus = 'F' THEN 'Object' || l_suppkey END AS qualifier, coalesce(p_name, 'none') || (l_partkey % 2) AS callee_name FROM lineitem LEFT JOIN part ON p_partkey = l_suppkey),
s AS (SELECT p_partkey AS symbol_id, p_partkey % 60 AS file_id, p_name || (p_partkey % 2) AS name, 'Object' || (p_partkey % 60) AS object_name, CASE WHEN p_partkey % 3 = 0 THEN 'CommonModule' ELSE 'ObjectModule' END AS module_type FROM part WHERE p_partkey % 11 <> 3),
t AS (SELECT e.*, lower(callee_name) AS c, (SELECT min(symbol_id) FROM s WHERE module_type = 'CommonModule' AND object_name = qualifier AND lower(name) = lower(callee_name)) AS common,
  (SELECT min(symbol_id) FROM s WHERE file_id = src_file_id AND lower(name) = lower(callee_name)) AS local, EXISTS (SELECT 1 FROM s WHERE lower(name) = lower(callee_name)) AS known FROM e)
SELECT edge_id, CASE WHEN qualifier IS NULL THEN local ELSE common END AS dst_symbol_id,
CASE WHEN qualifier IS NOT NULL AND common IS NOT NULL THEN 'call_commonmodule' WHEN qualifier IS NULL AND local IS NOT NULL THEN 'call_local' WHEN qualifier IS NOT NULL THEN 'call_dynamic' WHEN NOT known THEN 'call_platform' ELSE 'call_unresolved' END AS edge_type FROM t""")
def edges_re_resolved(spark, d):
    """Edges resolved against some symbols, then again after a change of symbols, by the delta of their names."""
    part, lines = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("part", "lineitem"))
    symbols = part.select(
        F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 60).alias("file_id"), F.concat("p_name", F.col("p_partkey") % 2).alias("name"),
        F.concat(F.lit("Object"), F.col("p_partkey") % 60).alias("object_name"), F.when(F.col("p_partkey") % 3 == 0, "CommonModule").otherwise("ObjectModule").alias("module_type"),
    )
    named = lines.join(part.select(F.col("p_partkey").alias("l_suppkey"), "p_name"), "l_suppkey", "left")
    edges = named.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("src_symbol_id"), F.col("l_suppkey").alias("src_file_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Object"), "l_suppkey")).alias("qualifier"), F.concat(F.coalesce("p_name", F.lit("none")), F.col("l_partkey") % 2).alias("callee_name"),
    )
    old, new = symbols.where("symbol_id % 13 <> 5"), symbols.where("symbol_id % 11 <> 3")
    later = F.col("edge_id") % 17 == 0
    known = keep(graph.classify(edges.where(~later), old), "edges")
    gone, come = (a.join(b, "symbol_id", "left_anti").select("symbol_id", "name") for a, b in ((old, new), (new, old)))
    return build.re_resolved(known, edges.where(later), gone, come, new).select("edge_id", "dst_symbol_id", "edge_type")


@query("""SELECT src_symbol_id AS id, string_agg(callee_name, ',' ORDER BY first, callee_name) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY src_symbol_id ORDER BY first, callee_name) AS place
FROM (SELECT src_symbol_id, callee_name, min(edge_id) AS first FROM edges GROUP BY src_symbol_id, callee_name)) WHERE place <= 5 GROUP BY src_symbol_id""")
def adjacency_lists(spark, d):
    return graph.adjacency(index(spark, d).edges, F.col("src_symbol_id"), F.col("callee_name"), "calls", 5).select("id", joined("calls"))


# from SQL


def _from_sql(spark: SparkSession, d: str, statement: str) -> DataFrame:
    sql.register(index(spark, d), "idx_")
    return spark.sql(statement)


@query(f", {PICKED.replace(' ORDER BY is_export DESC, centrality DESC, symbol_id LIMIT 1', '')}, {CALLERS} SELECT DISTINCT p.symbol_id, p.name, p.module_path, p.line_start FROM callers JOIN placed p ON p.symbol_id = src_symbol_id")
def sql_callers_of(spark, d):
    return _from_sql(spark, d, "SELECT symbol_id, name, module_path, line_start FROM idx_callers_of('Red Widget')")


@query("SELECT s.name, e.qualifier, e.callee_name, e.edge_type, count(*) AS times FROM placed s JOIN edges e ON e.src_symbol_id = s.symbol_id WHERE lower(s.name) = 'red widget' GROUP BY ALL")
def sql_callees_of(spark, d):
    return _from_sql(spark, d, "SELECT f.name, qualifier, callee_name, edge_type, count(*) AS times FROM idx_callees_of('red widget') JOIN idx_functions_named('RED widget') f USING (symbol_id) GROUP BY ALL")


@query("SELECT edge_id, edge_type, resolved, e.qualifier FROM edges e JOIN placed s ON s.symbol_id = src_symbol_id WHERE lower(s.name) = 'red widget' AND lower(callee_name) = 'small ring'")
def sql_calls_between(spark, d):
    return _from_sql(spark, d, "SELECT * FROM idx_calls_between('red widget', 'Small Ring')")


@query("SELECT module_path, count(*) AS functions, count(*) FILTER (is_export) AS exported FROM placed WHERE contains(lower(module_path), '#00000000') AND contains(lower(name), 'ring') GROUP BY module_path")
def sql_functions_of_module(spark, d):
    return _from_sql(spark, d, "SELECT module_path, count(*) AS functions, count_if(is_export) AS exported FROM idx_functions_of_module('#00000000') JOIN (SELECT symbol_id FROM idx_functions_like('RING')) USING (symbol_id) GROUP BY module_path")


@query("""SELECT full_name, NULL AS part, a.pos, a.name, type_ref FROM objects o JOIN attributes a USING (object_id) WHERE o.name = 'Customer#000000007'
UNION ALL SELECT full_name, t.name, i.pos, i.name, type_ref FROM objects o JOIN tab_parts t USING (object_id) JOIN tab_part_attributes i USING (tab_part_id) WHERE o.name = 'Customer#000000007'""")
def sql_attributes_of(spark, d):
    return _from_sql(spark, d, "SELECT a.* FROM idx_attributes_of('customer#000000007') a JOIN idx_objects_named('Customer#000000007') USING (full_name)")


@query(ORACLE_SQL["catalog_references"].removeprefix(f"WITH {TABLES} "))
def sql_references_to(spark, d):
    return _from_sql(spark, d, "SELECT * FROM idx_references_to('Customer#000000007')")


@query("""SELECT 'src/' || source AS path, lang AS function_name, line::INTEGER AS line, trim(content) AS text FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE contains(lower(content), 'the of')""")
def sql_body_lines(spark, d):
    return _from_sql(spark, d, "SELECT * FROM idx_body_lines('The of')")
