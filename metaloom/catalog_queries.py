"""The registered queries of the analytics operators, and the SQL that checks them.

The operators work on code and metadata; here each runs on a table of the same shape: orders and
line items for files, symbols and edges, documents for module texts, events for a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, paths
from .functions import text as tx
from .operators import graph, incremental, joins, lookup, nested, ranking, vectors
from .operators import text as grep_ops
from .operators.chunks import chunks
from .sources.decode import decoded
from .sources.help import help_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def index_stats(spark, d):
    parts = [read(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, count(*) AS edges, count(*) FILTER (WHERE value > 50) AS resolved FROM events GROUP BY event_type")
def edge_type_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("edges"), F.count_if(F.col("value") > 50).alias("resolved"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def ledger_status_counts(spark, d):
    return incremental.pivoted(read(spark, d, "labels"), "quality", "toxic", [0, 1], "toxic_")


@query("SELECT * FROM part WHERE lower(p_name) = lower('RED Widget')")
def find_exact_folded(spark, d):
    return lookup.find_exact(read(spark, d, "part"), "p_name", "RED Widget")


_PADDED = "' ' || array_to_string(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query(f"""WITH t AS (
  SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'blue bol' THEN 0 WHEN contains({_PADDED.format("p_name")}, ' blue ') AND contains({_PADDED.format("p_name")}, ' bol ') THEN 1
    WHEN contains(lower(p_name), 'blue bol') THEN 2 END AS tier FROM part)
SELECT p_partkey, p_name, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def find_tiered(spark, d):
    return lookup.find_tiered(read(spark, d, "part"), "p_name", "Blue bol").select("p_partkey", "p_name", "tier")


@query("SELECT l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def module_functions(spark, d):
    return read(spark, d, "lineitem").where("l_orderkey = 7").select("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").orderBy("l_linenumber")


@query("SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def symbols_join_files(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def three_way_join(spark, d):
    placed = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "supplier").join(placed, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT DISTINCT o_orderkey, c_custkey, c_name FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS dst, 'CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0') AS callee FROM orders)
JOIN customer ON dst = c_custkey OR (dst IS NULL AND lower(callee) = lower(c_name))""")
def callers_union(spark, d):
    edges = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("dst"), F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("callee"))
    people = read(spark, d, "customer").select("c_custkey", "c_name")
    by_name = F.col("dst").isNull() & (lookup.folded("callee") == lookup.folded("c_name"))
    return joins.either_key(edges, people, F.col("dst") == F.col("c_custkey"), by_name, ["o_orderkey", "c_custkey", "c_name"]).select("o_orderkey", "c_custkey", "c_name")


@query("""SELECT p_partkey, p_name, least_supplier FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS least_supplier FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) ON p_partkey = l_partkey""")
def resolve_scalar_min(spark, d):
    targets = read(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    return joins.resolve_least(read(spark, d, "part"), targets, ["p_partkey"], "l_suppkey", "least_supplier").select("p_partkey", "p_name", "least_supplier")


_EDGES = """e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_suppkey % 7 AS src_file_id, CASE WHEN l_linenumber % 3 = 0 THEN 'Brand#' || (l_partkey % 30) WHEN l_linenumber % 3 = 1 THEN '' END AS qualifier,
  CASE WHEN l_partkey % 4 = 0 THEN 'unknown ' || l_partkey ELSE upper(p_name) END AS callee_name FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT p_partkey AS symbol_id, p_partkey % 7 AS file_id, p_name AS name, p_brand AS object_name, CASE WHEN p_size % 2 = 0 THEN 'CommonModule' ELSE 'ObjectModule' END AS module_type FROM part WHERE p_partkey % 3 <> 0)"""


@query(f"""WITH {_EDGES},
c AS (SELECT object_name, lower(name) AS name, min(symbol_id) AS id FROM s WHERE module_type = 'CommonModule' GROUP BY ALL),
l AS (SELECT file_id, lower(name) AS name, min(symbol_id) AS id FROM s GROUP BY ALL),
k AS (SELECT DISTINCT lower(name) AS name FROM s),
r AS (SELECT e.edge_id, nullif(e.qualifier, '') AS q, c.id AS common, l.id AS local, k.name AS known FROM e LEFT JOIN c ON e.qualifier = c.object_name AND lower(callee_name) = c.name
  LEFT JOIN l ON e.src_file_id = l.file_id AND lower(callee_name) = l.name LEFT JOIN k ON lower(callee_name) = k.name)
SELECT edge_id, CASE WHEN q IS NULL THEN local ELSE common END AS dst_symbol_id, CASE WHEN q IS NOT NULL AND common IS NOT NULL THEN 'call_commonmodule' WHEN q IS NULL AND local IS NOT NULL THEN 'call_local'
  WHEN q IS NOT NULL THEN 'call_dynamic' WHEN known IS NULL THEN 'call_platform' ELSE 'call_unresolved' END AS edge_type FROM r""")
def edge_taxonomy(spark, d):
    lines, parts = read(spark, d, "lineitem"), read(spark, d, "part")
    qualifier = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Brand#"), (F.col("l_partkey") % 30).cast("string"))).when(F.col("l_linenumber") % 3 == 1, "")
    callee = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("unknown "), F.col("l_partkey").cast("string"))).otherwise(F.upper("p_name"))
    edges = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_suppkey") % 7).alias("src_file_id"), qualifier.alias("qualifier"), callee.alias("callee_name"))
    symbols = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 7).alias("file_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("object_name"), F.when(F.col("p_size") % 2 == 0, "CommonModule").otherwise("ObjectModule").alias("module_type"))
    return graph.classify(edges, symbols).select("edge_id", "dst_symbol_id", "edge_type")


@query("""SELECT c_custkey, 'without orders' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT doc_id, 'with labels' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def anti_semi_membership(spark, d):
    without = lookup.only_in(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", F.lit("without orders").alias("kind"))
    labelled = lookup.also_in(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")
    return without.unionByName(labelled.select(F.col("doc_id").alias("c_custkey"), F.lit("with labels").alias("kind")))


@query("""SELECT s.event_id AS span_id, p.event_id FROM events s JOIN events p ON s.user_id = p.user_id AND epoch_us(p.ts) BETWEEN epoch_us(s.ts) AND epoch_us(s.ts) + 43200000000
WHERE s.event_type = 'signup' AND p.event_type = 'click'""")
def range_join_containment(spark, d):
    events = read(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + 43_200_000_000).alias("end"))
    points = events.where("event_type = 'click'").select("user_id", "event_id", "at")
    return joins.within(points, "at", spans, "start", "end", 43_200_000_000, ["user_id"]).select("span_id", "event_id")


def _pagerank_sql(iterations: int) -> str:
    steps = ["""e AS (SELECT o_custkey AS src, 1000000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
v AS (SELECT c_custkey AS id FROM customer UNION SELECT 1000000000 + s_suppkey FROM supplier), n AS (SELECT count(*)::DOUBLE AS n FROM v),
w AS (SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS w FROM e GROUP BY src, dst), r0 AS (SELECT id, 1 / n AS rank FROM v, n)"""]
    for i in range(iterations):
        steps.append(f"""r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (SELECT sum(rank) FROM r{i} WHERE id NOT IN (SELECT src FROM w)) / n + 0.85 * coalesce(got, 0) AS rank
FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank * w) AS got FROM w JOIN r{i} ON src = id GROUP BY dst) ON v.id = dst)""".replace("r%d AS" % (i + 1), "r%d AS MATERIALIZED" % (i + 1)))
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{iterations}"


@query(_pagerank_sql(20))
def graph_pagerank(spark, d):
    edges = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.lit(1_000_000_000) + F.col("l_suppkey")).alias("dst"))
    vertices = read(spark, d, "customer").select(F.col("c_custkey").alias("id")).unionByName(read(spark, d, "supplier").select((F.lit(1_000_000_000) + F.col("s_suppkey")).alias("id")))
    return graph.pagerank(vertices, edges).select("id", F.round("rank", 9).alias("rank"))


@query("""SELECT p_partkey, p_name, used, place FROM (SELECT *, sum(length(p_name) + length(p_brand)) OVER w AS used, row_number() OVER w AS place FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60)
WINDOW w AS (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING)) WHERE used <= 700 OR place = 1""".replace("SELECT p_partkey, p_name, used, place", "SELECT p_partkey, p_name, used::BIGINT AS used, place::INTEGER AS place"))
def repomap_budget(spark, d):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return ranking.within_budget(read(spark, d, "part"), order, 60, F.length("p_name") + F.length("p_brand"), 700).select("p_partkey", "p_name", "used", "place")


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1")
def pick_best_symbol(spark, d):
    return ranking.best_of(read(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""SELECT o_orderkey, c_name, coalesce(n_lines, 0) AS n_lines, coalesce(lines, '') AS lines, n_orders FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE r <= 5) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY l_orderkey) ON o_orderkey = l_orderkey
JOIN (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = k""")
def context_bundle(spark, d):
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    listed = nested.ordered(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"], F.concat_ws(":", "l_linenumber", "l_partkey"), "line", 5)
    listed = listed.select("l_orderkey", F.col("n").alias("n_lines"), F.array_join("line", ",").alias("lines"))
    counts = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    rows = orders.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(counts, F.col("o_custkey") == F.col("k"))
    return rows.select("o_orderkey", "c_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("lines", F.lit("")).alias("lines"), "n_orders")


@query("""SELECT r_name, string_agg(n_name || '[' || coalesce(s, '') || ']', ';' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey
LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey GROUP BY r_name""")
def object_details(spark, d):
    inner = nested.ordered(read(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey"], F.col("s_name"), "suppliers")
    nations = read(spark, d, "nation").join(inner, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat("n_name", F.lit("["), F.coalesce(F.array_join("suppliers", ","), F.lit("")), F.lit("]"))
    return nested.ordered(nations, ["r_name"], ["n_nationkey"], text, "nations").select("r_name", F.array_join("nations", ";").alias("nations"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(text), 'token =') OR contains(lower(source), 'src1')")
def references_like_any(spark, d):
    rows = read(spark, d, "documents")
    tests = lookup.has_substring("text", "Licensed under") | lookup.has_substring("text", "token =") | lookup.has_substring("source", "SRC1")
    return rows.where(tests).select("doc_id", "lang")


@query("""SELECT 'handler' AS kind, event_type AS name, event_id AS id FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL SELECT 'subscription', url, page_id FROM pages WHERE contains(lower(url), 'blog.')
UNION ALL SELECT 'movement', c_name, c_custkey FROM customer WHERE c_nationkey = 3""")
def triggers_union(spark, d):
    handlers = read(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).select(F.lit("handler").alias("kind"), F.col("event_type").alias("name"), F.col("event_id").alias("id"))
    subscriptions = lookup.contains_any(read(spark, d, "pages"), ["url"], ["blog."]).select(F.lit("subscription").alias("kind"), F.col("url").alias("name"), F.col("page_id").alias("id"))
    movements = read(spark, d, "customer").where("c_nationkey = 3").select(F.lit("movement").alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return handlers.unionByName(subscriptions).unionByName(movements)


@query("""SELECT c_custkey, count(o_orderkey) > 0 AS holds, min(o_orderkey) AS evidence FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def verify_edge(spark, d):
    evidence = read(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.resolve_least(read(spark, d, "customer"), evidence, ["c_custkey"], "o_orderkey", "evidence").select("c_custkey", F.col("evidence").isNotNull().alias("holds"), "evidence")


@query("""SELECT CASE WHEN count(*) FILTER (WHERE lower(p_name) = 'red gear') > 0 THEN 'attribute' WHEN count(*) FILTER (WHERE lower(p_type) = 'economy') > 0 THEN 'tab_part' ELSE 'absent' END AS found_in,
array_to_string(list_sort(list(DISTINCT p_type))[1:30], ',') AS available FROM part""")
def verify_field(spark, d):
    hit = lambda c, v: F.count_if(lookup.folded(c) == v) > 0
    where = F.when(hit("p_name", "red gear"), "attribute").when(hit("p_type", "economy"), "tab_part").otherwise("absent")
    return read(spark, d, "part").agg(where.alias("found_in"), F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 30), ",").alias("available"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, line::INTEGER AS line, trim(content) AS content, array_to_string(lines[greatest(1, line - 2):line + 2], chr(10)) AS context FROM l WHERE contains(lower(content), 'the of')""")
def grep_lines(spark, d):
    return grep_ops.grep(read(spark, d, "documents"), ["doc_id"], "text", "The of")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS opened_at FROM conversations""")
def grep_running_function(spark, d):
    rows = grep_ops.running(read(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "opened_at")
    return rows.select("conv_id", "turn", "role", "opened_at")


@query(f"SELECT doc_id FROM documents WHERE contains({_PADDED.format('text')}, ' licens')")
def token_prefix_search(spark, d):
    return grep_ops.token_prefix(read(spark, d, "documents"), "text", "Licens").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({_PADDED.format('text')}, ' apache license ')")
def phrase_search(spark, d):
    return grep_ops.phrase(read(spark, d, "documents"), "text", "Apache License").select("doc_id")


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '@([A-Za-z0-9]+\.[A-Za-z0-9.]+)', 1)) AS ref FROM documents")
def query_ref_mining(spark, d):
    return grep_ops.mined(read(spark, d, "documents"), ["doc_id"], "text", r"@([A-Za-z0-9]+\.[A-Za-z0-9.]+)", 1, "ref")


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '^[^?#]*') AS path_key,
CASE WHEN regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'blog.%' THEN 'blog' WHEN regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'm.%' THEN 'mobile' ELSE 'site' END AS kind FROM pages""")
def url_path_key(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    key = F.regexp_extract(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), "^[^?#]*", 0)
    kind = F.when(host.startswith("blog."), "blog").when(host.startswith("m."), "mobile").otherwise("site")
    return read(spark, d, "pages").select("page_id", host.alias("host"), key.alias("path_key"), kind.alias("kind"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), 'untitled') AS title FROM pages")
def html_title(spark, d):
    inside = lambda tag: F.nullif(F.trim(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return read(spark, d, "pages").select("page_id", F.coalesce(inside("title"), inside("h1"), F.lit("untitled")).alias("title"))


@query()
def html_to_markdown(spark, d):
    """Needs a tree of elements, so it has no SQL."""
    return help_rows(read(spark, d, "pages").select(F.col("url").alias("path"), "html", "page_id"), "html", ["page_id"]).select("page_id", "title", "content")


_L2 = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2))"


@query(f"SELECT e.vec_id, round({_L2}, 9) AS distance, round(1 - least({_L2}, 1.0), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_L2}, vec_id LIMIT 10")
def knn_l2(spark, d):
    rows = read(spark, d, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("query"))
    return vectors.nearest(rows, "embedding", one, "vec_id", 10).select("vec_id", F.round("distance", 9).alias("distance"), F.round("score", 9).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({_L2}, 9) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label = 3 ORDER BY {_L2}, vec_id LIMIT 10")
def knn_filtered(spark, d):
    rows = read(spark, d, "embeddings")
    one = rows.where("vec_id = 1").select(F.col("embedding").alias("query"))
    return vectors.nearest(rows, "embedding", one, "vec_id", 10, F.col("label") == 3).select("vec_id", "label", F.round("distance", 9).alias("distance"))


@query(f"""SELECT e.vec_id, round({_L2}, 9) AS distance FROM embeddings e JOIN documents ON vec_id = doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 2) q
WHERE contains(text, 'License') ORDER BY {_L2}, vec_id LIMIT 10""")
def fulltext_then_vector(spark, d):
    rows = read(spark, d, "embeddings").join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    one = read(spark, d, "embeddings").where("vec_id = 2").select(F.col("embedding").alias("query"))
    return vectors.hybrid(rows, "embedding", "text", "License", one, "vec_id", 10).select("vec_id", F.round("distance", 9).alias("distance"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents QUALIFY place < 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - length(replace(text, ' ', '')) DESC, doc_id) - 1 AS place FROM documents QUALIFY place < 100)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score, min(l)::INTEGER AS first_list FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY doc_id""")
def rrf_fusion(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("blanks"))
    lists = [ranking.ranked(rows, "doc_id", [F.desc(c), F.asc("doc_id")], 100) for c in ("n_chars", "blanks")]
    return ranking.fuse(lists, "doc_id", "place").select("doc_id", F.round("score", 12).alias("score"), "first_list")


@query("""(SELECT 'documents' AS collection, doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL (SELECT 'pages', page_id FROM pages ORDER BY length(html) DESC, page_id LIMIT 10)
UNION ALL (SELECT 'parts', p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)""")
def search_all(spark, d):
    top = lambda t, name, key, by: read(spark, d, t).orderBy(F.desc(by) if isinstance(by, str) else by.desc(), F.asc(key)).limit(10).select(F.lit(name).alias("collection"), F.col(key).alias("id"))
    return top("documents", "documents", "doc_id", "n_chars").unionByName(top("pages", "pages", "page_id", F.length("html"))).unionByName(top("part", "parts", "p_partkey", "p_retailprice"))


@query("""WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id + 100000000, 'gone' FROM documents WHERE doc_id % 11 = 0),
new AS (SELECT doc_id, sha256(text) AS hash FROM documents)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'new' WHEN new.doc_id IS NULL THEN 'deleted' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM old FULL OUTER JOIN new ON old.doc_id = new.doc_id""")
def snapshot_diff(spark, d):
    docs = read(spark, d, "documents")
    sha = lambda c: F.sha2(c, 256)
    old = docs.where("doc_id % 10 <> 0").select("doc_id", sha(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    old = old.unionByName(docs.where("doc_id % 11 = 0").select((F.col("doc_id") + 100_000_000).alias("doc_id"), F.lit("gone").alias("hash")))
    return incremental.snapshot_diff(old, docs.select("doc_id", sha(F.col("text")).alias("hash")), "doc_id", "hash")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN 'call_unresolved' ELSE 'call_local' END AS edge_type FROM lineitem""")
def purge_demote(spark, d):
    edges = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("call_local").alias("edge_type"))
    return graph.demote(edges, read(spark, d, "supplier").where("s_suppkey % 9 = 0"), "l_suppkey", "s_suppkey")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark, d):
    return ranking.last_write_wins(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def insert_first_wins(spark, d):
    return ranking.first_write_wins(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id::VARCHAR AS path, (user_id % 5)::INTEGER AS retry_count FROM events WHERE event_type = 'error' AND user_id % 5 < 3")
def retry_queue(spark, d):
    ledger = read(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), F.lit("code").alias("collection"), F.when(F.col("event_type") == "error", "failed").otherwise("indexed").alias("status"), (F.col("user_id") % 5).cast("int").alias("retry_count"), F.col("ts").alias("indexed_at"))
    return incremental.retry_queue(ledger, "code", 3).select("path", "retry_count")


@query("SELECT doc_id, 'fn_' || substr(sha256(source || '::' || lang || '::' || doc_id), 1, 32) AS id FROM documents")
def stable_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", ids.vector_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


@query()
def chunk_documents(spark, d):
    """Recursive splitting has no SQL; tests hold it against its own rules."""
    return chunks(read(spark, d, "documents"), "doc_id", "text")


@query("""SELECT c_custkey, c_name || ' — ' || c_mktsegment || ' NATION "' || n_name || '"' || coalesce('. Parts: ' || parts, '') AS card FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, string_agg(p_name || '#' || p_partkey, ', ' ORDER BY p_partkey) AS parts FROM (SELECT o_custkey, p_partkey, p_name, row_number() OVER (PARTITION BY o_custkey ORDER BY p_partkey) AS r
  FROM (SELECT DISTINCT o_custkey, p_partkey, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)) WHERE r <= 8 GROUP BY o_custkey) ON c_custkey = o_custkey""")
def cards_text(spark, d):
    bought = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_partkey", "p_name").distinct()
    parts = nested.ordered(bought, ["o_custkey"], ["p_partkey"], F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")), "parts", 8)
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(parts, F.col("c_custkey") == F.col("o_custkey"), "left")
    tail = F.coalesce(F.concat(F.lit(". Parts: "), F.array_join("parts", ", ")), F.lit(""))
    return rows.select("c_custkey", F.concat("c_name", F.lit(" — "), "c_mktsegment", F.lit(' NATION "'), "n_name", F.lit('"'), tail).alias("card"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k')::INTEGER % 2 = 0) AS is_even FROM events")
def props_map(spark, d):
    bag = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", bag["k"].alias("k"), (bag["k"].cast("int") % 2 == 0).alias("is_even"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'utf-8' ELSE 'utf-16' END AS encoding, sha256(text) AS sha FROM documents")
def text_decode(spark, d):
    """Texts written in three encodings come back the same."""
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, marked).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16")).alias("content"))
    read_back = decoded(F.col("content"))
    return rows.select("doc_id", read_back.alias("r")).select("doc_id", F.col("r.encoding").alias("encoding"), F.sha2(F.col("r.text"), 256).alias("sha"))


@query("SELECT doc_id, text.sha AS body_hash FROM (SELECT doc_id, {'sha': sha256(text)} AS text FROM documents) WHERE doc_id % 4 <> 0")
def changed_bodies(spark, d):
    bodies = read(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("function_name"), F.col("text").alias("body"), "doc_id")
    ledger = bodies.where("doc_id % 4 = 0").select("path", "function_name", F.sha2("body", 256).alias("hash"))
    return incremental.changed_bodies(bodies, ledger).select("doc_id", F.col("hash").alias("body_hash"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200) AS head, CASE WHEN length(text) > 800 THEN left(text, 800) || '...' ELSE text END AS preview FROM documents")
def text_previews(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.collapsed(F.col("text")).alias("head"), tx.shortened(F.col("text"), 800, "...").alias("preview"))


@query(r"""SELECT page_id, CASE WHEN contains(p, '/src/') THEN regexp_extract(p, '^.*/src/(.*)$', 1) ELSE p END AS module_key, 'Documents' AS folder_kind FROM (SELECT page_id, '/data/src/Documents/' || page_id || '/src/Ext/' || page_id || '.bsl' AS p FROM pages)""")
def module_keys(spark, d):
    path = F.concat(F.lit("/data/src/Documents/"), F.col("page_id").cast("string"), F.lit("/src/Ext/"), F.col("page_id").cast("string"), F.lit(".bsl"))
    return read(spark, d, "pages").select("page_id", paths.module_key(path).alias("module_key"), paths.kind(path, {"Catalogs": "Catalogs", "Documents": "Documents"}).alias("folder_kind"))
