"""Definitions in module texts, their calls and references: arrays of lines in the JVM, no Python.

A text is split once; places of openings and endings are arrays of line numbers, and each opening
takes the first ending after it (the end of the text, if there is none). Parameters stand on one
line, up to the first closing bracket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..functions.text import params_of
from ..plans.vocabulary import Vocabulary


def _any(words) -> str:
    return "|".join(words)


def functions(texts: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """path, module_key, name, type, params, is_export, line_start, line_end, body, doc, calls, query_refs of each definition.

    texts: path, module_key, text. Lines count from 1; line_start is that of the opening itself.
    """
    v = v or Vocabulary()
    opening = rf"(?iU)^\s*({_any(v.starts)})\s+(\w+)\s*\((.*?)\)"
    ending = rf"(?iU)^\s*({_any(v.ends)})\s*$"
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.when(F.contains(x, F.lit("\r")), F.regexp_replace(x, "\\r$", "")).otherwise(x))
    rows = texts.where(F.rlike("text", F.lit(rf"(?iU)({_any(v.starts)})\s+\w+\s*\("))).select("path", "module_key", lines.alias("lines"))
    places = lambda pattern: F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(pattern)), i + 1)), lambda i: i.isNotNull())
    marked = rows.withColumn("opens", places(opening)).withColumn("closes", places(ending))
    each = marked.select("path", "module_key", "lines", "closes", F.explode("opens").alias("line_start"))
    close = F.array_min(F.filter("closes", lambda c: c > F.col("line_start")))
    each = each.withColumn("line_end", F.coalesce(close, F.size("lines"))).withColumn("head", F.get("lines", F.col("line_start") - 1))
    each = each.withColumn("body", F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    part = lambda g: F.regexp_extract("head", opening, g)
    after = F.substr(F.array_join(F.slice("lines", F.col("line_start"), F.lit(5)), "\n"), F.length(F.regexp_extract("head", opening, 0)) + 1, F.lit(100))
    kinds = F.create_map(*(F.lit(x) for pair in v.starts.items() for x in pair))
    found = each.select("path", "module_key", part(2).alias("name"), kinds[F.lower(part(1))].alias("type"), params_of(part(3)).alias("params"), F.rlike(after, F.lit(rf"(?iU)\b({_any(v.exports)})\b")).alias("is_export"), "line_start", "line_end", "body", doc_comment(F.col("lines"), F.col("line_start"), v).alias("doc"))
    return found.withColumn("calls", calls(F.col("body"), F.col("name"), v)).withColumn("query_refs", query_refs(F.col("body"), v))


def calls(body: Column, name: Column, v: Vocabulary) -> Column:
    """Different (qualifier, name) before a bracket, in order: without keywords, unqualified calls of itself and of the platform's own functions."""
    pattern = r"(?U)(?:([\p{L}_]\w*)\s*\.\s*)?([\p{L}_]\w*)\s*\("
    found = lambda g: F.regexp_extract_all(body, F.lit(pattern), F.lit(g))
    pairs = F.transform(F.arrays_zip(found(1).alias("q"), found(2).alias("n")), lambda x: F.struct(F.nullif(x["q"], F.lit("")).alias("qualifier"), x["n"].alias("name")))
    own = [g.lower() for g in v.globals]
    kept = F.filter(pairs, lambda x: ~x["name"].isin(*v.keywords) & ~F.coalesce(x["qualifier"].isin(*v.keywords), F.lit(False)) & (x["qualifier"].isNotNull() | ((F.lower(x["name"]) != F.lower(name)) & ~F.lower(x["name"]).isin(*own))))
    return F.array_distinct(kept)


def query_refs(text: Column, v: Vocabulary) -> Column:
    """Different Type.Name after a word that opens a table list, the type spelled as the platform does."""
    pattern = rf"(?iU)(?:{_any(v.refs)})\s+(\p{{L}}+\.[\p{{L}}\p{{N}}_]+)"
    kinds = F.create_map(*(F.lit(x) for t in v.query_types for x in (t.lower(), t)))
    named = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda r: F.concat(F.try_element_at(kinds, F.lower(F.substring_index(r, ".", 1))), F.lit("."), F.substring_index(r, ".", -1)))
    return F.array_distinct(F.filter(named, lambda r: r.isNotNull()))


def doc_comment(lines: Column, line_start: Column, v: Vocabulary, most: int = 200) -> Column:
    """The first paragraph of the comment that ends right above a definition, up to a line that names a section."""
    is_code = lambda x: ~F.startswith(F.trim(F.translate(x, "\t", " ")), F.lit("//"))
    is_rule = lambda x: F.rlike(x, F.lit(r"^[/=\-* ]*$"))
    is_stop = lambda x: is_rule(x) | F.rlike(x, F.lit(f"^(?:{_any(v.doc_stops)})"))
    first = lambda xs, test: F.array_position(F.transform(xs, test), True).cast("int")
    block = lambda above: _once(first(above, is_code), lambda at: F.reverse(F.when(at > 0, F.slice(above, 1, at - 1)).otherwise(above)))
    text = lambda bare: _once(first(bare, lambda x: ~is_rule(x)), lambda at: F.when(at > 0, F.slice(bare, at, F.size(bare))).otherwise(F.slice(bare, 1, 0)))
    paragraph = lambda found: _once(first(found, is_stop), lambda at: F.when(at > 0, F.slice(found, 1, at - 1)).otherwise(found))
    bare = F.transform(_once(F.reverse(F.slice(lines, 1, line_start - 1)), block), lambda x: F.regexp_replace(x, r"^\s*/+\s*|\s+$", ""))
    return F.left(F.trim(F.regexp_replace(F.array_join(_once(_once(bare, text), paragraph), " "), "\\s+", " ")), F.lit(most))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value bound to a variable: inside higher-order functions Spark evaluates an expression again at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def file_records(texts: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """path, name (stem), content, function_names, export_functions, line_count: a row per file, definitions or not."""
    found = functions(texts, v)
    in_order = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("line_start", "name")))), lambda x: x["name"])
    names = found.groupBy("path").agg(in_order(F.lit(True)).alias("function_names"), in_order(F.col("is_export")).alias("export_functions"))
    stem = F.regexp_replace(F.element_at(paths.segments(F.col("path")), -1), "\\.[^.]*$", "")
    empty = F.array().cast("array<string>")
    rows = texts.where("text <> ''").select("path", stem.alias("name"), F.col("text").alias("content"), (F.regexp_count("text", F.lit("\n")) + 1).alias("line_count"))
    return rows.join(names, "path", "left").select("path", "name", "content", F.coalesce("function_names", empty).alias("function_names"), F.coalesce("export_functions", empty).alias("export_functions"), "line_count")


def tables(texts: DataFrame, v: Vocabulary | None = None) -> dict[str, DataFrame]:
    """files, symbols, edges, query_refs, bodies with ids made of natural keys. Of two definitions with one key the first stays."""
    v = v or Vocabulary()
    files = texts.select(ids.file_id("module_key").alias("file_id"), F.col("module_key").alias("path"), F.col("hash").alias("file_hash"), paths.module_type(F.col("module_key")).alias("module_type"), paths.owner(F.col("module_key"), list(v.owner_folders)).alias("object_name"), "mtime", "size")
    found = functions(texts, v).dropDuplicates(["module_key", "name", "line_start"])
    found = found.withColumn("symbol_id", ids.symbol_id("module_key", "name", "line_start")).withColumn("file_id", ids.file_id("module_key"))
    symbols = found.select("symbol_id", "file_id", "name", "type", "params", "is_export", "line_start", "line_end", "doc")
    edges = found.select("symbol_id", "file_id", F.posexplode("calls").alias("pos", "call"))
    edges = edges.select(F.xxhash64("symbol_id", "pos").alias("edge_id"), F.col("symbol_id").alias("src_symbol_id"), F.col("file_id").alias("src_file_id"), "pos", F.col("call.qualifier").alias("qualifier"), F.col("call.name").alias("callee_name"))
    refs = found.select(F.col("symbol_id").alias("src_symbol_id"), F.posexplode("query_refs").alias("pos", "object_full_name"))
    return {"files": files, "symbols": symbols, "edges": edges, "query_refs": refs, "bodies": found.select("symbol_id", "file_id", F.col("module_key").alias("path"), F.col("name").alias("function_name"), "line_start", "body")}
