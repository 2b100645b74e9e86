"""The named queries of the index: each gives a DataFrame. Lookups of one thing write its row first; greps by an index ask how much it finds."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import shortened
from ..operators import joins, lookup, nested, ranking, text, vectors
from ..operators.embedding import Provider, embedded, query_vector
from ..operators.postings import Postings
from . import vocabulary as words
from .build import Index, named
from .shared import keep


class Catalog:
    """Queries over one snapshot. `fold` is by case in any alphabet throughout.

    With an index of the words of bodies (`build.index_words`), greps read the postings of their words and the texts these
    name; with one of the trigrams of attribute types (`build.index_types`), references are looked up there. Rows are the same without.
    """

    def __init__(self, index: Index, words: Postings | None = None, types: Postings | None = None):
        self.i, self.words, self.types = index, words, types
        self.placed = index.symbols.join(index.files.select("file_id", F.col("path").alias("module_path"), "module_type", "object_name"), "file_id")

    # lookups

    def search_function(self, name: str, exact: bool = True) -> DataFrame:
        """Exact names, else names by words, else by substring; without `exact` all that fits by words or substring."""
        rows = lookup.find_tiered(self.placed, "name", name) if exact else self.placed.where(lookup.has_words(["name"], name) | lookup.has_substring("name", name))
        return rows.select("name", "type", "params", "is_export", "line_start", "line_end", "module_path", "module_type", "symbol_id").orderBy("symbol_id")

    def get_module_functions(self, path: str) -> DataFrame:
        """Of the module with this path, else of all whose path contains it."""
        tagged = self.placed.withColumn("tier", F.when(F.col("module_path") == path, 0).when(lookup.has_substring("module_path", path), 1)).where("tier is not null")
        rows = tagged.join(F.broadcast(tagged.agg(F.min("tier").alias("best"))), F.col("tier") == F.col("best"))
        return rows.select("name", "type", "params", "is_export", "line_start", "line_end", "module_type", "module_path").orderBy("module_path", "line_start")

    def metadatasearch(self, query: str, limit: int = 10, retrieval: Retrieval | None = None) -> DataFrame:
        """By names; an index without any object or definition answers from the chunks of `retrieval`, with another row: full_path, object_type, name, content, score, source."""
        if retrieval is not None and self.i.objects.isEmpty() and self.i.symbols.isEmpty():
            return retrieval.search_metadata(query, limit).withColumn("source", F.lit("semantic"))
        return lookup.search_metadata(self.i.objects, query, limit).select("full_name", "object_type", "name", "synonym", F.lit("structural").alias("source"))

    def get_object_details(self, full_name: str) -> DataFrame:
        """The object of this full name, else the first whose name is its last part; with attributes, tabular sections and registers."""
        last = full_name.rpartition(".")[2]
        tier = F.when(F.col("full_name") == full_name, 0).when(lookup.folded("name") == last.lower(), 1)
        one = self.i.objects.withColumn("tier", tier).where("tier is not null").orderBy("tier", "object_id").limit(1)
        one = _one(one)
        of = lambda rows, key, owner, at: rows.join(F.broadcast(owner.select(F.col(at).alias(key))), key, "left_semi")
        attributes = of(self.i.attributes, "object_id", one, "object_id").groupBy("object_id").agg(_by("pos", F.struct(F.col("name"), F.col("type_ref").alias("type"), F.col("is_required").alias("required")), "attributes"))
        sections = of(self.i.tab_parts, "object_id", one, "object_id")
        inner = self.i.tab_part_attributes.join(sections.select("tab_part_id"), "tab_part_id", "left_semi").groupBy("tab_part_id").agg(_by("pos", F.struct(F.col("name"), F.col("type_ref").alias("type")), "inner"))
        parts = sections.join(inner, "tab_part_id", "left").groupBy("object_id").agg(_by("pos", F.struct(F.col("name"), F.col("inner").alias("attributes")), "tab_parts"))
        moves = of(self.i.register_movements, "document_id", one, "object_id").groupBy(F.col("document_id").alias("object_id")).agg(F.array_sort(F.collect_set("register_name")).alias("registers"))
        return one.join(attributes, "object_id", "left").join(parts, "object_id", "left").join(moves, "object_id", "left").select("name", "object_type", "synonym", "full_name", "attributes", "tab_parts", "registers")

    def find_references_to(self, full_name: str) -> DataFrame:
        """Attributes whose type names the object; those of tabular sections under `object.section`."""
        name = full_name.rpartition(".")[2]
        flat = self.i.attributes.join(self.i.objects, "object_id").select(F.col("full_name").alias("referencing_object"), self.i.attributes["name"].alias("attribute_name"), F.col("type_ref").alias("attribute_type"))
        inner = self.i.tab_part_attributes.withColumnRenamed("name", "attribute_name").join(self.i.tab_parts.select("tab_part_id", "object_id", F.col("name").alias("part")), "tab_part_id").join(self.i.objects.select("object_id", "full_name"), "object_id")
        inner = inner.select(F.concat_ws(".", "full_name", "part").alias("referencing_object"), "attribute_name", F.col("type_ref").alias("attribute_type"))
        rows = flat.unionByName(inner)
        if self.types is not None:
            named = self.types.containing(name).select(F.col("text").alias("attribute_type"))
            rows = rows.join(F.broadcast(named) if named.limit(100_001).count() <= 100_000 else named, "attribute_type", "left_semi")
        else:
            rows = rows.where(lookup.has_substring("attribute_type", name))
        return rows.distinct().orderBy("referencing_object", "attribute_name")

    # the graph

    def _picked(self, name: str, hint: str | None = None) -> DataFrame:
        """The one symbol a name means: where the hint fits first, then exports, then rank."""
        fits = (lookup.has_substring("module_path", hint) | (lookup.folded("object_name") == hint.lower())) if hint else F.lit(False)
        rows = self.placed.where(named(self.placed, "symbols", name)).withColumn("object_matched", F.coalesce(fits, F.lit(False)))
        return _one(rows.orderBy(F.desc("object_matched"), F.desc("is_export"), F.desc("centrality"), "symbol_id").limit(1))

    def _callers(self, picked: DataFrame) -> DataFrame:
        """Symbols that call the picked one: by resolved edge, or by name where the edge has no end."""
        target = picked.select(F.col("symbol_id").alias("target_id"), lookup.folded("name").alias("target_name"))
        edges = self.i.edges.select("src_symbol_id", "dst_symbol_id", "callee_name")
        by_name = F.col("dst_symbol_id").isNull() & (lookup.folded("callee_name") == F.col("target_name"))
        met = [edges.join(F.broadcast(target), c) for c in (F.col("dst_symbol_id") == F.col("target_id"), by_name)]
        sources = met[0].unionByName(met[1]).select("target_id", F.col("src_symbol_id").alias("symbol_id")).distinct()
        return sources.join(self.placed, "symbol_id").select("target_id", "name", F.coalesce("object_name", "module_type").alias("module"), "line_start")

    def get_function_context(self, name: str, object_name: str | None = None) -> DataFrame:
        one = self._picked(name, object_name)
        calls = self._of(self.i.edges, one).groupBy("src_symbol_id").agg(F.array_sort(F.collect_set("callee_name")).alias("calls")).withColumnRenamed("src_symbol_id", "symbol_id")
        callers = self._callers(one).groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("module", "name", "line_start"))).alias("called_by")).withColumnRenamed("target_id", "symbol_id")
        return one.join(F.broadcast(self._same_name(name))).join(calls, "symbol_id", "left").join(callers, "symbol_id", "left").select("name", "type", "params", "is_export", "module_path", "module_type", "line_start", "calls", "called_by", F.size(F.coalesce("called_by", F.array())).alias("called_by_count"), "ambiguous_definitions")

    @staticmethod
    def _of(rows: DataFrame, one: DataFrame) -> DataFrame:
        """Rows of the picked symbol, or of one module's, alone, before anything is grouped: these few ids are broadcast."""
        return rows.join(F.broadcast(one.select(F.col("symbol_id").alias("src_symbol_id"))), "src_symbol_id", "left_semi")

    def _same_name(self, name: str) -> DataFrame:
        return self.placed.where(named(self.placed, "symbols", name)).agg(F.count("*").alias("ambiguous_definitions"))

    def read_function(self, name: str, budget_chars: int = 6000, object_name: str | None = None, include_body: bool = True) -> DataFrame:
        """The context of a function in one row: body, callees, callers, objects it touches, registers of its owner."""
        one = self._picked(name, object_name)
        edges = self._of(self.i.edges, one).groupBy("src_symbol_id", "qualifier", "callee_name").agg(F.max("resolved").alias("resolved"), F.min("edge_type").alias("edge_type"), F.min("pos").alias("pos"))
        callees = edges.groupBy(F.col("src_symbol_id").alias("symbol_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("resolved")).alias("open"), "pos", "callee_name", "qualifier", "edge_type", "resolved"))), lambda x: F.struct(x["callee_name"].alias("name"), x["qualifier"].alias("qualifier"), x["edge_type"].alias("edge_type"), x["resolved"].alias("resolved"))).alias("callees"))
        callers = self._callers(one).groupBy(F.col("target_id").alias("symbol_id")).agg(F.array_sort(F.collect_list(F.struct("name", "module", "line_start"))).alias("callers"))
        touched = nested.distinct_ordered(self._of(self.i.query_refs, one), ["src_symbol_id"], "pos", "object_full_name", "touched_objects").withColumnRenamed("src_symbol_id", "symbol_id")
        owner = self.i.objects.select(F.col("object_id").alias("document_id"), F.col("name").alias("object_name")).join(F.broadcast(one.select("object_name")), "object_name", "left_semi")
        moves = self.i.register_movements.join(owner, "document_id").groupBy("object_name").agg(F.array_sort(F.collect_set("register_name")).alias("registers"))
        row = one.join(F.broadcast(self._same_name(name))).join(callees, "symbol_id", "left").join(callers, "symbol_id", "left").join(touched, "symbol_id", "left").join(moves, "object_name", "left")
        columns = ["name", "type", "params", "is_export", "module_path", "module_type", F.col("object_name").alias("owner"), "line_start", "line_end", "callees", "callers", "touched_objects", "registers", "ambiguous_definitions", F.lit(object_name).alias("requested_object"), "object_matched"]
        if include_body:
            body = self.i.bodies.join(F.broadcast(one.select("symbol_id")), "symbol_id", "left_semi").select("symbol_id", shortened(F.col("body"), budget_chars, "\n... [truncated]").alias("body"))
            row, columns = row.join(body, "symbol_id", "left"), [*columns, "body"]
        return row.select(*columns)

    def repomap(self, scope: str | None = None, token_budget: int = 4000, limit: int = 60) -> DataFrame:
        rows = self.placed if scope is None else self.placed.where((lookup.folded("object_name") == scope.lower()) | lookup.has_substring("module_path", scope))
        rows = rows.withColumn("signature", signature())
        order = [F.desc("centrality"), F.desc("is_export"), F.asc("symbol_id")]
        kept = ranking.within_budget(rows, order, limit, F.length("signature") + F.length("module_path"), token_budget * 4)
        return kept.select("signature", F.col("module_path").alias("module"), "module_type", F.col("object_name").alias("owner"), "line_start", F.round("centrality", 6).alias("centrality"))

    def triggers_on_write(self, full_name: str, event: str | None = None) -> DataFrame:
        """What runs when an object is written: kind is handler, subscription or movement."""
        name = full_name.rpartition(".")[2]
        names = [h for h, e in words.WRITE_HANDLERS.items() if event is None or event.lower() in (h.lower(), e.lower())]
        own = self.placed.where((F.col("module_type") == "ObjectModule") & (lookup.folded("object_name") == name.lower()) & F.lower("name").isin([n.lower() for n in names]))
        handlers = own.select(F.lit("handler").alias("kind"), "name", F.col("module_path").alias("module"), "line_start")
        subscribed = self.i.subscriptions.where(lookup.has_substring("source", name))
        if event is not None:
            subscribed = subscribed.where(lookup.folded("event") == event.lower())
        handler = F.concat_ws(".", "handler_module", "handler_method").alias("handler")
        subscriptions = subscribed.select(F.lit("subscription").alias("kind"), "name", "source", "event", handler, F.col("handler_symbol_id").isNotNull().alias("resolved"))
        document = self.i.objects.where((F.col("full_name") == full_name) | (lookup.folded("name") == name.lower())).select(F.col("object_id").alias("document_id"))
        moves = self.i.register_movements.join(document, "document_id", "left_semi").select(F.lit("movement").alias("kind"), F.col("register_name").alias("name")).distinct()
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (handlers, subscriptions, moves)).orderBy("kind", "line_start", "name")

    def verify_call(self, caller: str, callee: str) -> DataFrame:
        """One row: whether an edge of these names exists, and the best evidence."""
        source = self.placed.where(named(self.placed, "symbols", caller)).select(F.col("symbol_id").alias("src_symbol_id"))
        found = self.i.edges.where(named(self.i.edges, "edges", callee)).join(source, "src_symbol_id", "left_semi")
        best = found.agg(F.min(F.struct((~F.col("resolved")).alias("open"), "edge_id", "edge_type", "resolved", "qualifier")).alias("e"))
        return best.select(F.col("e").isNotNull().alias("holds"), "e.edge_type", "e.resolved", "e.qualifier", F.when(F.col("e").isNull(), "no such call").alias("reason"))

    def verify_field(self, full_name: str, field: str) -> DataFrame:
        """One row: whether an object has a field, where, and else which it has (30 at most)."""
        one = self.get_object_details(full_name)
        own = lambda xs: F.exists(F.coalesce(xs, F.array()), lambda x: F.lower(x["name"]) == field.lower())
        part = F.get(F.filter(F.coalesce("tab_parts", F.array()), lambda t: own(t["attributes"])), F.lit(0))["name"]
        where = F.when(own(F.col("attributes")), "attribute").when(part.isNotNull(), F.concat(F.lit("tab_part:"), part))
        available = F.slice(F.transform(F.coalesce("attributes", F.array()), lambda a: a["name"]), 1, 30)
        return one.select(where.isNotNull().alias("holds"), where.alias("where"), F.when(where.isNull(), available).alias("available"))

    # cards

    def cards(self, path: str | None = None) -> DataFrame:
        """symbol, signature, module_type, owner, synonym, calls, touches, doc, summary of every symbol (of one module): one plan for all."""
        if path is None:
            return self._cards(self.placed, self.i.edges, self.i.query_refs)
        rows = self.placed.where(F.col("module_path") == path)
        return self._cards(rows, self._of(self.i.edges, rows), self._of(self.i.query_refs, rows))

    def _cards(self, rows: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
        calls = nested.distinct_ordered(edges.where("resolved"), ["src_symbol_id"], "pos", "callee_name", "calls", 15)
        touches = nested.distinct_ordered(refs, ["src_symbol_id"], "pos", "object_full_name", "touches", 15)
        synonyms = self.i.objects.groupBy(F.col("name").alias("object_name")).agg(F.min_by("synonym", "object_id").alias("synonym"))
        rows = rows.join(calls.withColumnRenamed("src_symbol_id", "symbol_id"), "symbol_id", "left").join(touches.withColumnRenamed("src_symbol_id", "symbol_id"), "symbol_id", "left").join(synonyms, "object_name", "left")
        empty = F.array().cast("array<string>")
        rows = rows.withColumns({"calls": F.coalesce("calls", empty), "touches": F.coalesce("touches", empty), "signature": signature()})
        return rows.select(F.col("name").alias("symbol"), "signature", "module_type", F.col("object_name").alias("owner"), "synonym", "calls", "touches", "doc", card_text().alias("summary"), "module_path", "symbol_id", "is_export", "line_start")

    def card(self, name: str) -> DataFrame:
        one = self._picked(name)
        return self._cards(self.placed.join(F.broadcast(one.select("symbol_id")), "symbol_id", "left_semi"), self._of(self.i.edges, one), self._of(self.i.query_refs, one)).drop("module_path", "symbol_id", "is_export", "line_start")

    # text

    def code_grep(self, pattern: str, case_sensitive: bool = False, limit: int = 100) -> DataFrame:
        """Lines of definitions that hold the pattern, where the definition has its words: sorted, then cut, with a row that says so where more were found."""
        if self.words is not None:
            bodies = self.words.words(pattern).select("path", "function_name", F.col("line_start").alias("first"), F.col("text").alias("body"))
        else:
            bodies = self.i.bodies.withColumnRenamed("line_start", "first")
            grams = re.findall(r"\w+", pattern)
            bodies = text.token_prefix(bodies, "body", grams[0]) if len(grams) == 1 and "_" not in grams[0] else text.phrase(bodies, "body", pattern) if grams else bodies
        rows = text.grep(bodies, ["path", "function_name", "first"], "body", pattern, case_sensitive)
        types = self.i.files.select("path", "module_type")
        rows = rows.join(types, "path").select(F.col("path").alias("file"), (F.col("first") + F.col("line") - 1).alias("line"), F.col("content").alias("text"), F.col("function_name").alias("function"), "module_type", "context")
        return truncated(rows, limit)

    def stats(self) -> DataFrame:
        """One row of counts: tables, edges and their kinds."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        counts = [one(getattr(self.i, n), n) for n in ("files", "symbols", "objects", "attributes")]
        edges = self.i.edges.agg(F.count("*").alias("edges_total"), F.count_if("resolved").alias("edges_resolved"))
        kinds = self.i.edges.groupBy("edge_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "count")))).alias("edges_by_type"))
        return reduce(lambda a, b: a.join(F.broadcast(b)), [*counts, edges, kinds])


def _one(row: DataFrame) -> DataFrame:
    """The one row, written: it is joined to several tables, and each join would look it up again."""
    return keep(row, "picked")


def _by(order: str, value: Column, name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name)


def signature() -> Column:
    return F.concat(F.col("type"), F.lit(" "), F.col("name"), F.lit("("), F.array_join("params", ", "), F.lit(")"), F.when(F.col("is_export"), f" {words.EXPORT}").otherwise(""))


def card_text() -> Column:
    """Doc comment, or what a handler of this name is for; then signature, place, callees and objects."""
    kind = paths.kind(F.col("module_path"), words.CARD_KINDS)
    synonym, owner = F.coalesce("synonym", F.lit("")), F.coalesce("object_name", F.lit(""))
    phrase = F.when((synonym != "") & (kind != ""), F.concat(kind, F.lit(' "'), synonym, F.lit('"'))).when(synonym != "", F.concat(F.lit('"'), synonym, F.lit('"'))).when((owner != "") & (kind != ""), F.concat_ws(" ", kind, owner)).otherwise(owner)
    some = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f". {label}: "), F.array_join(F.slice(c, 1, 8), ", "))).otherwise("")
    base = F.concat(signature(), F.lit(" — "), F.col("module_type"), F.when(phrase != "", F.concat(F.lit(" "), phrase)).otherwise(""), some("calls", words.CALLS), some("touches", words.TOUCHES))
    intents = F.create_map(*(F.lit(x) for pair in words.INTENTS.items() for x in pair))
    lead = F.coalesce(F.nullif("doc", F.lit("")), F.try_element_at(intents, F.lower("name")))
    return F.when(lead.isNotNull(), F.concat(lead, F.lit(". "), base)).otherwise(base)


def truncated(rows: DataFrame, limit: int, order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The first rows in order, and one that says `truncated` if there are more. limit + 1 rows at most leave any task."""
    top = rows.orderBy(*order).limit(limit + 1)
    placed = top.withColumn("place", F.expr(f"row_number() over (order by {', '.join(order)})"))
    cut = F.col("place") > limit
    return placed.select(*[F.when(~cut, F.col(c)).alias(c) for c in rows.columns], cut.alias("truncated"))


def scan_grep(texts: DataFrame, functions: DataFrame, pattern: str, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
    """Lines of whole files with the definition each stands in, the one that starts last. texts: path, text (such as an index of
    trigrams finds by `containing`); functions: path, name, line_start, line_end."""
    rows = text.grep(texts, ["path"], "text", pattern, case_sensitive)
    met = joins.within(rows.select("path", "line").distinct(), "line", functions.select("path", "name", "line_start", "line_end"), "line_start", "line_end", 32, ["path"])
    inner = rows.join(met.groupBy("path", "line").agg(F.max_by("name", F.struct("line_start", "name")).alias("function")), ["path", "line"], "left")
    out = inner.select(F.col("path").alias("file"), "line", F.col("content").alias("text"), F.coalesce("function", F.lit("module level")).alias("function"), paths.module_type(F.col("path")).alias("module_type"), "context")
    return truncated(out, limit)


def prepared(query: str, plurals: dict[str, str] | None = None) -> str:
    """A query with whole singular terms in the plural, as objects are filed."""
    for one, many in (plurals or words.QUERY_PLURALS).items():
        query = re.sub(rf"\b{one}(?!\w)", many, query)
    return query


class Retrieval:
    """Semantic search over chunks: id, collection, content, embedding and what else a chunk carries."""

    def __init__(self, chunks: DataFrame, provider: Provider, scorer: Callable[[str, list[str]], list[float]] | None = None):
        self.chunks, self.provider, self.scorer = chunks, provider, scorer

    def search(self, collection: str, query: str, limit: int = 10, where: Column | None = None, rerank: bool = True) -> DataFrame:
        """content, metadata, score by distance; a one-word query must stand in the content. With a scorer twice as many are fetched and ordered anew."""
        wanted = prepared(query)
        fetch = max(2 * limit, 20) if self.scorer and rerank else limit
        rows = self.chunks.where(F.col("collection") == collection)
        found = vectors.hybrid(rows, "embedding", "content", wanted, query_vector(self.provider, wanted), "id", fetch, where)
        return reranked(found, query, self.scorer, limit) if self.scorer and rerank else found

    def codesearch(self, query: str, limit: int = 10) -> DataFrame:
        return self._code(self.search("code", query, limit)).select("full_path", "name", "module_type", "is_export", "functions", "content", "score")

    def search_code_filtered(self, query: str, module_type: str | None = None, only_export: bool = False, limit: int = 10) -> DataFrame:
        tests = [F.col("module_type") == module_type] * (module_type is not None) + [F.col("is_export")] * only_export
        where = reduce(lambda a, b: a & b, tests) if tests else None
        return self._code(self.search("code", query, limit, where)).select("full_path", "name", "module_type", "is_export", "content", "score")

    def helpsearch(self, query: str, limit: int = 10) -> DataFrame:
        return self._code(self.search("help", query, limit)).select("full_path", F.col("name").alias("title"), "content", "score")

    def search_metadata(self, query: str, limit: int = 10) -> DataFrame:
        return self._code(self.search("metadata", query, limit, rerank=False), 500).select("full_path", "object_type", "name", "content", "score")

    def search_all(self, query: str, limit: int = 10) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.search(c, query, limit).select(F.lit(c).alias("collection"), "id", "name", "content", "score") for c in ("metadata", "code", "help")))

    @staticmethod
    def _code(rows: DataFrame, most: int = 800) -> DataFrame:
        return rows.withColumns({"content": shortened(F.col("content"), most, "..."), "score": F.round("score", 3)})

    def counts(self) -> DataFrame:
        return self.chunks.groupBy("collection").count()


def reranked(rows: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], limit: int) -> DataFrame:
    """The rows by a scorer of (query, contents); where it fails or gives no number, in the order they had."""
    @F.pandas_udf("double")
    def rate(contents: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(scorer(query, contents.tolist())), index=contents.index, dtype=float)
        except Exception:  # any failure of an outside scorer keeps the order
            return pd.Series([None] * len(contents), index=contents.index, dtype=float)

    return rows.coalesce(1).withColumn("_rate", rate("content")).orderBy(F.desc_nulls_last("_rate"), "distance", "id").limit(limit).drop("_rate")


def chunk_table(spark: SparkSession, parts: dict[str, DataFrame], provider: Provider) -> DataFrame:
    """One table of all collections with embeddings; chunks that can't be embedded are left out."""
    tagged = [df.withColumn("collection", F.lit(name)) for name, df in parts.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return embedded(every, "content", provider).where("embedding is not null")
