"""Metadata, subscriptions, entry points, forms and report schemas from XML, whatever its namespaces.

The files are rows; each is parsed where it stands and gives a struct, or null if it isn't XML or
holds no such thing. Everything after that (flattening, ids, joins) is DataFrame work.
"""

from __future__ import annotations

import functools
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.text import handler_of
from ..plans import vocabulary as words
from ..plans.shared import keep
from .code import query_refs
from .files import in_roots

ATTRIBUTE = "struct<name:string,type_ref:string,is_required:boolean>"
OBJECT = f"struct<name:string,object_type:string,synonym:string,attributes:array<{ATTRIBUTE}>,tab_parts:array<struct<name:string,attributes:array<{ATTRIBUTE}>>>,registers:array<string>>"
NAMED = "struct<name:string,source:string,event:string,handler:string>"
FORM = "struct<name:string,attributes:array<string>,commands:array<string>,items:array<string>,handlers:array<struct<event:string,handler:string>>>"
#: Files whose objects a task holds in Python at a time.
AT_ONCE = 256
SCHEMA = "struct<datasets:array<struct<name:string,query:string,fields:array<string>>>,parameters:array<string>>"


@functools.lru_cache(maxsize=1 << 14)
def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def local(element: ET.Element) -> str:
    return bare(element.tag)


def named(element: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    return (c for c in (element if element is not None else ()) if bare(c.tag) in names)


def child(element: ET.Element | None, name: str) -> ET.Element | None:
    for c in element if element is not None else ():
        if bare(c.tag) == name:
            return c
    return None


def text(element: ET.Element | None, *names: str) -> str:
    """The text of a descendant by its path of names; empty if there is none."""
    for n in names:
        element = child(element, n)
    return (element.text or "").strip() if element is not None else ""


@functools.lru_cache(maxsize=1 << 14)
def type_name(written: str) -> str:
    own = written.strip().removeprefix("cfg:")
    prefix, dot, rest = own.partition(".")
    return words.PRIMITIVES.get(own) or (f"{words.TYPE_PREFIXES[prefix]}.{rest}" if dot and prefix in words.TYPE_PREFIXES else own)


def types(own: ET.Element | None) -> str:
    """All types of a Type element, by the first of three layouts that has any."""
    if own is None:
        return ""
    found = [type_name(e.text) for e in own if bare(e.tag) == "Type" and e.text and e.text.strip()]
    if not found:
        layouts = (named(child(own, "TypeSet"), "Type", "Reference"), (own,))
        found = next((x for x in ([type_name(e.text) for e in layout if e.text and e.text.strip()] for layout in layouts) if x), [])
    return ", ".join(found)


def members(element: ET.Element) -> dict[str, ET.Element]:
    """The first child of each name."""
    return {bare(c.tag): c for c in element[::-1]}


def attributes(element: ET.Element) -> list[dict]:
    """Each attribute's children are looked through once: a large tree has most of its elements here."""
    out = []
    for a in named(child(element, "ChildObjects"), "Attribute", "Dimension", "Resource"):
        at = members(a)
        if "Properties" in at:
            at = members(at["Properties"])
        name, required = (at[n].text if n in at else None for n in ("Name", "FillChecking"))
        if name := (name or "").strip():
            out.append({"name": name, "type_ref": types(at.get("Type")), "is_required": (required or "").strip() == "ErrorIfNotFilled"})
    return out


def metadata_object(root: ET.Element, path: str) -> dict | None:
    wrapped = local(root) == "MetaDataObject"
    own = next(named(root, *words.ELEMENT_TYPES), None) if wrapped else root if local(root) in words.ELEMENT_TYPES else None
    kind = words.ELEMENT_TYPES[local(own)] if own is not None else next((words.FOLDER_TYPES[p] for p in path.split("/") if p in words.FOLDER_TYPES), None)
    if kind is None:
        return None
    own = root if own is None else own
    properties = child(own, "Properties")
    at = own if properties is None else properties
    name = text(at, "Name") or (own.get("Name", "") if properties is None else "")
    if not name:
        return None
    synonym = child(at, "Synonym")
    named_so = text(synonym, "item", "content") or text(synonym, "value") or text(synonym)
    sections = [{"name": text(t, "Properties", "Name"), "attributes": attributes(t)} for t in named(child(own, "ChildObjects"), "TabularSection") if text(t, "Properties", "Name")]
    records = child(at, "RegisterRecords")
    registers = [type_name(c.text) if c.text and c.text.strip() else local(c) for c in (records if records is not None else ())]
    return {"name": name, "object_type": kind, "synonym": named_so, "attributes": attributes(own), "tab_parts": sections, "registers": registers}


def _named_record(root: ET.Element, path: str, tag: str | None) -> dict | None:
    own = root
    if local(root) == "MetaDataObject":
        own = next(iter(root), None) if tag is None else child(root, tag)
    elif tag is not None and local(root) != tag:
        own = None
    if own is None:
        return None
    properties = child(own, "Properties")
    at = own if properties is None else properties
    event = text(at, "Event")
    stem = path.rpartition("/")[2].rpartition(".")[0]
    sources = [type_name(c.text) for c in named(child(at, "Source"), "Type") if c.text]
    return {"name": text(at, "Name") or stem, "source": ", ".join(sources), "event": words.EVENTS.get(event, event), "handler": text(at, "Handler" if tag else "MethodName")}


def subscription(root: ET.Element, path: str) -> dict | None:
    return _named_record(root, path, "EventSubscription")


def entry_point(root: ET.Element, path: str) -> dict | None:
    return _named_record(root, path, None)


def _name_of(element: ET.Element) -> str:
    return element.get("name") or element.get("Name") or text(element, "Name") or text(element, "Properties", "Name")


def form(root: ET.Element, path: str) -> dict | None:
    """Names in document order. The form's own name comes from the element, else from the folder after Forms."""
    out: dict[str, list] = {"attributes": [], "commands": [], "items": [], "handlers": []}
    name = ""
    for e in root.iter():
        tag = local(e)
        if tag == "Form":
            name = name or _name_of(e)
        elif tag == "Event":
            method = (e.text or "").strip() or text(e, "Name") or text(e, "Handler")
            if method:
                out["handlers"].append({"event": e.get("name") or e.get("Name") or "", "handler": method})
        elif kind := {"Attribute": "attributes", "Command": "commands"}.get(tag) or ("items" if tag in words.FORM_ITEMS else None):
            if own := _name_of(e):
                out[kind].append(own)
    parts = path.split("/")
    if not name and "Forms" in parts[:-1]:
        name = parts[parts.index("Forms") + 1]
    return {"name": name, **out}


def report_schema(root: ET.Element, path: str) -> dict | None:
    own = [e for e in root.iter() if local(e) == "dataSet"]
    queries = [e for e in root.iter() if local(e) == "query"]
    if not own and not queries:
        return None
    sets = []
    for s in own:
        texts = [(e.text or "").strip() for e in s.iter() if local(e) == "query"]
        fields = dict.fromkeys((e.text or "").strip() for e in s.iter() if local(e) in ("dataPath", "field"))
        sets.append({"name": text(s, "name"), "query": next((t for t in texts if t), ""), "fields": [f for f in fields if f]})
    if not own:
        sets = [{"name": "", "query": e.text.strip(), "fields": []} for e in queries if (e.text or "").strip()]
    parameters = [n for e in root.iter() if local(e) == "parameter" and (n := text(e, "name") or text(e, "dataPath"))]
    return {"datasets": sets, "parameters": parameters}


def parsed(content: Column, path: Column, parse: Callable[[ET.Element, str], dict | None], schema: str) -> Column:
    """The struct that `parse` finds in each file; null for what isn't XML."""

    whole = f"struct<found:boolean,value:{schema}>"
    made = to_arrow_type(DataType.fromDDL(whole))

    @F.arrow_udf(whole)
    def run(contents: pa.Array, names: pa.Array) -> pa.Array:
        def one(c: bytes | None, n: str) -> dict:
            try:
                x = parse(ET.fromstring(c), n) if c else None
            except ET.ParseError:
                x = None
            return {"found": x is not None, "value": x}

        # a few files' objects stand in Python at a time, whatever a batch holds
        some = ((contents[at : at + AT_ONCE].to_pylist(), names[at : at + AT_ONCE].to_pylist()) for at in range(0, len(contents), AT_ONCE))
        return pa.concat_arrays([pa.array(list(map(one, *pair)), type=made) for pair in some] or [pa.array([], type=made)])

    return run(content, path)


def _rows(files: DataFrame, parse, schema: str) -> DataFrame:
    rows = files.select("*", parsed(F.col("content"), F.col("path"), parse, schema).alias("_p")).where("_p.found")
    return rows.select("path", *[c for c in ("folder",) if c in rows.columns], "_p.value.*")


def objects(files: DataFrame) -> DataFrame:
    """Metadata objects of files that lie right in a kind's folder: path, name, object_type, synonym, full_name, attributes, tab_parts, registers."""
    placed = files.where(in_roots(F.col("path"), list(words.FOLDER_TYPES)).isNotNull())
    return _rows(placed, metadata_object, OBJECT).withColumn("full_name", F.concat_ws(".", "object_type", "name"))


def subscriptions(files: DataFrame) -> DataFrame:
    placed = files.where(in_roots(F.col("path"), ["EventSubscriptions"]).isNotNull())
    rows = _rows(placed, subscription, NAMED).withColumn("_h", handler_of(F.col("handler")))
    return rows.select("name", "source", F.filter(F.split("source", ", "), lambda x: x != "").alias("sources"), "event", F.col("_h.module").alias("handler_module"), F.col("_h.method").alias("handler_method"))


def entry_points(files: DataFrame) -> DataFrame:
    placed = files.withColumn("folder", in_roots(F.col("path"), list(words.ENTRY_FOLDERS))).where("folder is not null")
    rows = _rows(placed, entry_point, NAMED).withColumn("_h", handler_of(F.col("handler")))
    kinds = F.create_map(*(F.lit(x) for pair in words.ENTRY_FOLDERS.items() for x in pair))
    return rows.select(kinds[F.col("folder")].alias("kind"), "name", F.col("_h.module").alias("handler_module"), F.col("_h.method").alias("handler_method"))


def forms(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Forms and which of their handlers the sibling module defines. functions: path, name."""
    rows = _rows(files, form, FORM).withColumn("module_path", F.regexp_replace("path", "[^/]+$", "Form/Module.bsl"))
    defined = functions.groupBy(F.col("path").alias("module_path")).agg(F.collect_set("name").alias("_names"))
    declared = F.transform("handlers", lambda h: h["handler"])
    both = F.sort_array(F.array_intersect(declared, F.coalesce("_names", F.array().cast("array<string>"))))
    return rows.join(defined, "module_path", "left").select("path", "name", "attributes", "commands", "items", "handlers", both.alias("resolved_handlers"), "module_path")


def report_schemas(files: DataFrame) -> DataFrame:
    """Data sets of report schemas with the objects that their queries name."""
    from ..plans.vocabulary import Vocabulary

    v = Vocabulary()
    rows = _rows(files, report_schema, SCHEMA)
    sets = F.transform("datasets", lambda s: F.struct(s["name"].alias("name"), s["query"].alias("query"), query_refs(s["query"], v).alias("query_refs"), s["fields"].alias("fields")))
    rows = rows.withColumn("datasets", sets)
    return rows.withColumn("query_refs", F.array_sort(F.array_distinct(F.flatten(F.transform("datasets", lambda s: s["query_refs"])))))


def flat(found: DataFrame) -> dict[str, DataFrame]:
    """objects, attributes, tab_parts, tab_part_attributes, register_movements; of equal keys the first stays.

    What was found is written once, an object a row, for the tables are read apart and each would parse all files anew. Names
    are told apart within their object's arrays, without a shuffle.
    """
    from ..operators.ranking import last_write_wins

    one = keep(last_write_wins(found, ["full_name"], ["path"]).withColumn("object_id", F.xxhash64("full_name")), "objects")
    attributes_ = one.select("object_id", F.inline(_first_of_name("attributes", "name", "type_ref", "is_required")))
    parts = one.select("object_id", F.inline(_first_of_name("tab_parts", "name", "attributes"))).withColumn("tab_part_id", F.xxhash64("object_id", "name"))
    inner = parts.select("tab_part_id", F.inline(_first_of_name("attributes", "name", "type_ref")))
    moves = one.select(F.col("object_id").alias("document_id"), F.explode(F.array_distinct("registers")).alias("register_name"))
    return {
        "objects": one.select("object_id", "name", "object_type", "synonym", "full_name"),
        "attributes": attributes_,
        "tab_parts": parts.select("tab_part_id", "object_id", "pos", "name"),
        "tab_part_attributes": inner,
        "register_movements": moves,
    }


def _first_of_name(column: str, *fields: str) -> Column:
    """pos (from 0) and fields of an array's structs, the first of each name alone."""
    names = F.transform(column, lambda x: x["name"])
    placed = F.transform(column, lambda x, i: F.struct(i.alias("pos"), *(x[f].alias(f) for f in fields)))
    return F.filter(placed, lambda x: F.array_position(names, x["name"]) == x["pos"] + 1)
