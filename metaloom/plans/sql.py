"""The catalogue from SQL: views of an index's tables, and table functions with declared columns.

    sql.register(index)
    spark.sql("SELECT * FROM callers_of('ПолучитьСтавку') JOIN functions_like('Заказ') USING (symbol_id)")

Each function is SQL itself, so Spark plans it as a part of the statement that uses it, with its filters pushed into
the tables. Arguments are plain text in which `%` and `_` mean themselves; case doesn't count.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .build import TABLES, Index

FOUND = "symbol_id BIGINT, name STRING, type STRING, params ARRAY<STRING>, is_export BOOLEAN, line_start INT, line_end INT, module_path STRING, module_type STRING, object_name STRING"
ROW = "symbol_id, name, type, params, is_export, line_start, line_end, module_path, module_type, object_name"

#: Name and parameters, columns, and the rows. `placed` has the symbols with their files.
FUNCTIONS = {
    "functions_named(wanted STRING)": (FOUND, f"SELECT {ROW} FROM {{placed}} WHERE name_key = lower(wanted)"),
    "functions_like(part STRING)": (FOUND, f"SELECT {ROW} FROM {{placed}} WHERE contains(name_key, lower(part))"),
    "functions_of_module(part STRING)": (FOUND, f"SELECT {ROW} FROM {{placed}} WHERE contains(lower(module_path), lower(part))"),
    "callees_of(wanted STRING)": (
        "symbol_id BIGINT, qualifier STRING, callee_name STRING, edge_type STRING, resolved BOOLEAN, dst_symbol_id BIGINT",
        "SELECT s.symbol_id, e.qualifier, e.callee_name, e.edge_type, e.resolved, e.dst_symbol_id FROM {placed} s JOIN {edges} e ON e.src_symbol_id = s.symbol_id WHERE s.name_key = lower(wanted)",
    ),
    "callers_of(wanted STRING)": (
        FOUND,
        f"""SELECT DISTINCT {", ".join("c." + x.strip() for x in ROW.split(","))} FROM (
        SELECT e.src_symbol_id FROM {{placed}} s JOIN {{edges}} e ON e.dst_symbol_id = s.symbol_id WHERE s.name_key = lower(wanted)
        UNION SELECT src_symbol_id FROM {{edges}} WHERE dst_symbol_id IS NULL AND callee_key = lower(wanted)) m JOIN {{placed}} c ON c.symbol_id = m.src_symbol_id""",
    ),
    "calls_between(caller STRING, callee STRING)": (
        "edge_id BIGINT, edge_type STRING, resolved BOOLEAN, qualifier STRING",
        "SELECT e.edge_id, e.edge_type, e.resolved, e.qualifier FROM {edges} e JOIN {placed} s ON s.symbol_id = e.src_symbol_id WHERE s.name_key = lower(caller) AND e.callee_key = lower(callee)",
    ),
    "objects_named(wanted STRING)": ("object_id BIGINT, full_name STRING, object_type STRING, name STRING, synonym STRING", "SELECT object_id, full_name, object_type, name, synonym FROM {objects} WHERE name_key = lower(wanted)"),
    "attributes_of(wanted STRING)": (
        "full_name STRING, part STRING, pos BIGINT, name STRING, type_ref STRING",
        """SELECT o.full_name, CAST(NULL AS STRING), CAST(a.pos AS BIGINT), a.name, a.type_ref FROM {objects} o JOIN {attributes} a ON a.object_id = o.object_id WHERE o.name_key = lower(wanted)
        UNION ALL SELECT o.full_name, t.name, CAST(i.pos AS BIGINT), i.name, i.type_ref FROM {objects} o JOIN {tab_parts} t ON t.object_id = o.object_id JOIN {tab_part_attributes} i ON i.tab_part_id = t.tab_part_id WHERE o.name_key = lower(wanted)""",
    ),
    "references_to(wanted STRING)": (
        "referencing_object STRING, attribute_name STRING, attribute_type STRING",
        """SELECT DISTINCT o.full_name, a.name, a.type_ref FROM {attributes} a JOIN {objects} o ON o.object_id = a.object_id WHERE contains(lower(a.type_ref), lower(wanted))
        UNION SELECT concat_ws('.', o.full_name, t.name), i.name, i.type_ref FROM {tab_part_attributes} i JOIN {tab_parts} t ON t.tab_part_id = i.tab_part_id JOIN {objects} o ON o.object_id = t.object_id WHERE contains(lower(i.type_ref), lower(wanted))""",
    ),
    "body_lines(part STRING)": (
        "path STRING, function_name STRING, line INT, text STRING",
        """SELECT path, function_name, CAST(line_start + at AS INT), trim(content) FROM (SELECT path, function_name, line_start, at, content FROM {bodies} LATERAL VIEW posexplode(split(body, '\\n')) AS at, content
        WHERE contains(lower(body), lower(part))) WHERE contains(lower(content), lower(part))""",
    ),
}


def register(index: Index, prefix: str = "") -> None:
    """Views <prefix><table> and <prefix>placed, and the functions with the prefix, in the index's session; earlier ones of these names are replaced."""
    spark: SparkSession = index.files.sparkSession
    keyed = {"symbols": ("name", "name_key"), "objects": ("name", "name_key"), "edges": ("callee_name", "callee_key")}
    names = {}
    for table in TABLES:
        rows = getattr(index, table)
        column, key = keyed.get(table, (None, None))
        if key and key not in rows.columns:
            rows = rows.withColumn(key, F.lower(column))
        names[table] = f"{prefix}{table}"
        rows.createOrReplaceTempView(names[table])
    names["placed"] = f"{prefix}placed"
    spark.sql(f"SELECT s.*, f.path AS module_path, f.module_type, f.object_name FROM {names['symbols']} s JOIN {names['files']} f ON f.file_id = s.file_id").createOrReplaceTempView(names["placed"])
    for head, (columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS TABLE ({columns}) RETURN {body.format(**names)}")
