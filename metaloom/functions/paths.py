"""Column functions on paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_key(path: Column) -> Column:
    """What follows the last `src` folder; the whole path if there is none."""
    below = F.regexp_extract(path, "^(?:.*/)?src/(.*)$", 1)
    return F.when(below == "", path).otherwise(below)


def segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def owner(key: Column, folders: list[str]) -> Column:
    """The segment after the first one that names a kind of object; null if there is none."""
    parts = segments(key)
    known = F.array(*map(F.lit, folders))
    after = F.filter(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.struct(F.array_contains(known, p).alias("hit"), F.get(parts, i + 1).alias("next"))), lambda x: x["hit"])
    return F.when(F.size(parts) > 1, F.get(after, F.lit(0))["next"])


def kind(key: Column, kinds: dict[str, str]) -> Column:
    """The kind of the first known folder, in the order of the table; empty if there is none."""
    parts = segments(key)
    cases = None
    for folder, name in kinds.items():
        hit = F.array_contains(parts, folder)
        cases = F.when(hit, name) if cases is None else cases.when(hit, name)
    return cases.otherwise("")


def module_type(path: Column) -> Column:
    """What kind of module a path holds; the first rule that fits."""
    parts = segments(path)
    name = F.element_at(parts, -1)
    has = lambda p: F.array_contains(parts, p)
    rules = F.when((name == "Module.bsl") & has("Forms") & has("Form"), "FormModule")
    for own in ("ObjectModule", "ManagerModule", "RecordSetModule", "CommandModule"):
        rules = rules.when(name == f"{own}.bsl", own)
    return rules.when((name == "Module.bsl") & has("CommonModules"), "CommonModule").otherwise("Module")


def help_path(path: Column, skipped: list[str], suffix: str) -> Column:
    """Folders of a help file joined by dots, but for the skipped ones, and a suffix; the file's stem where no folder is left."""
    parts = segments(path)
    folders = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin(*skipped, ""))
    stem = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    return F.when(F.size(folders) == 0, F.concat(F.lit(f"{suffix}."), stem)).otherwise(F.concat(F.array_join(folders, "."), F.lit(f".{suffix}")))
