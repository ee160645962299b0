"""The registry of skills, and the short form in which a skill's text is shown to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .store import upsert_table

_PRINT = ("skill_md_mtime_ns", "skill_md_size", "manifest_mtime_ns", "manifest_size")


def register(skills: DataFrame, incoming: DataFrame, sequence: str = "seq") -> DataFrame:
    """The registry with new and changed skills, by name."""
    return upsert_table("skills", skills, incoming, sequence)


def keep_only(skills: DataFrame, names: DataFrame) -> DataFrame:
    """The registry without skills that aren't among the names; no names, no skills."""
    return skills.join(names.select("name").distinct(), "name", "left_semi")


def fresh(skills: DataFrame, asked: DataFrame) -> DataFrame:
    """Skills whose files are as they were when they were registered: name and the four figures are equal."""
    return skills.join(asked.select("name", *_PRINT).distinct(), ["name", *_PRINT], "left_semi")


def compact_prompt(content: Column, width: int = 1400, most: int = 18) -> Column:
    """The distinct lines of a text that give it structure (headings, lists, code), or its first lines if none does; cut with an ellipsis."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "")
    lines = F.filter(F.transform(T.lines(body), T.strip), lambda x: x != "")
    single = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    structure = F.array_distinct(F.filter(single, lambda x: F.rlike(x, F.lit(r"^(?:#|- |\* |[0-9]+\.)|`"))))
    chosen = F.slice(F.when(F.size(structure) > 0, structure).otherwise(lines), 1, most)
    told = T.strip(F.array_join(chosen, "\n"))
    return F.when(F.length(told) <= width, told).otherwise(F.concat(F.regexp_replace(F.left(told, F.lit(width - 1)), r"(?U)\s+$", ""), F.lit("…")))
