"""Tagged extraction output as rows: entities, relations and errors; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_SPLIT = r"<\|SEP\|>"


def tagged_lines(raw: DataFrame, keys: list[str], column: str = "raw") -> DataFrame:
    """(keys, line, fields): the lines before the end mark, numbered from 1, as trimmed fields."""
    lines = F.transform(T.lines(T.repair_separators(T.strip(F.coalesce(column, F.lit(""))))), T.strip)
    until = F.when(F.array_position("_l", T.DONE) > 0, F.slice("_l", F.lit(1), F.array_position("_l", T.DONE).cast("int") - 1)).otherwise(F.col("_l"))
    rows = raw.select(*keys, lines.alias("_l")).select(*keys, F.posexplode(until).alias("_p", "_t")).filter("_t <> ''")
    return rows.select(*keys, (F.col("_p") + 1).alias("line"), F.transform(F.split("_t", _SPLIT, -1), T.strip).alias("fields"))


def _rest(n: int) -> Column:
    return T.strip(F.array_join(F.slice("fields", F.lit(n), F.greatest(F.size("fields") - n + 1, F.lit(0))), T.SEP))


def entities(lines: DataFrame, keys: list[str]) -> DataFrame:
    f = F.col("fields")
    rows = lines.filter((f[0] == "entity") & (F.size(f) >= 4))
    return rows.select(*keys, "line", F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).alias("type"), _rest(4).alias("description")).filter("name <> '' and type <> ''")


def confidence(c: Column) -> Column:
    """A whole number, else null."""
    return F.when(F.rlike(c, F.lit(r"^[+-]?[0-9]{1,9}$")), c.try_cast("int"))


def relations(lines: DataFrame, keys: list[str]) -> DataFrame:
    f = F.col("fields")
    rows = lines.filter((f[0] == "relation") & (F.size(f) >= 6))
    at = lambda i: F.get(f, F.lit(i))
    return rows.select(*keys, "line", at(1).alias("subject"), at(2).alias("object"), at(3).alias("description"), at(4).alias("relation_type"), confidence(_rest(6)).alias("confidence")).filter("subject <> '' and object <> ''")


def errors(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, error): bad lines; a bad confidence is told although its relation stays."""
    f, n = F.col("fields"), F.size("fields")
    at = lambda i: F.get(f, F.lit(i))
    kind, head = at(0), F.concat(F.lit("line "), "line", F.lit(": "))
    few = lambda what: F.concat(head, F.lit(f"invalid {what} fields count="), n)
    one = (
        F.when((kind == "entity") & (n < 4), few("entity")).when((kind == "entity") & ((at(1) == "") | (at(2) == "")), F.concat(head, F.lit("entity missing name/type")))
        .when((kind == "relation") & (n < 6), few("relation"))
        .when(~kind.isin("entity", "relation"), F.concat(head, F.lit("unknown kind '"), kind, F.lit("'")))
    )
    full = (kind == "relation") & (n >= 6)
    number = F.when(full & confidence(_rest(6)).isNull(), F.concat(head, F.lit("invalid confidence '"), _rest(6), F.lit("'")))
    ends = F.when(full & ((at(1) == "") | (at(2) == "")), F.concat(head, F.lit("relation missing subject/object")))
    return lines.select(*keys, "line", F.explode(F.filter(F.array(one, number, ends), lambda x: x.isNotNull())).alias("error"))
