"""Trigram similarity as Column expressions: words are lower-cased runs of letters and digits, padded by two blanks and one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"
#: An extent of a text is at most so many times as long as the query's trigrams.
EXTENT = 4


def sequence(c: Column) -> Column:
    """Trigrams in order, with repeats."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), 1)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.flatten(grams)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used (a lambda's variable is a plain value)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """Shared distinct trigrams over all distinct ones; 0 if neither has any. a and b: arrays of trigrams."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: let(F.size(F.array_union(x["a"], x["b"])), lambda both: F.when(both > 0, F.size(F.array_intersect(x["a"], x["b"])) / both).otherwise(0.0)))


def word_similarity(q: Column, t: Column) -> Column:
    """The greatest similarity of q's trigrams with an extent of t's that begins and ends with one of them."""

    def over(x: Column) -> Column:
        own, text, n, at = x["own"], x["text"], x["n"], x["at"]

        def best(i: Column) -> Column:
            ends = F.filter(at, lambda j: (j >= i) & (j < i + EXTENT * n))
            return F.array_max(F.transform(ends, lambda j: similarity(own, F.slice(text, i + 1, j - i + 1))))

        return F.coalesce(F.array_max(F.transform(at, best)), F.lit(0.0))

    base = F.struct(F.array_distinct(q).alias("own"), t.alias("text"))

    def placed(x: Column) -> Column:
        at = F.filter(F.transform(x["text"], lambda g, i: F.when(F.array_contains(x["own"], g), i)), lambda i: i.isNotNull())
        return let(F.struct(x["own"].alias("own"), x["text"].alias("text"), F.size(x["own"]).alias("n"), at.alias("at")), over)

    return let(base, placed)
