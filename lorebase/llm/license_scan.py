"""Licence scans: texts in a canonical form, hash-joined whole and line by line to known licence digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN, TITLES

# Equivalent spellings, applied to words in this order after case and punctuation are gone. Each leaves the
# first two characters of its first word as they are, which `lead` relies on.
EQUIVALENT = [
    ("licences", "licenses"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub licence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("and or", "andor"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII, Latin-1, general and ideographic punctuation, and blanks of all kinds.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{80}-\x{BF}\x{2000}-\x{206F}\x{2122}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}\x{FEFF}]+"
#: Beginnings of known texts that lines are tried for before they are digested; with more of them all lines are.
MAX_LEADS = 4096
_EDGE = r"[ \t#*/;%!\-]*"
#: A line that only says who holds the copyright, or only is the title of a licence; a comment's marks may go before.
COPYRIGHT_LINE = (
    rf"(?m)^{_EDGE}(?:copyright[ \t:]*(?:©|\(c\)|<|\[|\{{|by[ \t])[^\n]*|copyright[ \t][^\n]*[0-9][0-9][0-9][0-9][^\n]*"
    r"|(?:©|\(c\)[ \t]*(?:copyright|[0-9][0-9][0-9][0-9]))[^\n]*|all rights reserved\.?[ \t\r]*)$"
)
TITLE_LINE = rf"(?m)^{_EDGE}(?:(?:{'|'.join(TITLES)}) licen[cs]e(?: \(mit\)| \(mit-0\)| \(isc\)| - version 1\.0 - august 17th, 2003)?|mit no attribution|do what the fuck you want to public license|version 2, december 2004):?[ \t\r]*$"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines and titles, words parted by single spaces, equivalent spellings as one; null as empty.

    A word is a run of characters outside PUNCTUATION.
    """
    x = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    # most texts have no such line, and looking for a word costs less than the pattern
    x = F.when(F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("©")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("all rights reserved")), F.regexp_replace(x, COPYRIGHT_LINE, "")).otherwise(x)
    x = F.when(F.contains(x, F.lit(" licen")) | F.contains(x, F.lit("mit no attribution")) | F.contains(x, F.lit("version 2, december")), F.regexp_replace(x, TITLE_LINE, "")).otherwise(x)
    # two blanks between words, so that neighbours are both replaced
    x = F.concat(F.lit(" "), F.regexp_replace(x, PUNCTUATION, "  "), F.lit(" "))
    for one, other in EQUIVALENT:
        x = F.replace(x, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    # a word may begin and end the text without the blanks added above
    return F.trim(F.regexp_replace(x, "  +", " "))


def lead(text: Column) -> Column:
    """The first two characters of a text's first word (fewer if it is shorter), as `canonical` would give them for a line of words."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.regexp_extract(F.regexp_replace(low, f"^{PUNCTUATION}", ""), rf"^[^{PUNCTUATION[1:-2]}]{{1,2}}", 0)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license, lead): one row for each distinct canonical text; of several licences of one text the smallest name."""
    rows = [(name, text) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    table = spark.createDataFrame(rows, "license string, text string").withColumn("text", canonical(F.col("text")))
    told = table.groupBy("text").agg(F.min("license").alias("license"))
    return told.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "license", lead(F.col("text")).alias("lead"))


def _begins_known(told: DataFrame) -> Column:
    """Whether `line` begins as a known text does; always true if the known texts begin in very many ways."""
    leads = [r.lead for r in told.select("lead").distinct().limit(MAX_LEADS + 1).collect()]
    return lead(F.col("line")).isin(leads) if len(leads) <= MAX_LEADS else F.lit(True)


def scan(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, license, line_licenses) for every row.

    license: of the known licence whose canonical text the whole text is, else null. line_licenses: sorted distinct
    licences that a line of the text is; empty if none. Lines end at line feeds. Null, empty and blank texts, and texts
    of titles and copyright lines alone, have the digest of the empty text and no licence. Repeated rows are kept; empty
    tables give no rows; other columns are ignored. Known digests are looked up by hash joins that Spark broadcasts only
    if they are small; only lines that begin as a known text does are digested, and of those only the ones that a joined
    digest matches are grouped.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    told = known.filter("lead <> ''")  # without words no text is known
    whole = told.select("digest", F.col("license").alias("license"))
    lines = F.expr("array_distinct(split(text, '\\n'))")
    found = (
        rows.filter("text is not null").select("doc_id", F.xxhash64("text").alias("print"), F.explode(lines).alias("line"))
        .filter(_begins_known(told))
        .select("doc_id", "print", digest(F.col("line")).alias("line_digest"))
        .join(told.select(F.col("digest").alias("line_digest"), F.col("license").alias("line_license")), "line_digest")
        .groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("line_license")).alias("line_licenses"))
    )
    joined = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("print")).join(whole, "digest", "left")
    return (
        joined.withColumnsRenamed({"doc_id": "d", "print": "p"}).join(found, F.expr("d <=> doc_id and p = print"), "left")
        .select(F.col("d").alias("doc_id"), "digest", "license", F.expr("coalesce(line_licenses, array())").alias("line_licenses"))
    )
