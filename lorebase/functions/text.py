"""Text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field separator and end mark of tagged extraction output, and the malformed separators it repairs.
SEP = "<|SEP|>"
DONE = "<|DONE|>"
SEP_VARIANTS = (r"(?i)<\|SEP\?>", r"(?i)<\|SEP？>", r"(?i)<\|SEP｜>", r"(?i)<\|SEP[|!1Il｜丨]>", r"(?i)<\|SEP\s*\|?\s*>")
DONE_VARIANT = r"(?i)<\|\s*DONE\s*\|?\s*>"

#: Statuses and what they count as.
STATUS = {
    "completed": ("completed", "done", "success", "succeeded"),
    "failed": ("failed", "error"),
    "running": ("running", "processing", "in_progress", "active"),
    "pending": ("pending", "queued", "waiting"),
}
#: What some listings count as running besides.
UI_RUNNING = ("recovering",)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """The key by which names are matched."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def basic_clean(c: Column) -> Column:
    """Line ends as line feeds, each line and the whole without white space at the ends."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def token_count(c: Column) -> Column:
    """Runs of ASCII letters and digits, and CJK characters one by one."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[A-Za-z0-9]+|[一-鿿]")), F.lit(0))


def token_estimate(c: Column) -> Column:
    """The same and each other character that is neither white space nor a word character."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)[A-Za-z0-9]+|[一-鿿]|[^\w\s]")), F.lit(0))


def agent_tokens(c: Column) -> Column:
    """Non-ASCII characters and a quarter of the ASCII ones, rounded up; 1 at least, 0 if blank."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    narrow = F.length(c) - wide
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.greatest(F.lit(1), wide + F.ceil(narrow / 4))).cast("long")


def compact(c: Column, limit: int = 320) -> Column:
    """White space collapsed; cut to the limit with an ellipsis."""
    one = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.regexp_replace(F.left(one, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(one)


def truncate(c: Column, limit: int, mark: str = "...<truncated>") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def csv_of(values: Column) -> Column:
    """Trimmed, without blanks, joined by commas."""
    return F.array_join(F.filter(F.transform(values, lambda x: strip(x)), lambda x: x != ""), ",")


def drop_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<think>.*?</think>", "")


def repair_separators(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pattern in SEP_VARIANTS:
        c = F.regexp_replace(c, pattern, SEP)
    return F.regexp_replace(c, DONE_VARIANT, DONE)


def lines(c: Column) -> Column:
    """Split at every line boundary that Unicode text has."""
    return F.split(c, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")


def sanitize_output(c: Column) -> Column:
    """Model output from its first tagged line up to the end mark; all of it if no line is tagged."""
    t = repair_separators(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))))
    t = F.replace(F.regexp_replace(drop_thinking(t), r"(?i)```(?:text|json|markdown)?", ""), F.lit("```"), F.lit(""))
    kept = F.filter(F.transform(lines(t), strip), lambda x: x != "")
    tagged = F.transform(kept, lambda x: x.startswith("entity" + SEP) | x.startswith("relation" + SEP) | x.startswith(DONE))
    first = F.array_position(tagged, True)
    rest = F.slice(kept, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(kept), F.lit(1)))
    done = F.array_position(rest, DONE)
    cut = F.when(done > 0, F.slice(rest, F.lit(1), F.greatest(done, F.lit(1)).cast("int"))).otherwise(rest)
    return F.when(first > 0, F.array_join(cut, "\n")).otherwise(strip(t))


def status(c: Column, ui: bool = False) -> Column:
    raw = norm(c)
    out = None
    for name, words in STATUS.items():
        hit = raw.isin(*words, *(UI_RUNNING if ui and name == "running" else ()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.when(raw == "", "pending").otherwise(raw))


def size_in_bytes(c: Column) -> Column:
    """`10 MB` as bytes by powers of 1024; null if it is no size."""
    number = F.regexp_extract(c, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB)?\s*$", 1)
    unit = F.upper(F.regexp_extract(c, r"(?i)^\s*[0-9]+(?:\.[0-9]+)?\s*(B|KB|MB|GB)?\s*$", 1))
    power = F.when(unit == "KB", 1024).when(unit == "MB", 1024**2).when(unit == "GB", 1024**3).otherwise(1)
    return F.when(number != "", (F.try_to_number(number, F.lit("999999999999.999999")).cast("double") * power).cast("long"))


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor an empty text; 0 and false count."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def replace_all(c: Column, items: Column) -> Column:
    """Literal replacements raw -> result of an array of structs, each seeing what the last one left."""
    return F.aggregate(items, c, lambda t, i: F.when(F.coalesce(i["raw"], F.lit("")) == "", t).otherwise(F.replace(t, i["raw"], F.coalesce(i["result"], F.lit("")))))


def slices(c: Column, size: int = 48) -> Column:
    """Consecutive pieces of `size` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def kind_of_event(event: Column, has_tool: Column) -> Column:
    starts = lambda *p: _any(event.startswith(x) for x in p)
    return (
        F.when(starts("assistant.") | (event == "done"), "assistant").when(starts("agent.think") | (event == "usage.llm"), "llm")
        .when(starts("skill."), "skill").when(starts("tool."), "tool").when(starts("retrieval."), "retrieval").when(starts("run."), "run")
        .when(event == "trace.ready", "trace").when(event == "meta", "meta").when(has_tool, "tool").otherwise("system")
    )


def status_of_event(event: Column, explicit: Column) -> Column:
    """The explicit status if there is one, else what the event's ending says, else running."""
    ends = lambda *p: _any(event.endswith(x) for x in p)
    given = strip(F.coalesce(explicit, F.lit(""))) != ""
    return (
        F.when(given, status(explicit)).when(ends(".error") | (event == "run.failed"), "failed").when(ends(".start"), "running")
        .when(ends(".end", ".done") | event.isin("done", "trace.ready", "run.complete"), "completed").otherwise("running")
    )
