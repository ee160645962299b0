"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the few rules to try."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rules that are compiled and broadcast at once; more rules make more passes.
BLOCK_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """`host/path` rules fit a host with all its subdomains if the path starts with theirs; any other is a pattern.

    In a pattern `*` stands for any run of characters and `^` for one that is no letter, digit or `_.%-`, or the end;
    it is looked for anywhere in the URL, A-Z being equal to a-z. Host rules go before patterns, longer before shorter
    ones, then allow before block, then the smaller text.
    """

    text: str
    verdict: str
    pattern: bool = False

    def rank(self) -> tuple:
        return (self.pattern, -len(self.text), self.verdict != "allow", self.text)

    def regex(self) -> re.Pattern:
        if self.pattern:
            made = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in self.text.translate(_LOWER))
            return re.compile(made, re.DOTALL)
        host, _, path = self.text.partition("/")
        return re.compile(rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}")

    def tokens(self) -> set[str]:
        """Literal tokens that every URL it fits has whole: none next to a wildcard or at an open end."""
        if not self.pattern:
            host, _, path = self.text.translate(_LOWER).partition("/")
            whole = set(_TOKEN.findall(host))
            cut = _TOKEN.findall(path)
            # the last token of a path may go on in the URL
            return whole | set(cut if not path or not path[-1].isascii() or not path[-1].isalnum() else cut[:-1])
        found = set()
        low = self.text.translate(_LOWER)
        for m in _TOKEN.finditer(low):
            if m.start() > 0 and low[m.start() - 1] != "*" and m.end() < len(low) and low[m.end()] != "*":
                found.add(m[0])
        return found


#: Rules of the production list, and its patterns for URLs that no host rule fits.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
PATTERNS = (Rule(".ads-track.", "block", True), Rule("/ads/", "block", True), Rule("^utm_medium=banner^", "block", True), Rule("/track/*/pixel.", "block", True), Rule("//doubleclick.", "block", True))


def split_url(url: str | None) -> tuple[str, str]:
    """Host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then the path up to `?`, `#` or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class _Index:
    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[tuple, Rule, re.Pattern]]] = {}
        self.always = []
        for r in rules:
            entry = (r.rank(), r, r.regex())
            own = r.tokens()
            if own:
                self.by_token.setdefault(min(own, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def best(self, url: str | None, host: str, path: str) -> tuple[tuple, Rule] | None:
        if url is None:
            return None
        low = url.translate(_LOWER)
        found = None
        split = host + path  # a host has no slash, a path begins with one
        for key in (*dict.fromkeys(_TOKEN.findall(low)), None):
            for rank, rule, regex in self.always if key is None else self.by_token.get(key, ()):
                if (found is None or rank < found[0]) and (regex.search(low) if rule.pattern else regex.match(split)):
                    found = rank, rule
        return found


def _rarity(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many URLs each wanted token stands; one row for each comes back."""
    shared = urls.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        told, total = shared.value, {}
        for batch in batches:
            for u in batch.column(0).to_pylist():
                for t in told.intersection(_TOKEN.findall((u or "").translate(_LOWER))):
                    total[t] = total.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    counted = urls.mapInArrow(tidy(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist()))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, patterns: Sequence[Rule] = PATTERNS, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row, in its place.

    rule: the best host rule, else null; pattern: where no host rule fits, the best pattern, else null; the verdict is
    that of whichever is given, else the default. Rules of one text count once, as the one that goes first (allow). A
    null URL, or one without `://`, has an empty host and path; a null one fits nothing. Repeated rows get equal
    results; empty tables give no rows; other columns are ignored. Without rules every verdict is the default.
    """
    prepare(pages.sparkSession)
    every = list({(r.pattern, r.text): r for r in sorted([*rules, *patterns], key=Rule.rank, reverse=True)}.values())
    urls = pages.select(F.col(url).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), none.alias("rule"), none.alias("verdict"), none.alias("pattern"), none.alias("host"), none.alias("path"))
    kind = dict(out.dtypes)["page_id"]
    # a block of rules at a time is sent to the workers; a row carries the best so far
    for lo in range(0, max(1, len(every)), BLOCK_RULES):
        block = every[lo : lo + BLOCK_RULES]
        told = pages.sparkSession.sparkContext.broadcast((block, _rarity(urls, {t for r in block for t in r.tokens()}) if block else {}))
        out = out.mapInArrow(tidy(_by(told)), f"page_id {kind}, url string, rule string, verdict string, pattern string, host string, path string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "pattern")


def _by(told):
    def run(batches):
        index = _Index(*told.value)
        for batch in batches:
            rows = []
            for u, rule, verdict, pattern in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                host, path = split_url(u)
                found = index.best(u, host, path)
                best = found[1] if found else None
                if verdict is not None:
                    so_far = Rule(pattern if rule is None else rule, verdict, rule is None)
                    best = min((r for r in (best, so_far) if r), key=Rule.rank)
                rows.append((None, None, None, host, path) if best is None else (None, best.verdict, best.text, host, path) if best.pattern else (best.text, best.verdict, None, host, path))
            columns = zip(*rows) if rows else ([] for _ in range(5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "url", "rule", "verdict", "pattern", "host", "path"])

    return run
