"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy

# The base patterns, written so that no run of characters is scanned twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[0-9]{2}(?= ?[A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}

#: The order in which kinds that start at the same place are listed; the method's own follow the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: Score of a kind once its checks have passed, and the words that raise it when they stand nearby.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "bic"),
    "ssn": ("ssn", "social", "security"),
}
#: What a context word within so many characters adds, and the score that a span of the method's own kinds needs.
RAISE, NEAR, THRESHOLD = 0.3, 40, 0.5


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (1 + place % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the country and check digits moved to the end, letters as 10 to 35, leave 1."""
    x = iban.replace(" ", "")
    rest = 0
    for c in x[4:] + x[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _digits(x: str) -> str:
    return re.sub("[^0-9]", "", x)


def _emails(text: str):
    after, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        after = m.end() if m else at + 1
        at = text.find("@", after)


def _ibans(text: str):
    """Where a country's code, two digits and as many characters as its IBANs have stand as words of their own, with mod 97 right.

    Either case; single blanks may part the characters.
    """
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTH.get(m[1].upper(), 0) - 4
        at = m.end()
        while left > 0:
            at += text[at : at + 1] == " "
            if not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()):
                break
            at, left = at + 1, left - 1
        after = text[at : at + 1]
        if left == 0 and not (after.isascii() and after.isalnum()) and mod97(text[m.start() : at]):
            yield m.start(), at


def _proposed(text: str):
    if "@" in text:
        yield from ((a, b, "email") for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            yield *m.span(), "ip"
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            yield *m.span(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield *m.span(), "phone"
    yield from ((a, b, "iban") for a, b in _ibans(text))
    for m in _SSN.finditer(text):
        yield *m.span(), "ssn"


def spans(text: str | None) -> list[Span]:
    """All spans by start and kind. A base span stays whatever its score; the method's own need THRESHOLD."""
    if not text:
        return []
    out = []
    for begin, end, kind in _proposed(text):
        around = f"{text[max(0, begin - NEAR) : begin]} {text[end : end + NEAR]}".lower()
        score = min(1.0, SCORES[kind] + RAISE * any(re.search(rf"\b{re.escape(w)}", around) if w.isalpha() else w in around for w in CONTEXT[kind]))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(begin, end, kind, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None) -> str | None:
    """Each maximal run of overlapping spans gives way to `<KIND>` of its first span; a null stays."""
    if text is None:
        return None
    out, at, found = [], 0, spans(text)
    i = 0
    while i < len(found):
        s, end = found[i], found[i].end
        while i < len(found) and found[i].start < end:
            end = max(end, found[i].end)
            i += 1
        out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row: spans of the whole text in code points (end exclusive) with scores.

    A null text is empty: it has no spans. Empty tables give no rows; repeated rows are kept and get equal results;
    spans that start together are listed by kind; a null doc_id stays null; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])

    kind = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), kind)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data of `text` masked; an n_chars column follows the new text.

    A null text stays, and so does its n_chars. Repeated rows get equal results; empty tables give no rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            clean = pa.array([redacted(x) for x in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, text, clean)

    out = docs.mapInArrow(tidy(run), docs.schema)
    kind = dict(out.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text).cast(kind)).otherwise(F.col("n_chars"))) if kind else out
