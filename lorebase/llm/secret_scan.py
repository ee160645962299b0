"""Secrets: fixed patterns, and strings in a sensitive context that a primed zstandard compressor can't shorten."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, tidy


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns. `hex` begins only where a run does, so a long run is read once.
_WORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

KINDS = ("assign", "access", "hex", "novel")
BASE = KINDS[:3]

#: A candidate of the method: a whole run, however long, of at least twelve characters that begins so near after a
#: sensitive word. Which characters it has decides nothing: whether it is a secret is the compressor's to say.
_BEGIN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_SENSITIVE = re.compile(r"pass|secret|token|key|credential|auth|private|bearer|signature", re.IGNORECASE)
NEAR, AROUND = 48, 512
#: Marginal compressed bytes for each character of the candidate from which on it is reported. Long words of texts stay
#: under 0.7, random letters and digits mostly over 0.9 (figures in the README).
NOVELTY = 0.75

#: Identifiers and code that secrets are told apart from; the compressor's dictionary.
CODE = """
import from return class def function const let var public private static void int string bool true false null None self this new
if else for while try except catch finally raise throw async await lambda yield with open read write close print log error debug info warning
request response client server session config settings options value values index count length size name names path file files data
username password passwd secret token access_key api_key apikey auth authorization bearer credential private_key public_key signature
http https www com org net html json yaml xml utf8 base64 sha1 sha256 md5 uuid encode decode hash digest hexdigest random
example sample test placeholder changeme your_token_here your_password your_api_key xxxxxxxx 00000000 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
user_id session_id request_id created_at updated_at get_value set_value get_token set_token getPassword setPassword getAccessToken refreshToken
self.token = os.environ["TOKEN"]  password = getpass.getpass()  api_key = config.get("api_key")  Authorization: Bearer
"""


@cache
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str = "", dictionary: str = CODE) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each of its characters."""
    c = _compressor(dictionary)
    around = (before + after).encode("utf-8", "replace")
    added = len(c.compress(around + candidate.encode())) - len(c.compress(around))
    return added / max(1, len(candidate))


def spans(text: str | None, dictionary: str = CODE, threshold: float = NOVELTY) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, novelty) by start and kind. Base spans stay whatever their novelty, which is that of the value in them."""
    if not text:
        return []

    def score(a: int, b: int) -> float:
        return round(novelty(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], dictionary), 3)

    out = [(*m.span(), "assign", score(*m.span(1))) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(*m.span(), "access", score(*m.span())) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex", score(*m.span())) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for a, b, *_ in out)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    last = -1
    for sense in _SENSITIVE.finditer(text):
        for begin in _BEGIN.finditer(text, max(sense.end(), last + 1), min(len(text), sense.end() + NEAR + 1)):
            last = begin.start()
            m = _CANDIDATE.match(text, last)
            if not m:
                continue
            a, b = m.span()
            before = bisect_left(starts, b)
            if before and ends[before - 1] > a:
                continue
            new = score(a, b)
            if new >= threshold:
                out.append((a, b, "novel", new))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dictionary: str = CODE, threshold: float = NOVELTY) -> DataFrame:
    """(doc_id, spans) for every row: spans of the whole text in code points, end exclusive, each with its novelty.

    A null or empty text has none; empty tables give no rows; equal rows give equal results; a null doc_id stays null;
    other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "novelty": s} for a, b, k, s in spans(x, dictionary, threshold)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:int,end:int,novelty:double>>")
