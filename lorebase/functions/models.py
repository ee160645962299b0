"""Seams for hosted models: functions that run on the workers in Arrow batches, their failures told in a column."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunker import split_by_tokens
from .replies import first_value

#: Tries of a call, the first wait in seconds, and the share of a wait that is left to chance.
TRIES, WAIT, JITTER = 3, 0.5, 0.2
#: Tokens from which on a text is embedded in parts, and of the parts after a refusal.
MAX_TOKENS, REFUSED_TOKENS = 2400, 600
# What a refusal of a text that is too long says.
TOO_LONG = ("context length", "maximum context", "too many tokens", "input is too long")


def patiently(call: Callable, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The call, tried again after waits that double, each longer by up to a fifth; the last failure is raised."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except Exception:
                if i + 1 == tries:
                    raise
                sleep(wait * 2**i * (1 + JITTER * random.random()))

    return run


def answered(call: Callable[[str], str], prompt: Column, tries: int = TRIES, wait: float = WAIT) -> Column:
    """struct<reply,error> of a text model; a row whose last try fails has a null reply and its error.

    A null prompt isn't asked: its reply and error are null.
    """
    ask = patiently(call, tries, wait)

    @F.pandas_udf("reply string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        def one(p):
            if p is None:
                return None, None
            try:
                return str(ask(p)), None
            except Exception as e:  # told in the row
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(p) for p in prompts], columns=["reply", "error"])

    return run(prompt)


def answered_json(call: Callable[[str], str], prompt: Column, required: Sequence[str] = (), tries: int = 5, wait: float = 2.0, hint: str = "") -> Column:
    """struct<reply,error>: the reply's JSON value as text, asked for again until it is one that has the required keys.

    Once a reply was none, the hint follows the prompt.
    """
    import json

    from .replies import balanced

    def asked(p: str) -> str:
        bad = []

        def once() -> str:
            told = balanced(call(p + hint * bool(bad)))
            try:
                got = json.loads(told)
                missing = [k for k in required if not isinstance(got, dict) or k not in got]
                if missing:
                    raise ValueError(f"the reply lacks {', '.join(missing)}")
            except ValueError:
                bad.append(told)
                raise
            return told

        return patiently(once, tries, wait)()

    return answered(asked, prompt, 1)


def standardised(call: Callable[[str], str], text: Column) -> Column:
    """The model's version of a text, or the text itself if the call fails or says nothing."""
    reply = answered(call, text)["reply"]
    return F.coalesce(F.when(F.trim(reply) != "", reply), text)


def described(images: DataFrame, call: Callable[[bytes, str], str], prompt: str, content: str = "content") -> DataFrame:
    """Adds text and error: what a vision model says of each image; a failure leaves the text empty and the others alone."""

    @F.pandas_udf("text string, error string")
    def run(blobs: pd.Series) -> pd.DataFrame:
        def one(b):
            try:
                return call(bytes(b), prompt), None
            except Exception as e:  # told in the row
                return "", f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(b) for b in blobs], columns=["text", "error"])

    return images.withColumn("_told", run(F.col(content))).withColumns({"text": F.col("_told.text"), "error": F.col("_told.error")}).drop("_told")


def long_embedding(embed: Callable[[str], Sequence[float]], text: str, limit: int = MAX_TOKENS) -> list[float]:
    """The vector of a text: the mean of its parts' vectors if it is long, or if the model refuses it as too long."""

    def once(t: str) -> list[float]:
        try:
            return [float(x) for x in embed(t)]
        except Exception as e:
            parts = split_by_tokens(t, min(limit, REFUSED_TOKENS), force=True) if any(x in str(e).lower() for x in TOO_LONG) else []
            if len(parts) < 2:
                raise
            return pooled([[float(x) for x in embed(p)] for p in parts])

    return pooled([once(p) for p in split_by_tokens(text, limit)])


def pooled(vectors: Sequence[Sequence[float]]) -> list[float]:
    """The mean of vectors of one size."""
    return [sum(x) / len(vectors) for x in zip(*vectors)]


def embedded(embed: Callable[[str], Sequence[float]], text: Column, limit: int = MAX_TOKENS) -> Column:
    """array<float>: the vector of each text, an empty one of a blank text."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: long_embedding(embed, t, limit) if t and t.strip() else [])

    return run(text)


def reranked(call: Callable[[str, list[str]], str], query: str, texts: Column, top_k: int | None = None) -> Column:
    """array<struct<index,score>> over an array of texts in the service's order; all texts in their own order with score 1 if it fails.

    call: query and texts -> the service's JSON reply.
    """

    @F.pandas_udf("string")
    def run(batches: pd.Series) -> pd.Series:
        def one(t):
            try:
                return call(query, list(t))
            except Exception:  # the order stays
                return None

        return batches.map(one)

    return rerank_reply(run(texts), F.size(texts), top_k)


def rerank_reply(reply: Column, n: Column, top_k: int | None = None) -> Column:
    """array<struct<index,score>> of a JSON reply {results or data: [{index, relevance_score or score}]}.

    Places that aren't 0 to n - 1 are left out; a score that is no number counts as 0. A reply without any usable place
    gives all n in their order with score 1.
    """
    v = F.try_parse_json(reply)
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    rows = F.coalesce(get(v, "$.results", "array<variant>"), get(v, "$.data", "array<variant>"))
    score = lambda x: F.coalesce(get(x, "$.relevance_score", "double"), F.when(get(x, "$.relevance_score", "string").isNull(), get(x, "$.score", "double")), F.lit(0.0))
    told = F.transform(rows, lambda x: F.struct(F.when(F.schema_of_variant(x).contains("index: BIGINT"), get(x, "$.index", "int")).alias("index"), score(x).alias("score")))
    good = F.filter(told, lambda r: F.coalesce((r["index"] >= 0) & (r["index"] < n), F.lit(False)))
    own = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("index"), F.lit(1.0).alias("score")))).otherwise(F.array().cast("array<struct<index:int,score:double>>"))
    out = F.when(F.size(good) > 0, good).otherwise(own)
    return out if top_k is None else F.slice(out, 1, top_k)


def resolved(chunks: DataFrame, call: Callable[[str], str], prompt: Column, tagged: bool = True, text: str = "text", tries: int = TRIES) -> DataFrame:
    """Adds coreference_raw, resolved_text and coreference_error: a model's replacements, each made on what the last left.

    The text stays as it is if the call fails or its JSON reply (tagged=False) is no list.
    """
    from .replies import json_replacements, tagged_replacements
    from .text import replace_all

    told = chunks.withColumn("_a", answered(call, prompt, tries))
    if tagged:
        told = told.withColumn("_r", F.struct(tagged_replacements(F.col("_a.reply")).alias("items"), F.lit(None).cast("string").alias("error")))
    else:
        told = told.withColumn("_v", first_value(F.col("_a.reply"), "[")).withColumn("_r", json_replacements(F.col("_v"))).drop("_v")
    error = F.coalesce("_a.error", "_r.error")
    return told.withColumns({
        "coreference_raw": F.when(error.isNull(), F.trim("_a.reply")).otherwise(""), "coreference_error": error,
        "resolved_text": F.when(error.isNull(), replace_all(F.col(text), F.col("_r.items"))).otherwise(F.col(text)),
    }).drop("_a", "_r")
