"""Events of documents by a text model: resolve, part into sentences, events of each sentence, events of the document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import strip
from ..session import small_batches

#: What a stage asks for; its input follows.
PROMPTS = {
    "resolve": 'Name left-out subjects and replace references by what they refer to. Reply with JSON only: {"resolved_text": "..."}, the text as it is if nothing can be done.\n\n',
    "segment": 'Part the text into sentences. Reply with JSON only: {"sentences": [{"id": "...", "sentence": "..."}]}.\n\n',
    "extract": "Give the events of the sentence with the roles of their participants. Reply with JSON only.\n\n",
    "aggregate": "Join the events of the sentences into events of the document. Reply with JSON only.\n\n",
    "whole": "Extract the events of the text. Reply with one JSON object with the keys preprocess, segmentation, sentence_events and aggregated.\n\n",
}
#: Keys of the reply that gives all stages at once.
WHOLE = ("preprocess", "segmentation", "sentence_events", "aggregated")
#: What a prompt is followed by once its reply was no JSON value.
AGAIN = "\n\nReply with the JSON value alone: no tool calls, no explanation."
_EMPTY = "the text is empty"


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _told(v: Column, path: str) -> Column:
    """A member as text; null if it is absent, null, empty or zero."""
    value = F.try_variant_get(v, path, "string")
    return F.when((value != "") & ~((_kind(v, path) == "BIGINT") & (value == "0")), value)


def sentence_events(docs: DataFrame, call: Callable[[str], str], keys: Sequence[str] = ("doc_id",), text: str = "text", tries: int = 5, wait: float = 2.0) -> DataFrame:
    """(keys, resolved_text, preprocess, segmentation, sentence_events, aggregated, error), a row for each document.

    The keys tell documents apart. Sentences are asked for apart from each other, in as many tasks as there are; those
    without id or words are left out. A reply without resolved text leaves the text as it is. The first failure of a
    document is its error, and later stages aren't asked for; a null or blank text fails at once. Replies stay JSON text,
    events stand in the order of their sentences.
    """
    small_batches(docs.sparkSession)

    def ask(test: Column, *parts: Column | str) -> Column:
        return models.answered_json(call, F.when(test, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))), (), tries, wait, AGAIN)

    fine = F.col("error").isNull()
    own = strip(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(*keys, own.alias("_text")).withColumn("_a", ask(F.col("_text") != "", PROMPTS["resolve"], F.col("_text")))
    v = F.try_parse_json("_a.reply")
    resolved = F.when(_kind(v, "$.resolved_text") == "STRING", strip(F.try_variant_get(v, "$.resolved_text", "string")))
    no_object = F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "the resolved text came as no object")
    d = d.select(
        *keys, F.col("_a.reply").alias("preprocess"), F.coalesce(F.nullif(resolved, F.lit("")), "_text").alias("resolved_text"),
        F.coalesce(F.when(F.col("_text") == "", _EMPTY), "_a.error", no_object).alias("error"),
    )
    d = d.withColumn("_a", ask(fine, PROMPTS["segment"], F.col("resolved_text")))
    found = F.try_variant_get(F.try_parse_json("_a.reply"), "$.sentences", "array<variant>")
    usable = F.filter(F.transform(found, lambda s: F.struct(_told(s, "$.id").alias("id"), _told(s, "$.sentence").alias("sentence"))), lambda s: s["id"].isNotNull() & s["sentence"].isNotNull())
    none = F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, "no sentences came")
    d = d.select(*keys, "preprocess", "resolved_text", F.col("_a.reply").alias("segmentation"), F.coalesce("error", "_a.error", none).alias("error"), usable.alias("_s"))
    carried = ("preprocess", "resolved_text", "segmentation", "error")
    one = d.select(*keys, *carried, F.posexplode_outer(F.when(fine, F.col("_s"))).alias("_pos", "_s"))
    # the document's own texts go with its first row alone: with each sentence they would grow with the square of its length
    one = one.withColumns({c: F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col(c)) for c in carried})
    one = one.repartition(*keys, "_pos").withColumn("_a", ask(F.col("_s").isNotNull(), PROMPTS["extract"], "sentence_id: ", F.col("_s.id"), "\nsentence: ", F.col("_s.sentence")))
    back = one.groupBy(*keys).agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in carried),
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.col("_a.reply").alias("reply"), F.col("_a.error").alias("error"))))).alias("_e"),
    )
    failed = F.get(F.filter("_e", lambda e: e["error"].isNotNull()), 0)["error"]
    back = back.withColumns({"error": F.coalesce("error", failed), "sentence_events": F.transform("_e", lambda e: e["reply"])})
    back = back.withColumn("_a", ask(fine, PROMPTS["aggregate"], "resolved_text: ", F.col("resolved_text"), "\nsentence_events: [", F.array_join("sentence_events", ", "), "]"))
    return back.select(*keys, "resolved_text", "preprocess", "segmentation", "sentence_events", F.col("_a.reply").alias("aggregated"), F.coalesce("error", "_a.error").alias("error"))


def whole_events(docs: DataFrame, call: Callable[[str], str], keys: Sequence[str] = ("doc_id",), text: str = "text", tries: int = 5, wait: float = 2.0) -> DataFrame:
    """(keys, preprocess, segmentation, sentence_events, aggregated, error): one reply for a document, each member as JSON text.

    A reply that lacks a member is asked for again and fails at last; a null or blank text fails at once.
    """
    small_batches(docs.sparkSession)
    own = strip(F.coalesce(F.col(text), F.lit("")))
    prompt = F.when(F.col("_text") != "", F.concat(F.lit(PROMPTS["whole"]), "_text"))
    told = docs.select(*keys, own.alias("_text")).withColumn("_a", models.answered_json(call, prompt, WHOLE, tries, wait, AGAIN))
    v = F.try_parse_json("_a.reply")
    members = [F.to_json(F.try_variant_get(v, f"$.{k}", "variant")).alias(k) for k in WHOLE]
    return told.select(*keys, *members, F.coalesce(F.when(F.col("_text") == "", _EMPTY), "_a.error").alias("error"))
