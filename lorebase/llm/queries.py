"""The queries opN_<name> of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, decontaminate, jaccard_join, license_scan, mixing, pii, piece_bpe, secret_scan, sharding, token_align, toxicity, url_rules, vector_codes
from .oracle import ORACLE_SQL  # noqa: F401
from .runtime import cut

try:
    import public_tokenizers

    MODEL, BYTE_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # the package isn't on this machine's path: the place where its files are kept
    MODEL, BYTE_BPE = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: str, kinds: tuple[str, ...] | None = None):
    """kind:start:end of spans (already by start and kind), comma-joined."""
    some = spans if kinds is None else f"filter({spans}, s -> s.kind in ({', '.join(map(repr, kinds))}))"
    return F.expr(f"array_join(transform({some}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def _span_digests(found: DataFrame, base: tuple[str, ...], more: tuple[str, ...], *kept: str) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in (*base, *more)]
    return found.select("doc_id", *counts[: len(base)], F.sha2(_joined("spans", base).cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), *counts[len(base) :], *kept)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_documents(spark, sf_dir), license_scan.known_digests(spark))
    return found.select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(toxicity.train_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def op3_chroma_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has sound, so each text is played: its UTF-8 bytes are the samples of a recording.

    One row for each document; those divisible by 50 are queries, with all alignments of their class
    (id:offset:votes:errors, fewest errors first).
    """
    prints = cut(chroma.fingerprints(_documents(spark, sf_dir), chroma.BYTES_AS_SOUND, "text", "doc_id"))
    told = F.concat_ws(":", "match_id", "offset", "votes", F.format_number("bit_errors", 4))
    best = F.array_sort(F.collect_list(F.struct("bit_errors", (-F.col("votes")).alias("fewer"), "match_id", told.alias("told"))))
    found = chroma.aligned(prints, near=True).groupBy("class_id").agg(best.alias("m"))
    base = prints.select(F.col("media_id").alias("doc_id"), F.col("n").cast("long").alias("n_integers"), F.sha2("print", 256).alias("digest"))
    # a class has its alignments once, and gives them to all its queries
    # a table of its own: the next join then has no aggregate in its stage, and a class of very many copies can be split
    kinds = cut(chroma.classes(prints).join(found, "class_id", "left"))
    # recordings without integers have no class: they stay out of the join, as they may be most of all
    heard = base.filter("n_integers > 0").join(kinds, "digest", "left").withColumn("m", F.when(F.col("doc_id") % 50 == 0, F.col("m")))
    out = heard.unionByName(base.filter("n_integers = 0"), allowMissingColumns=True)
    return out.select("doc_id", "n_integers", F.col("digest").alias("print_sha256"), "class_id", "copies", F.expr("array_join(transform(m, x -> x.told), ',')").alias("matches"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard_rows(rows, "doc_id", [1.0] * 8, grown="grown_shard", tie=("text_crc32", "size"), spread=F.shiftrightunsigned("text_crc32", 24))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_pii(_documents(spark, sf_dir)), pii.BASE, pii.KINDS[len(pii.BASE) :])


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op7_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir))
    scored = found.withColumn("novelties", F.expr("array_join(transform(spans, s -> s.novelty), ',')"))  # one for each of spans
    return _span_digests(scored, secret_scan.BASE, secret_scan.KINDS[len(secret_scan.BASE) :], "novelties")


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(_documents(spark, sf_dir), MODEL)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.compare(_documents(spark, sf_dir), BYTE_BPE, MODEL)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_errors(found.codes).select("vec_id", "code", "error", "label_error", F.lit(found.books.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_toxicity_ftrl, op3_chroma_fingerprint, op4_rendezvous_shards, op5_pii_spans,
        op6_benchmark_decontamination, op7_secret_novelty, op8_sentencepiece_codec, op9_url_rules, op10_ngram_jaccard_join,
        op11_mix_sources, op12_token_alignment, op13_vector_codes,
    )
}
