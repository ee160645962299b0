"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

Each stage gets what its predecessor kept, as written Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontaminate, jaccard_join, pii, piece_bpe, toxicity
from lorebase.llm.queries import MODEL


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5, learnt on the labelled ones outside the held-out fold.

    Each row is judged by its own text: repeated ids and rows stay or go one by one. Null and empty texts score by the
    bias; without labels all score 0.5 and go, so an empty label table keeps every row instead.
    """
    model = toxicity.fit(toxicity.train_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    if model.bias == 0 and not len(model.bucket):
        return docs
    score = f"score_{uuid.uuid4().hex}"  # docs may have any column
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), name=score)
    return scored.filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that with the smallest doc_id (ties and rows without id: `one_of_each`).

    Rows without words (null, empty or blank text) are linked with nothing and stay. Empty tables give no rows.
    """
    return jaccard_join.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contamination rule clears, each by its own text; one without words is clean, as are all without items."""
    tag = uuid.uuid4().hex
    found = decontaminate.marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tag=tag)
    clean = found.filter(~decontaminate.contaminated(n_hit=f"__n_hit{tag}", n_words=f"__n_words{tag}"))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts masked and n_chars counted anew; null texts and their counts stay."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: their number, and digests of the ids and of the decoded text; a null text is empty."""
    return piece_bpe.digests(docs, MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: A trained model, links and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    from lorebase.llm.runtime import prepare, unlink

    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if i:
                unlink(spark, before)  # nothing reads what the stage before it kept any more
            before = path
    return docs
