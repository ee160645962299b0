"""The corpus pipeline against a brute-force version, stage by stage on its own input."""

import hashlib

import pytest

import corpus_pipeline
from lorebase.llm import pii
from lorebase.llm.queries import MODEL

from .brute import brute_components, brute_contamination


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slurs = "idiot scum trash moron clown".split()
    more = [(5000 + i, f"plain words number {i} here {slurs[i % 5]} {slurs[(i + 1) % 5]} and on {i * 7} " * 3, "en", "x", 9) for i in range(80)]
    more += [(6000 + i, f"plain words number {i} here again and on {i * 7} it goes so {i * 3} " * 3, "en", "x", 9) for i in range(80)]
    more += [(7000, None, "en", "x", None), (7001, "", None, "x", 0), (7002, "write to a@b.cd", "en", None, 15)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(i, 1, int(i < 6000)) for i, *_ in more[:160]], labels.schema)).write.parquet(f"{out}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r.asDict() for r in docs.collect()}
        kept.append(len(after))
        if name == "toxicity":
            assert columns == docs.columns and {5000 + k for k in range(80)}.isdisjoint(after) and {6000 + k for k in range(80)} <= set(after)
        elif name == "ngram_jaccard_join":
            stay = {a for a, _, low in brute_components([(k, v["text"]) for k, v in before.items()]) if a == low}
            assert set(after) == stay
        elif name == "benchmark_decontamination":
            told = {k: brute_contamination(v["text"], items) for k, v in before.items()}
            assert set(after) == {k for k, (n, hit, _) in told.items() if not (hit > 0 and 20 * hit >= n)}
        elif name == "pii":
            assert {k: v["text"] for k, v in after.items()} == {k: pii.redacted(v["text"]) for k, v in before.items()}
            assert after[7002]["text"] == "write to <EMAIL>" and after[7002]["n_chars"] == 16
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            for k, v in before.items():
                ids = sp.encode(v["text"] or "")
                assert (after[k]["n_tokens"], after[k]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert kept == sorted(kept, reverse=True) and {7000, 7001, 7002} <= set(after)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {tuple(r) for r in docs.collect()}
