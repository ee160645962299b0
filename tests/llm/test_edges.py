"""Null, empty and very long texts, ties, repeated rows, empty tables and clashing columns, through the pipeline and the fingerprints."""

import numpy as np
import pytest

import corpus_pipeline
from lorebase.llm import chroma

LABELS = "doc_id long, toxic int, quality int"
ITEMS = "item_id string, text string"
#: Columns of documents, with others that the stages' own columns are called like.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, label int, n_hit long, n_words long, media_id long, print string, n int, away boolean, __spans string, __n_hit int, __n_words int, __items string, __score double, __id long, __hash long, __text_hash long, component long, first int"


def rows_of():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    same, item = say(60), say(30)
    texts = [(1, same), (1, same), (2, same + " end"), (3, None), (None, None), (4, ""), (5, " \n\t"), (None, say(40)), (6, f"{item} {say(5)}"), (6, say(50)), (7, say(60_000)), (8, "mail a@b.cd now " + say(20)), (8, "mail a@b.cd now other " + say(20))]
    return [(i, t, None, "x", None if t is None else len(t), 0.5, "s", 1, 2, 3, 4, "p", 5, True, "s", 1, 2, "i", 0.5, 6, 7, 8, 9, 10) for i, t in texts], item


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows, item = rows_of()
    out = {}
    for name, docs, labels, items in (("full", rows, [(1, 0, 1), (2, None, 1), (None, 1, 1)], [("a", item), ("a", item), (None, None), ("b", "")]), ("empty", [], [], [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
        out[name] = folder
    return out


def test_pipeline_edges(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    gone = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs.collect(), docs.columns
        out = stage(spark, docs, folders["full"])
        assert i + 1 == len(corpus_pipeline.STAGES) or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        gone[name] = len(before) - docs.count()
        if name == "pii":
            assert sorted(r.text for r in docs.collect() if r.doc_id == 8)[0].startswith("mail <EMAIL> now ") and {r.n_chars for r in docs.filter("text is null").collect()} == {None}
    # of the repeated row and its near copy one stays; the contaminated row goes, the clean one of its id stays
    assert gone["toxicity"] == 0 and gone["ngram_jaccard_join"] == 2 and gone["benchmark_decontamination"] == 1 and gone["pii"] == gone["sentencepiece"] == 0
    assert docs.filter("doc_id = 6").count() == 1 and docs.filter("doc_id is null").count() == 2 and docs.filter("n_tokens = 0").count() >= 3


def test_pipeline_of_empty_tables(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0


def test_fingerprint_edges(spark, folders):
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    prints = chroma.fingerprints(docs, chroma.BYTES_AS_SOUND, "text", "doc_id")
    got = prints.collect()
    assert prints.columns == ["media_id", "print", "n"] and len(got) == docs.count()
    assert {r.n for r in got if r.media_id in (3, 4)} == {0} and max(r.n for r in got) > 10_000
    twice = [r.print for r in got if r.media_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    kinds = [(r.class_id, r.copies) for r in chroma.classes(prints).collect()]  # ids 6 and 8 each name two
    assert (1, 2) in kinds and sum(c for _, c in kinds) == sum(r.n > 0 for r in got)
    assert chroma.aligned(prints, every=1).filter("class_id = match_id").count() == 0
    found = {(r.class_id, r.match_id) for r in chroma.aligned(prints, every=1).collect()}
    assert (1, 2) in found and (2, 1) in found


def plain_integers(frames, levels):
    """`pack` by sums over each area, frame by frame."""
    out = []
    for x in range(len(frames) - chroma.WIDTH + 1):
        value = 0
        for (kind, y, h, w), cuts in zip(chroma.FILTERS, levels):
            area = frames[x : x + w, y : y + h]
            first, second = area[: w // 2], area[w // 2 :]
            if kind == 0:
                a, b = area[:, : h // 2].sum(), area[:, h // 2 :].sum()
            elif kind == 1:
                a, b = first.sum(), second.sum()
            elif kind == 2:
                a = first[:, : h // 2].sum() + second[:, h // 2 :].sum()
                b = area.sum() - a
            else:
                a = area[w // 4 : w // 4 + w // 2].sum()
                b = area.sum() - a
            ratio = np.log((1 + a) / (1 + b))
            value = value << 2 | [0, 1, 3, 2][sum(ratio > c for c in cuts)]
        out.append(value)
    return out


def test_integers_match_plain_sums():
    rng = np.random.default_rng(12)
    for n in (0, 11, 12, 13, 60):
        frames = rng.random((n, 12))
        assert chroma.pack(frames).tolist() == plain_integers(frames, chroma.LEVELS)
        assert chroma.pack(frames, chroma.BYTES_AS_SOUND.levels).tolist() == plain_integers(frames, chroma.BYTES_AS_SOUND.levels)
