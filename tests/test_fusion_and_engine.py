"""Fusion level by level, seeds by alias, reranked hits and coreference in the build."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.functions.chunker import Limits, packed
from lorebase.operators import document_fusion, resolution
from lorebase.plans.engine import Engine
from lorebase.sources.store import Store


def merge(prompt):
    """An associative model: one entity of each first letter, the greatest description, the names it has swallowed."""
    best = {}
    for r in json.loads(prompt):
        have = best.setdefault(r["name"][0], {"canonical_name": r["name"][0], "type": "T", "description": "", "aliases": []})
        have["description"] = max(have["description"], r["description"])
        have["aliases"].append(r["name"])
    return json.dumps(list(best.values()))


@pytest.mark.parametrize("budget", [700, 3_000, 30_000])
def test_any_split_gives_the_same(spark, budget):
    longest = spark.sparkContext.accumulator(0)

    def asked(prompt):
        longest.add(len(prompt) > budget)
        return merge(prompt)

    rng = np.random.default_rng(6)
    rows = [(c, i, "abcd"[int(rng.integers(4))] + str(i), "x", f"d{int(rng.integers(1000)):04d}") for i in range(200) for c in ["hot" if i % 3 else f"c{i % 4}"]] + [("one", 900, "a900", "x", "only")]
    found = resolution.fuse_tree(spark.createDataFrame(rows, "cluster string, seq long, name string, type string, description string").repartition(3), ["cluster"], asked, budget).collect()
    want = {}
    for c, _, n, _, d in rows:
        have = want.setdefault((c, n[0]), ["", set()])
        have[0], have[1] = max(have[0], d), have[1] | {n}
    assert {(r.cluster, r.canonical_name): r.description for r in found} == {k: v[0] for k, v in want.items()} and len(found) == len(want)
    assert all(set(r.aliases) >= want[r.cluster, r.canonical_name][1] for r in found)  # no alias of any level is lost
    assert longest.value == 0


def test_a_model_that_merges_nothing_ends(spark):
    same = lambda p: json.dumps([{"canonical_name": r["name"], "type": "T", "description": r["description"]} for r in json.loads(p)])
    rows = [("c", i, f"n{i % 30}", "x", f"d{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "cluster string, seq long, name string, type string, description string")
    found = resolution.fuse_tree(frame, ["cluster"], same, 300).collect()
    assert sorted(r.canonical_name for r in found) == sorted({f"n{i}" for i in range(30)})
    broken = resolution.fuse_tree(frame, ["cluster"], lambda p: "no", 300, tries=1).collect()  # each part is fused by name instead
    assert sorted(r.canonical_name for r in broken) == sorted({f"n{i}" for i in range(30)})
    assert resolution.fuse_tree(frame.limit(0), ["cluster"], same, 300).count() == 0


def test_packed():
    rng = np.random.default_rng(7)
    for _ in range(300):
        sizes, most, least = rng.integers(0, 9, rng.integers(0, 15)).tolist(), int(rng.integers(1, 15)), int(rng.integers(0, 12))
        want, i = [], 0
        while i < len(sizes):
            j = i + 1
            while j < len(sizes) and not (sum(sizes[i : j + 1]) > most and sum(sizes[i:j]) >= least):
                j += 1
            want.append((i, j))
            i = j
        assert packed(sizes, most, least) == want


def test_engine_seams(spark, tmp_path):
    def extract(text):
        names = [w for w in text.split() if w[:1].isupper()]
        return "\n".join([*(f"entity<|SEP|>{n}<|SEP|>Name<|SEP|>about {n}" for n in names), *(f"relation<|SEP|>{a}<|SEP|>{b}<|SEP|>next<|SEP|>near<|SEP|>5" for a, b in zip(names, names[1:])), "<|DONE|>"])

    def coreference(text):
        return "<|item_start|><|raw_start|>it<|raw_end|><|result_start|>Alpha<|result_end|><|item_end|>" if " it" in text else ""

    engine = Engine(Store(spark, str(tmp_path), 2), extract=extract, limits=Limits(50, 1), tries=1, coreference=coreference, rerank=lambda q, texts: [len(t) for t in texts])
    engine.ingest(spark.createDataFrame([("g", "1", "n", "t", "Beta and it"), ("g", "2", "n", "t", "Gamma and Beta again")], "group_id string, doc_id string, doc_name string, doc_time string, text string"))
    # the second end is in the resolved text only; the chunk itself is as it was
    assert {(r.subject, r.object) for r in engine.store.read("relations").collect()} == {("Beta", "Alpha"), ("Gamma", "Beta")}
    assert {r.resolved_text for r in engine.store.read("chunk_checkpoints").collect()} == {"Beta and Alpha", "Gamma and Beta again"}
    assert {r.text for r in engine.store.read("chunks").collect()} == {"Beta and it", "Gamma and Beta again"}
    hits = engine.search("chunks_keyword", "g", "beta and")
    assert [r.doc_id for r in engine.reranked(hits, "beta and", 1).collect()] == ["2"]
    assert [r.doc_id for r in Engine(engine.store, rerank=lambda q, t: 1 / 0).reranked(hits, "x").collect()] == [r.doc_id for r in hits.collect()]
    # a seed by alias, on the group's level and on a document's
    level = engine.store.read("global_entities").withColumn("aliases", F.when(F.col("canonical_name") == "Beta", F.array(F.lit("B."))).otherwise(F.col("aliases")))
    engine.store.upsert("global_entities", level)
    assert {r.node for r in engine.expand("g", [" B. "], 1).filter("seed = 'Beta'").collect()} == {"Alpha", "Gamma"}
    assert {r.node for r in engine.expand("g", ["Beta"], 1, doc_id="1").collect()} == {"Alpha"}


def merge_by_stem(prompt):
    """A model that takes names of one first word for one entity, and tells the names it has swallowed."""
    best = {}
    for r in json.loads(prompt):
        have = best.setdefault(r["name"].split("_")[0], {"canonical_name": r["name"].split("_")[0], "type": "", "description": "", "aliases": []})
        have["type"] = have["type"] or r.get("type", "")  # nulls are left out of a prompt
        have["description"] = max(have["description"], r.get("description", ""), key=len)
        have["aliases"].append(r["name"])
    return json.dumps(list(best.values()))


def vector_of(text):
    """Names of one first word lie close, others far."""
    stem, _, rest = text.split("\n")[0].partition("_")
    return [100.0 * len(stem), 100.0 * ord(stem[0]), len(rest) / 10 + ord(rest[-1:] or "a") / 1000]


def test_fuse_by_meaning(spark):
    rows = [("d1", 1, "Acme", "Org", "x"), ("d1", 2, "Acme_Ltd", "", "longer text"), ("d1", 3, "Acme_Co", "Org", None), ("d1", 4, "Zoo", None, "z"), ("d1", 5, " ", "Org", "no name"),
            ("d2", 1, "Acme_Ltd", "Firm", "other document"), ("d1", 6, "Borough_A", "Place", "b"), ("d1", 7, "Borough_B", "Place", "bb"), ("d1", 8, "Zoo", "Place", "zoo")]
    frame = spark.createDataFrame(rows, "doc string, seq int, name string, type string, description string")
    asked = spark.sparkContext.accumulator(0)

    def call(prompt):
        asked.add(1)
        return merge_by_stem(prompt)

    got = {(r.doc, r.canonical_name): r for r in document_fusion.fuse_by_meaning(frame, ["doc"], vector_of, call).collect()}
    assert set(got) == {("d1", "Acme"), ("d1", "Zoo"), ("d1", "Borough"), ("d2", "Acme")}
    acme = got["d1", "Acme"]
    assert (acme.type, acme.description, acme.seq, acme.aliases) == ("Org", "longer text", 1, ["Acme", "Acme_Co", "Acme_Ltd"])
    assert got["d1", "Zoo"].type == "Place" and got["d2", "Acme"].description == "other document"
    assert asked.value == 4  # three clusters of d1, one of d2
    broken = document_fusion.fuse_by_meaning(frame, ["doc"], vector_of, lambda p: "no", tries=1).collect()
    assert sorted((r.doc, r.canonical_name) for r in broken) == sorted({(d, n) for d, _, n, _, _ in rows if n.strip()})
    assert document_fusion.fuse_by_meaning(frame.limit(0), ["doc"], vector_of, call).count() == 0


def test_one_of_each_name(spark):
    rows = [("d", "A", " ", ["x"], "long text", 4), ("d", "A", "T", ["y", "x"], "short", 9), ("d", "A", "U", None, None, 12), ("e", "A", None, [], None, 1)]
    got = {r.doc: tuple(r)[1:] for r in document_fusion.one_of_each_name(spark.createDataFrame(rows, "doc string, canonical_name string, type string, aliases array<string>, description string, seq int"), ["doc"]).collect()}
    assert got == {"d": ("A", "T", ["x", "y"], "long text", 4), "e": ("A", "Unknown", [], None, 1)}


def test_engine_fuses_by_meaning(spark, tmp_path):
    """Relations, mentions and the group's level follow the fused names; without a fusion model names decide."""

    def extract(text):
        names = [w for w in text.split() if w[:1].isupper()]
        return "\n".join([*(f"entity<|SEP|>{n}<|SEP|>Name<|SEP|>about {n}" for n in names), *(f"relation<|SEP|>{a}<|SEP|>{b}<|SEP|>next<|SEP|>near<|SEP|>5" for a, b in zip(names, names[1:])), "<|DONE|>"])

    docs = spark.createDataFrame([("g", "1", "n", "t", "Acme_Ltd sees Zoo then Acme_Co")], "group_id string, doc_id string, doc_name string, doc_time string, text string")
    for fusion, names, pairs in ((merge_by_stem, ["Acme", "Zoo"], {("Acme", "Zoo"), ("Zoo", "Acme")}), (None, ["Acme_Co", "Acme_Ltd", "Zoo"], {("Acme_Ltd", "Zoo"), ("Zoo", "Acme_Co")})):
        engine = Engine(Store(spark, str(tmp_path / str(fusion is None)), 2), embed=vector_of, extract=extract, limits=Limits(50, 1), tries=1, fusion=fusion)
        engine.ingest(docs)
        assert sorted(r.canonical_name for r in engine.store.read("entities").collect()) == names
        assert {(r.subject, r.object) for r in engine.store.read("relations").collect()} == pairs
        if fusion:
            assert {r.canonical_name for r in engine.store.read("global_entities").filter(F.array_contains("aliases", "Acme_Co")).collect()} == {"Acme"}
