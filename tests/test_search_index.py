"""Keyword search by postings, nearest vectors by cells, lists in the engine: against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.functions.chunker import Limits
from lorebase.operators import ann, cells, keyword_index, search
from lorebase.plans.engine import Engine, hash_embedding
from lorebase.sources.store import Store

DOCS = "group_id string, doc_id string, doc_name string, doc_time string, text string"


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    words = ["version", "License", "of", "a", "zu", "data-base", "naïve", "数据", "库", "x_y", "50%", "end.", "Versionen", "conversion", "re:lease", "…", "b2b"]
    rows = [("g" if i % 5 else "h", str(i % 23), f"c{i}", i, " ".join(rng.choice(words, int(rng.integers(0, 9))))) for i in range(260)]
    rows += [("g", "1", "long", 300, "version " * 400), ("g", "2", "blank", 301, ""), ("g", "none", "lost", 302, "license version"), ("g", "3", "null", 303, None)]
    chunks = spark.createDataFrame(rows, "group_id string, doc_id string, chunk_id string, chunk_index int, text string").cache()
    docs = spark.createDataFrame([(g, str(i), f"2024-{1 + i % 12:02d}-01") for g in "gh" for i in range(23)], "group_id string, doc_id string, doc_time string").cache()
    return chunks, docs, keyword_index.postings(chunks).cache()


@pytest.mark.parametrize("query", ["license version", "Version", "of", "a zu", "数据", "数据库 version", "50%", "x_y", "…", "data-base, b2b", "nothing here", "%", "version " * 12])
def test_same_as_scoring_every_chunk(texts, query):
    chunks, docs, index = texts
    for where in ({}, {"doc_id": "1"}, {"start": "2024-03-01", "end": "2024-08-01"})[: 3 if query in ("license version", "50%") else 1]:
        want = search.chunks_keyword(chunks, docs, "g", query, 7, **where).collect()
        assert keyword_index.search(index, chunks, docs, "g", query, 7, first=9, **where).collect() == want
    if query == "license version":
        told = keyword_index.plan(index, chunks, docs, "g", query, 7, first=9)
        assert told.looked_at().count() < told.candidates.count() < search.in_group(chunks, "g").count()


def test_keyword_edges(texts):
    chunks, docs, index = texts
    assert keyword_index.search(index, chunks, docs, "g", "  ").count() == 0
    assert keyword_index.search(index, chunks, docs, "absent", "version").count() == 0
    assert keyword_index.search(index.limit(0), chunks.limit(0), docs, "g", "version").count() == 0
    with pytest.raises(ValueError):
        keyword_index.search(index, chunks, docs, " ", "version")
    # grams at a pattern's own ends are not asked for, as the word may go on there
    assert keyword_index.inner_grams("ersion v", ["ersion", "v"]) == {"ers", "rsi", "sio", "ion", "on ", "  v"}


def plain_grams(words):
    return sorted({f"  {w} "[i : i + 3] for w in words or [] for i in range(len(w) + 1)})


@pytest.mark.parametrize("piece", [5, 40, 1 << 20])
def test_trigrams_of_word_lists(monkeypatch, piece):
    """Flat arrays, a bounded number of trigrams at once: rows that go over pieces, nulls, characters beyond 16 bits."""
    monkeypatch.setattr(keyword_index, "PIECE", piece)
    rng = np.random.default_rng(4)
    words = ["aaaa", "b", "数据库", "naïve", "𝒳y", *("".join(rng.choice(list("abcé数𝒳7"), int(rng.integers(1, 9)))) for _ in range(90))]
    rows = [list(dict.fromkeys(rng.choice(words, int(rng.integers(0, 12))).tolist())) if i % 7 else None for i in range(60)] + [words, [], None]
    held, codes = keyword_index._held(pa.array(rows, pa.list_(pa.string())).slice(1))
    got = [[] for _ in rows[1:]]
    for row, gram in zip(held, keyword_index._told(codes).to_pylist()):
        got[row].append(gram)
    assert [sorted(x) for x in got] == [plain_grams(x) for x in rows[1:]]
    assert all(len(keyword_index._held(pa.array(x, pa.list_(pa.string())))[0]) == 0 for x in ([], [None], [[]]))


def test_postings_are_made_once_in_small_batches(spark, texts):
    """The function stands in the plan once, and its batches don't grow with the table."""
    made = keyword_index.postings(texts[0])
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    want = {(r.group_id, r.chunk_id): plain_grams(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in texts[0].collect()}
    got = {k: [] for k in want}
    for r in made.collect():
        got[r.group_id, r.chunk_id].append(r.gram)
        assert r.n == len(want[r.group_id, r.chunk_id])
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("table", [8, 1 << 21])
def test_frequencies_are_counts_of_postings(spark, monkeypatch, table):
    """Tasks count in bounded tables: no row for each posting goes to the sum, and full tables lose nothing."""
    monkeypatch.setattr(keyword_index, "TABLE", table)
    rng = np.random.default_rng(5)
    words = ["version", "License", "数据", "aaaa", "x_y", "50%", "…"]
    rows = [(None if i % 9 == 0 else "gh"[i % 2], str(i), f"c{i}", " ".join(rng.choice(words, int(rng.integers(0, 6)))) if i % 8 else None) for i in range(300)]
    chunks = spark.createDataFrame(rows, "group_id string, doc_id string, chunk_id string, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    made = keyword_index.frequencies(chunks)
    assert "explode" not in made._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    got = sorted(map(tuple, made.collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == sorted(map(tuple, keyword_index.postings(chunks).groupBy("group_id", "gram").count().collect()), key=repr)
    assert keyword_index.frequencies(chunks.limit(0)).count() == 0


def plain_nearest(queries, rows, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = []
    for q, by, v in queries:
        if v is None or not len(v) or not np.linalg.norm(v):
            continue
        near = [(-np.floor(unit(v) @ unit(w) * 1e6 + 0.5) / 1e6, tie, key) for key, tie, other, w in rows if other == by and w is not None and len(w) == len(v) and None not in w and np.linalg.norm(w)]
        out += [(q, key, place, round(float(-s), 6)) for place, (s, _, key) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_cells(spark, monkeypatch, k):
    monkeypatch.setattr(cells, "PART_ROWS", 40)
    monkeypatch.setattr(cells, "PART_QUERIES", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 8))
    make = lambda n: [(centre[rng.integers(9)] + 0.2 * rng.normal(size=8)).tolist() for _ in range(n)]
    rows = [(f"k{i}", i, "ab"[i % 3 == 0], v) for i, v in enumerate(make(300))]
    rows += [(f"copy{i}", 1000 + i, "a", rows[1][3]) for i in range(200)]  # a hot group of copies
    rows += [("null", 2000, "a", None), ("empty", 2001, "a", []), ("zero", 2002, "a", [0.0] * 8), ("short", 2003, "a", [1.0, 2.0]), ("hole", 2004, "a", [None] + [1.0] * 7)]
    queries = [(i, "abc"[i % 3], v) for i, v in enumerate(make(40))] + [(100, "a", rows[1][3]), (101, "a", None), (102, "b", []), (103, "a", [2.0, 4.0])]
    q = spark.createDataFrame(queries, "query long, kind string, vector array<double>")
    r = spark.createDataFrame(rows, "key string, tie long, kind string, vector array<double>")
    found = cells.nearest(q, r, k, ["kind"], probes=2)
    assert sorted((x.query, x.key, x.place, round(x.score, 6)) for x in found.hits.collect()) == plain_nearest(queries, rows, k)
    every = sum(sum(1 for _, _, b, w in rows if b == by and w and len(w) == len(v) and None not in w and any(w)) for _, by, v in queries if v)
    assert 0 < found.pairs() < 0.8 * every  # cells that can't be nearer aren't looked into
    assert cells.nearest(q.limit(0), r, k, ["kind"]).hits.count() == cells.nearest(q, r.limit(0), k, ["kind"]).hits.count() == 0


def test_bounded_lists_are_exact(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 16)) * 2
    x = (centre[rng.integers(0, 20, 1200)] + 0.3 * rng.normal(size=(1200, 16))).astype(np.float32)
    rows = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "pk string, embedding array<float>")
    c = ann.fit(rows, "pk", 40)
    index = ann.build(rows, c).cache()
    reach = {r["list"]: (r["radius"], r["longest"]) for r in ann.radii(index, c, ["list"]).collect()}
    read = []
    for q in range(0, 1200, 100):
        lists = ann.bounded(index, c, reach, x[q].tolist(), 10, probes=2)
        got = search.vector_top(index.filter(F.col("list").isin(lists)), x[q].tolist(), 10, "pk", ["pk"]).collect()
        want = search.vector_top(index, x[q].tolist(), 10, "pk", ["pk"]).collect()
        assert got == want
        read.append(len(lists) - 1)
    assert max(read) < 40 and np.mean(read) < 20
    assert ann.bounded(index.limit(3), c, reach, x[0].tolist(), 10) is None  # too few rows: all are read


def namer(text):
    names = [w for w in text.split() if w[:1].isupper()]
    lines = [f"entity<|SEP|>{n}<|SEP|>Name<|SEP|>about {n}" for n in names]
    lines += [f"relation<|SEP|>{a}<|SEP|>{b}<|SEP|>next<|SEP|>near<|SEP|>5" for a, b in zip(names, names[1:])]
    return "\n".join([*lines, "<|DONE|>"])


def test_replaced_document_takes_its_graph_along(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def embed(text):
        (asked / f"{abs(hash(text))}-{len(list(asked.iterdir()))}").write_text(text)
        return hash_embedding(text)

    engine = Engine(Store(spark, str(tmp_path / "store"), 2), embed=embed, extract=namer, limits=Limits(50, 1), tries=1)
    one = lambda i, t: spark.createDataFrame([("g", i, "n", "t", t)], DOCS)
    rows = lambda t, *c: {tuple(r) for r in engine.store.read(t).select(*c).collect()}
    engine.ingest(one("1", "Alpha meets Beta"))
    engine.ingest(one("2", "Beta sees Gamma"))
    known = {p.name for p in asked.iterdir()}
    engine.fit_lists(3)
    assert {r[0] for r in rows("graph_index", "list")} <= {0, 1, 2} and {p.name for p in asked.iterdir()} == known
    engine.ingest(one("1", "Delta sleeps"))
    new = [p.read_text() for p in asked.iterdir() if p.name not in known]
    # Beta and its relation to Gamma stand on document 2 and are as they were: no model is asked about them again
    assert all("Delta" in t for t in new) and len(new) == 4  # the chunk, the entity to be aligned, and its two index rows
    assert rows("global_entities", "canonical_name") == {("Beta",), ("Gamma",), ("Delta",)}
    assert rows("global_relations", "subject", "object") == {("Beta", "Gamma")}
    assert rows("entities", "doc_id", "canonical_name") == {("1", "Delta"), ("2", "Beta"), ("2", "Gamma")}
    assert not {r for r in rows("graph_index", "text") if "Alpha" in r[0]}
    assert rows("entity_mentions", "doc_id", "entity_name") == {("1", "Delta"), ("2", "Beta"), ("2", "Gamma")}
    # searches through the lists and the postings find what is there
    assert engine.search("chunks_vector", "g", "Delta sleeps", 1).first().text == "Delta sleeps"
    assert engine.search("entities", "g", "Gamma about", 1).first()["name"] == "Gamma"
    assert [r.doc_id for r in engine.search("chunks_keyword", "g", "sees gamma").collect()] == ["2"]
    # without a model for extraction nothing of the old graph stays either
    Engine(engine.store, embed=embed, limits=Limits(50, 1)).ingest(one("2", "nobody"))
    assert rows("global_entities", "canonical_name") == {("Delta",)} and rows("global_relations", "subject") == set()
    assert {r[0] for r in rows("chunk_grams", "doc_id")} == {"1", "2"}
    with pytest.raises(ValueError, match="sizes"):
        Engine(engine.store, embed=lambda t: [1.0, 2.0]).ingest(one("3", "odd"))
    assert rows("documents", "doc_id") == {("1",), ("2",)}
