import json
import os
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.functions.chunker import Limits
from lorebase.operators import ann, density, evidence, monitor, progress, store
from lorebase.plans.engine import Engine
from lorebase.sources.files import batch_process, scan_files, tail_log
from lorebase.sources.store import Store
from lorebase.streaming import progress as stream


def test_upsert_keeps_immutable(spark):
    old = spark.createDataFrame([("a", "n1", "d", "t1")], "group_id string, group_name string, group_desc string, created_at string")
    new = spark.createDataFrame([("a", "n2", "d", "t2", 1), ("a", "n3", "d", "t3", 2), ("b", "m", "d", "t4", 3)], "group_id string, group_name string, group_desc string, created_at string, seq long")
    rows = {r.group_id: tuple(r)[1:] for r in store.upsert_table("groups", old, new).collect()}
    assert rows == {"a": ("n3", "d", "t1"), "b": ("m", "d", "t4")}


def test_engine(spark, tmp_path):
    def extract(text):
        names = [w for w in text.split() if w[:1].isupper()]
        lines = [f"entity<|SEP|>{n}<|SEP|>Name<|SEP|>about {n}" for n in names]
        lines += [f"relation<|SEP|>{a}<|SEP|>{b}<|SEP|>next<|SEP|>near<|SEP|>5" for a, b in zip(names, names[1:])]
        return "\n".join([*lines, "<|DONE|>"])

    engine = Engine(Store(spark, str(tmp_path), 2), extract=extract, limits=Limits(5, 1))
    docs = spark.createDataFrame([("g", "1", "one", "2024-01-01", "Alpha meets Beta\nBeta meets Gamma"), ("g", "2", "two", "2024-02-01", "Delta sleeps"), ("h", "3", "three", "2024-02-01", "Alpha")], "group_id string, doc_id string, doc_name string, doc_time string, text string")
    engine.ingest(docs.limit(2))
    engine.ingest(docs)  # some again: nothing doubles
    assert engine.store.read("chunks").count() == 4
    hit = engine.search("chunks_keyword", "g", "gamma").first()
    assert hit.doc_id == "1" and hit.chunk_index == 1
    assert engine.search("chunks_vector", "g", "Delta sleeps", 1).first().text == "Delta sleeps"
    assert engine.search("chunks_keyword", "g", " ").count() == 0
    assert {r.subject for r in engine.search("relations_by_entities", "g", names=["Beta"]).collect()} == {"Alpha", "Beta"}
    assert engine.search("entities", "g", "Gamma about", 1).count() == 1
    assert {r.node for r in engine.expand("g", ["Alpha"], 2).collect()} == {"Beta", "Gamma"}
    items, failed = engine.run_plan("g", "gamma", [{"mode": "chunks_keyword"}, {"mode": "nope"}, {"mode": "chunks_keyword"}])
    assert len(failed) == 1 and items.select("chunk_id").distinct().count() == items.count()
    with pytest.raises(ValueError):
        engine.search("nope", "g")
    with pytest.raises(ValueError):
        engine.search("entities", " ")
    assert engine.store.delete_document("g", "1") and not engine.store.delete_document("g", "1")
    assert {r.doc_id for r in engine.store.read("chunks").collect()} == {"2", "3"}
    engine.store.delete_group("h")
    assert engine.store.read("documents").select("group_id").distinct().count() == 1


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_bytes("漢字 text ".encode("gbk"))
    (d / "b.csv").write_text("x,y\n1,2\n")
    (d / "skip.bin").write_bytes(b"0")
    (d / "c.png").write_bytes(b"0")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(d / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    rows = {r.path.rsplit("/", 1)[1]: r for r in scan_files(spark, str(d)).collect()}
    assert rows["a.txt"].text == "漢字 text" and rows["d.docx"].text == "Hello\n\na | b" and "1" in rows["b.csv"].text
    assert rows["c.png"].text is None and "OCR" in rows["c.png"].error and len(rows) == 4
    assert batch_process(scan_files(spark, str(d)), str(tmp_path / "out")) == {"total": 4, "success": 3, "failed": 1}
    (tmp_path / "x.log").write_text("\n".join(f"line {i} {'odd' if i % 2 else 'even'}" for i in range(50)))
    assert [r.line for r in tail_log(spark, str(tmp_path / "x.log"), 2, ("odd", " ")).collect()] == ["line 47 odd", "line 49 odd"]


def test_streams(spark, sf, tmp_path):
    events = [{"trace_id": "t", "event": "e", "task_id": str(i % 3), "status": f"s{i}", "ts": f"2024-01-01T00:{i:02d}:00Z", "value": 1.0} for i in range(30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)))
    read = stream.read_traces(spark, str(tmp_path / "in"))
    state = stream.latest_state(read, "task_id", ["ts"], ["status"])
    state.writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("state").collect()} == {("0", "s27"), ("1", "s28"), ("2", "s29")}
    out = stream.tumbling(read.withColumnRenamed("event", "event_type"), "10 minutes", "1 minute")
    out.writeStream.outputMode("append").format("memory").queryName("tumbled").trigger(availableNow=True).start().awaitTermination()
    assert {r.n for r in spark.table("tumbled").collect()} == {10}
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert stream.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_late_rows(spark, tmp_path):
    """A row behind the watermark is left out, one within it counts, a row sent again doesn't.

    Spark holds a batch's rows against the watermark that the batch before it began with, so a row is late from the second batch on.
    """
    (tmp_path / "in").mkdir()
    said = [("a", "00:05"), ("b", "00:50")], [("c", "00:20"), ("d", "03:00"), ("d", "03:00")], [("f", "02:55"), ("d", "03:01")], [("e", "00:30"), ("g", "09:00")]
    for i, rows in enumerate(said):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"event": "x", "task_id": k, "ts": f"2024-01-01T{t}:00Z", "value": 1.0}) for k, t in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    read = stream.read_traces(spark, str(tmp_path / "in"), 1)
    out = stream.drained(stream.tumbling(read.withColumnRenamed("event", "event_type"), "1 hour", "30 minutes"), str(tmp_path / "w"))
    assert sorted((r.start.hour, r.n) for r in out.collect()) == [(0, 3), (2, 1), (3, 3)]
    out = stream.drained(stream.deduplicated(read.select("task_id", "ts"), ["task_id"], "30 minutes"), str(tmp_path / "s"))
    assert sorted(r.task_id for r in out.collect()) == ["a", "b", "c", "d", "f", "g"]


def test_transitions(spark):
    tasks = spark.createDataFrame([("1", "running", 0, False, "t"), ("2", "completed", 0, False, "t"), ("3", "pending", 0, False, "t"), ("4", "failed", 1, False, "t")], "task_id string, status string, retry_count int, cancel_requested boolean, updated_at string")
    asked = spark.createDataFrame([(x, "cancel", "u") for x in "123"] + [("4", "resume", "u")], "task_id string, action string, at string")
    rows = {r.task_id: (r.status, r.retry_count, r.cancel_requested) for r in stream.transition(tasks, asked).collect()}
    assert rows == {"1": ("cancel_requested", 0, True), "2": ("completed", 0, False), "3": ("cancelled", 0, False), "4": ("recovering", 2, False)}


def test_density(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (10, 2)), rng.normal(5, 0.05, (12, 2)), [[20.0, -20.0]]])
    labels = density.density_labels(x, 3)
    assert len(set(labels[:10])) == len(set(labels[10:22])) == 1 and labels[0] != labels[10] and labels[22] == -1
    rows = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(x)], "doc string, seq int, embedding array<double>")
    assert density.density_clusters(rows, ["doc"], min_cluster_size=3).agg(F.max("cluster")).first()[0] == 10_000_000


def test_dedupe_lines(spark):
    df = spark.createDataFrame([("a\n\n\nb\n a\nb\nc",)], "c string")
    assert df.select(progress.dedupe_lines(F.col("c"))).first()[0] == "a\n\nb\nc"


def namer(text):
    names = [w for w in text.split() if w[:1].isupper()]
    if "Boom" in names:
        raise ValueError("no")
    lines = [f"entity<|SEP|>{n}<|SEP|>Name<|SEP|>about {n}" for n in names]
    lines += [f"relation<|SEP|>{a}<|SEP|>{b}<|SEP|>next<|SEP|>near<|SEP|>5" for a, b in zip(names, names[1:])]
    return "\n".join([*lines, "<|DONE|>"])


DOCS = "group_id string, doc_id string, doc_name string, doc_time string, text string"


def test_alignment_mentions_and_evidence(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path), 2), extract=namer, limits=Limits(5, 1), tries=1)
    engine.ingest(spark.createDataFrame([("g", "1", "one", "t1", "Alpha meets Beta\nBeta meets Gamma")], DOCS))
    engine.ingest(spark.createDataFrame([("g", "2", "two", "t2", "ALPHA sees Beta")], DOCS))
    rows = lambda t, *c: {tuple(r) for r in engine.store.read(t).select(*c).collect()}
    # ALPHA is found under the name that the group has for it
    assert rows("global_entities", "canonical_name") == {("Alpha",), ("Beta",), ("Gamma",)}
    assert ("2", "ALPHA", "Alpha", "exact_name") in rows("entity_alignments", "doc_id", "local_name", "global_name", "alignment_method")
    assert rows("entities", "doc_id", "canonical_name") == {("1", "Alpha"), ("1", "Beta"), ("1", "Gamma"), ("2", "Alpha"), ("2", "Beta")}
    assert rows("global_relations", "subject", "object") == {("Alpha", "Beta"), ("Beta", "Gamma")}
    assert {r[0] for r in rows("relation_alignments", "doc_id")} == {"1", "2"} and len(rows("relation_mentions", "mention_id")) == 3
    assert {("1", "Beta"), ("2", "ALPHA")} <= rows("entity_mentions", "doc_id", "entity_name")
    found = engine.graph_search("g", "Alpha", 2)
    assert {r["name"] for r in found["seeds"].collect()} >= {"Alpha"}
    assert {(r.subject, r.object) for r in found["relations"].collect()} >= {("Alpha", "Beta")}
    assert {r.doc_id for r in found["entity_mentions"].collect()} == {"1", "2"} and found["chunks"].count() >= 2
    assert {r.part for r in evidence.result_counts(found).filter("used").collect()} >= {"entity_hits", "relations", "entities", "chunks"}
    # a document that goes takes only what nothing else stands on
    engine.store.delete_document("g", "1", graph_only=True)
    assert rows("global_entities", "canonical_name") == {("Alpha",), ("Beta",)} and rows("global_relations", "object") == {("Beta",)}
    assert engine.store.vacuum() > 0 and engine.store.read("chunks").count() == 3


def test_resume_and_retry(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def counting(text):
        (asked / f"{abs(hash(text))}-{len(list(asked.iterdir()))}").write_text(text)
        return namer(text) if not (tmp_path / "calm").exists() else namer(text.replace("Boom", "Bim"))

    engine = Engine(Store(spark, str(tmp_path / "store"), 2), extract=counting, limits=Limits(5, 1), tries=1)
    engine.ingest(spark.createDataFrame([("g", "1", "one", "t1", "Alpha meets Beta\nBoom meets Gamma")], DOCS))
    states = lambda: {r.chunk_id: r.status for r in engine.store.read("chunk_checkpoints").collect()}
    assert states() == {"1::chunk_1": "completed", "1::chunk_2": "failed"} and len(list(asked.iterdir())) == 2
    (tmp_path / "calm").write_text("")
    engine.build_graph(engine.store.read("documents").select("group_id", "doc_id"))  # goes on with what is left
    assert states()["1::chunk_2"] == "completed" and len(list(asked.iterdir())) == 3
    assert {r.canonical_name for r in engine.store.read("entities").collect()} == {"Alpha", "Beta", "Bim", "Gamma"}
    engine.retry_chunk("g", "1", "1::chunk_1")
    assert len(list(asked.iterdir())) == 4
    with pytest.raises(ValueError):
        engine.retry_chunk("g", "1", "none")
    task = spark.createDataFrame([("t", "g", "1", "running", "2024", "2024", 0, False)], "task_id string, group_id string, doc_id string, status string, created_at string, updated_at string, retry_count int, cancel_requested boolean")
    engine.store.merge_newest("ingest_tasks", task)
    assert engine.recover(["t"]) == 0 and engine.recover() == 1
    assert {(r.status, r.retry_count) for r in engine.store.read("ingest_tasks").collect()} == {("completed", 1)}


def test_store_writes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    kind = "group_id string, doc_id string, chunk_id string, chunk_index int, text string"
    row = lambda g, d, t: (g, d, f"{d}::chunk_1", 0, t)
    s.upsert("chunks", spark.createDataFrame([row("a", str(i), "x") for i in range(40)] + [row("b/c=d", "1", "x"), row(None, "2", "x")], kind))
    before = s._manifest()["chunks"]
    assert Store(spark, str(tmp_path), 3).parts == s.parts == 64 and Store(spark, str(tmp_path)).read("chunks").count() == 42
    # two rows of one key in a batch, in either order: by the order column, and without it by what they are
    for rows in ([("y", 1), ("z", 0)], [("z", 0), ("y", 1)]):
        s.upsert("chunks", spark.createDataFrame([(*row("a", "7", t), n) for t, n in rows], f"{kind}, seq long"))
        assert s.read("chunks").filter("doc_id = '7'").first().text == "y"
    for rows in (("p", "q"), ("q", "p")):
        s.upsert("chunks", spark.createDataFrame([row("a", "8", t) for t in rows], kind))
        assert s.read("chunks").filter("doc_id = '8'").first().text == "q"
    after = s._manifest()["chunks"]
    assert sum(before[p] != after[p] for p in before) <= 2 and s.read("chunks").count() == 42
    with pytest.raises(ZeroDivisionError):
        with s.batch():
            s.replace("chunks", s.read("chunks").limit(0))
            assert s.read("chunks").count() == 0
            1 / 0
    assert s.read("chunks").count() == 42
    s.remove("chunks", spark.createDataFrame([("b/c=d", "1")], "group_id string, doc_id string"))
    s.delete_group("a")
    assert [tuple(r)[:2] for r in s.read("chunks").collect()] == [(None, "2")]
    assert s.clear(["chunks"]) == {"chunks": 1} and s.read("chunks").count() == 1
    s.clear(really=True)
    assert s.read("chunks").count() == 0


def test_states_are_merged_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kind = "task_id string, group_id string, doc_id string, status string, updated_at string"
    s = Store(spark, str(tmp_path / "store"))
    for i, rows in enumerate([[("t", "2", "running"), ("t", "1", "pending")], [("t", "1", "late")], [("t", "3", "completed")]]):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"task_id": t, "group_id": "g", "doc_id": "d", "status": x, "updated_at": u}) for t, u, x in rows))
        for _ in range(2):  # the second time nothing is new
            stream.write_states(spark.readStream.schema(kind).json(str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
        assert s.read("ingest_tasks").first().status == ("running" if i < 2 else "completed") and s.read("ingest_tasks").count() == 1
    stream.write_states(spark.readStream.schema(kind).json(str(tmp_path / "in")), s, str(tmp_path / "cp2")).awaitTermination()  # all again
    assert s.read("ingest_tasks").first().status == "completed"


def test_paired_streams(spark, tmp_path):
    for name, rows in (("s", [("1", "tool", "x", "2024-01-01T00:00:00Z"), ("2", "tool", "y", "2024-01-01T00:00:00Z")]), ("e", [("1", "done", None, "2024-01-01T00:00:01.5Z"), ("9", "done", None, "2024-01-01T00:00:01Z")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps({"invocation_id": i, "kind": k, "status": k, "name": n, "ts": t}) for i, k, n, t in rows))
    starts = spark.readStream.schema("invocation_id string, kind string, name string, ts timestamp").json(str(tmp_path / "s"))
    ends = spark.readStream.schema("invocation_id string, status string, ts timestamp").json(str(tmp_path / "e"))
    monitor.paired(starts, ends).writeStream.format("memory").queryName("paired").trigger(availableNow=True).start().awaitTermination()
    assert [(r.invocation_id, r.kind, r.latency_ms) for r in spark.table("paired").collect()] == [("1", "tool", 1500.0)]
    monitor.export({"counters": monitor.counters(spark.createDataFrame([("a", 1), ("a", 2)], "name string, value long"))}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "counters")).first().total == 3


def test_inverted_lists(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)] + [("empty", []), ("short", [1.0])], "pk string, embedding array<float>")
    c = ann.fit(rows.filter("size(embedding) = 16"), "pk", 24)
    index = ann.build(rows, c).cache()
    assert {r["list"] for r in index.filter("pk in ('empty', 'short')").collect()} == {-1}
    hit = 0
    for q in range(0, 1500, 75):
        want = set(map(str, np.argsort(-(x @ x[q]), kind="stable")[:10]))
        hit += len(want & {r.pk for r in ann.search(index.filter("list >= 0"), c, x[q].tolist(), 10, "pk", ["pk"], probes=6).collect()})
    assert hit >= 0.9 * 200  # recall at 10 against all vectors
    assert ann.search(index.filter("list >= 0"), c, x[0].tolist(), 1400, "pk", ["pk"], probes=1).count() == 1400  # too few in a list: all are read
    assert ann.fit(rows.limit(0), "pk").shape == (0, 0) and ann.search(index, c, [], 3, "pk", ["pk"]).count() == 0
