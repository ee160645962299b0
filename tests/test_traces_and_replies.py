import json
import random

import pytest
from pyspark.sql import functions as F

from lorebase import config
from lorebase.functions import models, replies
from lorebase.operators import events, traces


def test_replies(spark):
    assert replies.balanced('x {"a": "}]", "b": [1]} y') == '{"a": "}]", "b": [1]}'
    assert replies.balanced("[1, [2]") == "[1, [2]" and replies.balanced("none") == "none"
    of = lambda c, rows: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string").select("i", c.alias("c")).orderBy("i").select("c").collect()]
    value = replies.first_value(F.col("raw"), "[")
    got = of(replies.json_replacements(value), ['<think>[]</think>```json\n[{"row": "it", "result": "dog"}, {"raw": "", "result": 1}, 3]```', "{}", "", None, '[{"raw": "a", "result": 2}]'])
    assert [[tuple(x) for x in r["items"]] for r in got] == [[("it", "dog")], [], [], [], [("a", "2")]] and [bool(r.error) for r in got] == [False, True, False, False, False]
    tagged = "<|item_start|><|raw_start|> it <|raw_end|>\n<|result_start|>dog<|result_end|><|ITEM_END|> x <|item_start|><|raw_start|><|raw_end|><|result_start|>z<|result_end|><|item_end|>"
    assert [[tuple(x) for x in r] for r in of(replies.tagged_replacements(F.col("raw")), [tagged, "", None])] == [[("it", "dog")], [], []]
    fused = of(replies.fused_entities(replies.first_value(F.col("raw"))), ['[{"canonical_name": "A", "type": "t", "aliases": [" b ", ""]}, {"type": "t"}, 1, {"canonical_name": "B", "type": "t", "aliases": 2}]', "", "{}", "[1"])
    assert [(x.canonical_name, x.aliases) for x in fused[0].entities] == [("A", ["b"]), ("B", [])] and len(fused[0].errors) == 3 and "entity 3" in fused[0].errors[2]
    assert [len(r.errors) for r in fused[1:]] == [1, 1, 1] and not any(r.entities for r in fused[1:])
    payloads = spark.createDataFrame([(1, '{"a": [{"x": 1}], "b": {"c": [{"content": "t", "id": 0, "score": 0}, {"triple": "r", "name": "n"}]}}'), (2, "no json"), (3, '[[{"text": ""}], [{"snippet": "s", "doc_id": "d"}]]'), (4, "[]")], "k int, payload string")
    rows = [tuple(r) for r in replies.items(payloads, ["k"], "m", "l").select("k", "pos", "type", "chunk_id", "score", "text").orderBy("k", "pos").collect()]
    assert rows == [(1, 0, "chunk", "0", "0", "t"), (1, 1, "relation", None, None, None), (3, 0, "entity", None, None, None)]
    assert of(replies.looks_like_error(F.col("raw")), [" Error: x", "fine", "❌"]) == [True, False, True]


def test_models(spark):
    tried = []

    def flaky(x):
        tried.append(x)
        if len(tried) < 3:
            raise OSError("busy")
        return x + "!"

    waits = []
    assert models.patiently(flaky, 3, 1.0, waits.append)("a") == "a!" and len(waits) == 2 and 1 <= waits[0] <= 1.2 and 2 <= waits[1] <= 2.4
    with pytest.raises(OSError):
        models.patiently(lambda: (_ for _ in ()).throw(OSError()), 2, 0, lambda s: None)()
    df = spark.createDataFrame([(1, "the dog; it barks"), (2, "boom"), (3, None)], "k int, text string")

    def reply(p):
        if "boom" in p:
            raise ValueError("no")
        return "<|item_start|><|raw_start|>it<|raw_end|><|result_start|>the dog<|result_end|><|item_end|>"

    got = {r.k: r for r in models.resolved(df, reply, F.col("text"), tries=1).collect()}
    assert got[1].resolved_text == "the dog; the dog barks" and got[2].resolved_text == "boom" and got[2].coreference_error == "ValueError: no" and got[3].resolved_text is None
    got = {r.k: r for r in models.resolved(df, lambda p: '{"not": "a list"}', F.col("text"), tagged=False, tries=1).collect()}
    assert got[1].resolved_text == "the dog; it barks" and got[1].coreference_error
    assert [r[0] for r in df.select(models.standardised(lambda t: "" if "dog" in t else t.upper(), F.coalesce("text", F.lit("x")))).collect()] == ["the dog; it barks", "BOOM", "X"]
    assert [tuple(r[0]) for r in df.select(models.answered_json(lambda p: 'so: {"a": 1}' if p else "no", F.col("text"), ["a"], 1, 0)).collect()][0] == ('{"a": 1}', None)

    def embed(t):
        if len(t) > 40:
            raise ValueError("maximum context exceeded")
        return [float(len(t)), 1.0]

    assert models.long_embedding(embed, "short") == [5.0, 1.0]
    with pytest.raises(ValueError):
        models.long_embedding(lambda t: embed("x" * 50), "a")
    long = "\n".join("word " * 30 for _ in range(60))
    assert models.long_embedding(lambda t: [float(t.count("word"))], long, 600) == [1800 / len(models.split_by_tokens(long, 600))]
    replies_of = spark.createDataFrame([('{"results": [{"index": 2, "relevance_score": 0.5}, {"index": 9}, {"index": 0, "score": 0.25}, {"index": "1"}, 4]}',), ('{"data": []}',), (None,)], "r string")
    assert [[tuple(x) for x in r[0]] for r in replies_of.select(models.rerank_reply(F.col("r"), F.lit(3))).collect()] == [[(2, 0.5), (0, 0.25)], [(0, 1.0), (1, 1.0), (2, 1.0)], [(0, 1.0), (1, 1.0), (2, 1.0)]]
    hits = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert [tuple(x) for x in hits.select(models.reranked(lambda q, d: '{"results": [{"index": 2, "score": 1}, {"index": 1, "score": 0}]}', "q", F.col("t"), 1)).first()[0]] == [(2, 1.0)]
    assert [tuple(x) for x in hits.select(models.reranked(lambda q, d: 1 / 0, "q", F.col("t"))).first()[0]] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    images = spark.createDataFrame([(1, b"ab"), (2, b"")], "k int, content binary")
    assert [(r.text, r.error) for r in models.described(images, lambda b, p: f"{p}{1 // len(b) + len(b)}", "n=").orderBy("k").collect()] == [("n=2", None), ("", "ZeroDivisionError: integer division or modulo by zero")]


def test_config():
    assert config.interpolate("${A}-${B:b}-${C}", {"A": "1"}) == "1-b-${C}"
    assert config.overlay({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 4}, "d": {}}) == {"a": {"b": 4, "c": 2}, "d": {}}
    assert config.get({"a": {"b": 1}}, "a.b") == 1 and config.get({}, "a.b", 2) == 2


def test_steps(spark):
    kinds = "type string, task_id string, tool_name string, step string, status string, timestamp string, started_at string, updated_at string, ended_at string, latency_ms double"
    rows = [("tool.end", "1", "search", None, None, "t", None, None, None, 2.0), ("agent.think.start", "2", None, None, None, "t", None, None, None, None), ("retrieval.step", "3", None, "4", "queued", None, "s", None, None, None)]
    got = {r.step_id: r for r in traces.agent_steps(spark.createDataFrame(rows, kinds)).collect()}
    assert (got["1"].status, got["1"].started_at, got["1"].ended_at, got["1"].kind, got["1"].title) == ("completed", "t", "t", "tool", "search")
    assert (got["2"].status, got["2"].ended_at, got["2"].kind) == ("running", "", "llm") and got["3"].title == "检索步骤 4" and got["3"].status == "pending"
    cp = spark.createDataFrame([("fusion", "done", "u", {"latency_ms": "3.5", "total_tokens": "30"}, "")], "stage string, status string, updated_at string, payload map<string,string>, error string")
    r = traces.pipeline_steps(cp).first()
    assert (r.step_id, r.status, r.ended_at, r.latency_ms, r.total_tokens) == ("pipeline:fusion", "completed", "u", 3.5, 30)
    chunks = spark.createDataFrame([("c1", 0, "processing", "u", None)], "chunk_id string, chunk_index int, status string, updated_at string, error string")
    assert tuple(traces.chunk_steps(chunks).first())[:6] == ("chunk:c1", "", "chunk_checkpoint", "Chunk 0", "running", "u")


def test_listings(spark):
    nodes = spark.createDataFrame([(0, None, "d", "A"), (1, None, "d", "A"), (2, "x", None, "B"), (3, None, None, None)], "pos int, id string, doc_id string, name string")
    drawn = traces.flow_nodes(nodes)
    assert [r.flow_id for r in drawn.orderBy("pos").collect()] == ["d:A", "d:A#2", "x", "3"]
    edges = spark.createDataFrame([("A", "B"), ("A", "Z"), ("A", None)], "head_name string, tail_name string")
    assert {(r["from"], r["to"]) for r in traces.flow_edges(edges, drawn).collect()} == {("d:A", "x"), ("d:A", "Z")}
    docs = spark.createDataFrame([("g", str(i), f"t{i}", s) for i, s in enumerate(["graph_completed", "graph_failed", "x", None])], "group_id string, doc_id string, doc_time string, stage string")
    r = traces.group_summaries(docs).first()
    assert (r.total, r.graph, r.failed, r.base, r.recent) == (4, 1, 1, 2, ["3", "2", "1"])
    text = spark.createDataFrame([("[RAG_CONTEXT] group_id = g1\nask\n[rag_context] DOC_ID= d1 \n[RAG_CONTEXT] group_id=g2\nmore",)], "text string")
    assert tuple(traces.rag_context(text).first())[1:] == ("g1", "d1", "ask\nmore")
    use = spark.createDataFrame([({"prompt_tokens": "3", "total_tokens": "5"}, {}), ({}, {"completion_tokens": "2"}), ({}, {})], "a map<string,string>, b map<string,string>")
    assert [tuple(x.u) for x in use.select(traces.usage_fields(F.col("a"), F.col("b")).alias("u")).collect()] == [(3, 0, 5, "usage_metadata"), (0, 2, 0, "response_metadata"), (0, 0, 0, "estimated")]


def test_events(spark):
    """Each stage's failure is its document's; the others go on."""
    asked = spark.sparkContext.accumulator(0)

    def model(p):
        asked.add(1)
        task, _, rest = p.partition("\n\n")
        if "broken" in rest and task.startswith("Give"):
            return "no json here" if events.AGAIN not in p else "{}"
        if task.startswith("Name"):
            return "[1]" if "list" in rest else json.dumps({"resolved_text": 5 if "number" in rest else rest.upper()})
        if task.startswith("Part"):
            return json.dumps({"sentences": [] if "NOTHING" in rest else [{"id": 0, "sentence": "a"}, {"id": "", "sentence": "b"}, {"id": "0", "sentence": rest}, {"id": 2}, {"id": 3, "sentence": "c"}]})
        if task.startswith("Give"):
            if "FAIL" in rest:
                raise OSError("down")
            return f"it is {json.dumps({'of': rest})}"
        return json.dumps({"n": len(json.loads(rest.rsplit("sentence_events: ", 1)[1]))})

    rows = [(1, "one"), (2, None), (3, " \n"), (4, "a list"), (5, "a number"), (6, "nothing"), (7, "fail"), (8, "broken number")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in events.sentence_events(docs, model, tries=2, wait=0.0).collect()}
    assert got[1].resolved_text == "ONE" and [json.loads(e)["of"] for e in got[1].sentence_events] == ["sentence_id: 0\nsentence: ONE", "sentence_id: 3\nsentence: c"] and got[1].aggregated == '{"n": 2}' and got[1].error is None
    assert got[2].error == got[3].error == "the text is empty" and got[4].error == "the resolved text came as no object" and got[6].error == "no sentences came" and got[7].error == "OSError: down"
    assert got[5].resolved_text == "a number" and got[5].error is None and got[7].aggregated is None and got[8].sentence_events[0] == "{}" and got[8].error is None
    assert events.sentence_events(docs.limit(0), model).count() == 0
    whole = {r.doc_id: r for r in events.whole_events(docs, lambda p: json.dumps({k: {"k": k} for k in events.WHOLE if "list" not in p or k != "aggregated"}), tries=2, wait=0.0).collect()}
    assert whole[1].aggregated == '{"k":"aggregated"}' and whole[1].error is None and whole[2].error == "the text is empty" and whole[4].error == "ValueError: the reply lacks aggregated"


def test_events_of_long_documents(spark):
    """What a document's sentences shuffle grows with its length, not with its length for each sentence."""
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=60)).strip() for _ in range(300)]

    def model(p):
        task, _, rest = p.partition("\n\n")
        if task.startswith("Name"):
            return json.dumps({"resolved_text": rest})
        if task.startswith("Part"):
            return json.dumps({"sentences": [{"id": i, "sentence": x} for i, x in enumerate(rest.split("\n"), 1)]})
        return json.dumps({"n": len(json.loads(rest.rsplit("sentence_events: ", 1)[1])) if task.startswith("Join") else rest.count("sentence: ")})

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    r = events.sentence_events(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string"), model, wait=0.0).first()
    assert r.resolved_text == "\n".join(lines) and r.error is None and r.aggregated == '{"n": 300}' and len(r.sentence_events) == len(json.loads(r.segmentation)["sentences"]) == 300
    assert 0 < shuffled() - before < 20 * len("\n".join(lines))
