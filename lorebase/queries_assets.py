"""Queries of evidence, recovery, monitoring, skills, replies and inverted lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bindings as B
from .bindings import with_sql
from .functions import models, replies
from .operators import ann, events, evidence, graph, monitor, recovery, resolution, search, skills
from .queries import query
from .session import written

_DOT = "list_inner_product(embedding::DOUBLE[], qv::DOUBLE[])"

# orders as tasks of their customer's documents
_TASKS = """WITH RECURSIVE tasks AS (SELECT o_orderkey AS task_id, CAST(o_custkey AS VARCHAR) AS doc_id, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END WHEN 'P' THEN 'cancelled' ELSE ['pending', 'running', 'recovering', 'cancel_requested'][1 + o_orderkey % 4] END AS status FROM orders)
"""


def _tasks(spark, sf):
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    status = (
        F.when((F.col("o_orderstatus") == "F") & (key % 2 == 0), "completed").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "cancelled")
        .otherwise(F.get(F.array(*(F.lit(x) for x in ("pending", "running", "recovering", "cancel_requested"))), (key % 4).cast("int")))
    )
    return o.select(key.alias("task_id"), F.lit("g").alias("group_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.lit("").alias("created_at"), status.alias("status"), F.lit(0).alias("retry_count"))


@query(_TASKS + "SELECT task_id, status FROM tasks WHERE status IN ('pending', 'running', 'recovering') ORDER BY updated_at, task_id LIMIT 200")
def recoverable_tasks(spark, sf):
    return recovery.recoverable(_tasks(spark, sf)).select("task_id", "status")


@query(_TASKS + "SELECT task_id, 'recovering' AS status, 1 AS retry_count, '2030' AS updated_at FROM (SELECT * FROM tasks WHERE status IN ('pending', 'running', 'recovering') ORDER BY updated_at, task_id LIMIT 1000) WHERE task_id % 5 <> 0")
def startup_recovery(spark, sf):
    t = _tasks(spark, sf)
    return recovery.started_again(t, t.filter("task_id % 5 = 0"), F.lit("2030")).select("task_id", "status", "retry_count", "updated_at")


@query(_TASKS + "SELECT priority, count(*) FILTER (status IN ('pending', 'running', 'recovering', 'cancel_requested')) AS running, count(*) FILTER (status IN ('failed', 'cancelled')) AS failed FROM tasks GROUP BY 1")
def task_counts(spark, sf):
    return recovery.task_counts(_tasks(spark, sf), ["priority"])


@query(with_sql("chunks") + """, asked AS (SELECT source AS group_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id || '::chunk_' || i AS chunk_id FROM documents, (VALUES (1), (3)) x(i))
SELECT a.chunk_id, coalesce(chunk_index, -1) AS chunk_index, CASE WHEN coalesce(chunk_index, -1) = 0 THEN -1 ELSE coalesce(chunk_index, -1) END AS task_index FROM asked a LEFT JOIN chunks USING (group_id, doc_id, chunk_id)""")
def chunk_places(spark, sf):
    d = B.documents(spark, sf).select("group_id", "doc_id", F.explode(F.array(F.lit("1"), F.lit("3"))).alias("i"))
    return recovery.chunk_places(d.select("group_id", "doc_id", F.concat("doc_id", F.lit("::chunk_"), "i").alias("chunk_id")), B.chunks(spark, sf)).select("chunk_id", "chunk_index", "task_index")


def _checkpoints(spark, sf):
    c = B.chunks(spark, sf)
    status = F.when(F.col("chunk_index") % 3 == 0, "completed").when(F.col("chunk_index") % 3 == 1, "failed").otherwise("processing")
    return c.select("group_id", "doc_id", "chunk_id", "chunk_index", status.alias("status"), F.concat(F.lit("seen "), "chunk_id").alias("resolved_text"))


@query(with_sql("chunks") + """SELECT chunk_id, chunk_index, text, 'seen ' || chunk_id AS resolved_text FROM chunks WHERE chunk_index % 3 = 0
UNION ALL SELECT doc_id || '::gone', 0, '', 'seen ' || doc_id || '::gone' FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents)""")
def restored_chunks(spark, sf):
    d = B.documents(spark, sf)
    gone = d.select("group_id", "doc_id", F.concat("doc_id", F.lit("::gone")).alias("chunk_id"), F.lit(9).alias("chunk_index"), F.lit("completed").alias("status"), F.concat(F.lit("seen "), "doc_id", F.lit("::gone")).alias("resolved_text"))
    return recovery.restored(_checkpoints(spark, sf).unionByName(gone), B.chunks(spark, sf)).select("chunk_id", "chunk_index", "text", "resolved_text")


@query(with_sql("chunks") + """SELECT chunk_id, before, after FROM (SELECT chunk_id, chunk_index, right(coalesce(lag(text) OVER w, ''), 200) AS before, left(coalesce(lead(text) OVER w, ''), 200) AS after FROM chunks WINDOW w AS (PARTITION BY group_id, doc_id ORDER BY chunk_index)) WHERE chunk_index % 3 <> 0""")
def remaining_chunks(spark, sf):
    return recovery.remaining(B.chunks(spark, sf), _checkpoints(spark, sf)).select("chunk_id", "before", "after")


_STAGES = """, st AS (SELECT CAST(task_id AS VARCHAR) AS doc_id, stage, status, updated_at || lpad(CAST(event_id AS VARCHAR), 12, '0') AS updated_at FROM steps),
last AS (SELECT doc_id, stage, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM st GROUP BY 1, 2)"""


def _stages(spark, sf):
    return B.steps(spark, sf).select(F.lit("g").alias("group_id"), F.col("task_id").cast("string").alias("doc_id"), "stage", "status", F.concat("updated_at", F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("updated_at"))


@query(with_sql("steps") + _STAGES + "SELECT doc_id, string_agg(stage || '=' || status, ',' ORDER BY stage) AS stages FROM last GROUP BY 1")
def pipeline_map(spark, sf):
    return recovery.pipeline_map(_stages(spark, sf)).select("doc_id", F.array_join(F.transform(F.map_entries("pipeline"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["status"])), ",").alias("stages"))


_NORMAL = "CASE {x} WHEN 'done' THEN 'completed' WHEN 'Succeeded' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'processing' THEN 'running' WHEN 'queued' THEN 'pending' ELSE {x} END"


@query(with_sql("steps", "chunks") + _STAGES + f""", c AS (SELECT doc_id, CASE chunk_index % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END AS status FROM chunks),
e AS (SELECT doc_id, {_NORMAL.format(x='status')} AS s FROM last UNION ALL SELECT c.doc_id, {_NORMAL.format(x='status')} FROM c WHERE c.doc_id IN (SELECT doc_id FROM last)),
n AS (SELECT doc_id, count(*) AS total FROM c GROUP BY 1), now AS (SELECT doc_id, arg_max(stage, updated_at) AS stage FROM last GROUP BY 1)
SELECT e.doc_id, any_value(stage) AS current_step_name, count(*) AS total_steps, count(*) FILTER (s = 'completed') AS completed_steps, count(*) FILTER (s = 'failed') AS failed_steps, coalesce(any_value(n.total), 0) AS total_chunks
FROM e LEFT JOIN n USING (doc_id) JOIN now USING (doc_id) GROUP BY 1""")
def timeline_summary(spark, sf):
    s = _stages(spark, sf)
    last = s.groupBy("group_id", "doc_id", "stage").agg(F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("updated_at"))
    chunks = _checkpoints(spark, sf).withColumn("group_id", F.lit("g")).join(last.select("doc_id").distinct(), "doc_id", "left_semi")
    return recovery.timeline_summary(chunks, last).select("doc_id", "current_step_name", "total_steps", "completed_steps", "failed_steps", "total_chunks")


@query(with_sql("docs", "chunks") + "SELECT doc_id, chunk_id, CASE chunk_index WHEN 0 THEN '-1' ELSE CAST(chunk_index AS VARCHAR) END AS place, 'pending' AS status FROM chunks JOIN docs USING (group_id, doc_id) WHERE chunk_index % 3 = 1 OR chunk_index = 0")
def chunk_retries(spark, sf):
    asked = _checkpoints(spark, sf).filter("status = 'failed' or chunk_index = 0").select("group_id", "doc_id", "chunk_id").join(B.documents(spark, sf), ["group_id", "doc_id"])
    unknown = B.documents(spark, sf).withColumn("chunk_id", F.lit("none"))
    made = recovery.chunk_retries(asked.unionByName(unknown), B.chunks(spark, sf), F.lit("2030"))
    return made.select("doc_id", F.col("metadata")["chunk_id"].alias("chunk_id"), F.col("metadata")["chunk_index"].alias("place"), "status")


@query(with_sql("chunks") + """, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) SELECT doc_id FROM n WHERE (n = 1 OR CAST(doc_id AS BIGINT) % 2 = 0) AND CAST(doc_id AS BIGINT) % 3 <> 0 AND CAST(doc_id AS BIGINT) % 5 <> 0""")
def rebuild_after_retries(spark, sf):
    key = F.col("doc_id").cast("long")
    c = B.chunks(spark, sf)
    done = c.withColumn("status", F.when((key % 2 == 0) | (F.col("chunk_index") == 0), "completed").otherwise("failed"))
    d = B.documents(spark, sf)
    retried = d.filter(key % 3 != 0).select("group_id", "doc_id", F.lit("completed").alias("status"), F.create_map(F.lit("kind"), F.lit(recovery.RETRY)).alias("metadata"))
    running = d.filter(key % 5 == 0).select("group_id", "doc_id", F.lit("running").alias("status"), F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return recovery.rebuilds(done, c, retried.unionByName(running)).select("doc_id")


# every chunk mentions the nation of its place; documents have entities of their own, the group's are nations
_MENTIONS = """, men AS (SELECT group_id, chunk_id || ':m' AS mention_id, doc_id, chunk_id, 'g' || (chunk_index % 25) AS global_id, 'l' || doc_id AS local_id FROM chunks)"""


def _mentions(spark, sf, level):
    c = B.chunks(spark, sf)
    return c.select("group_id", F.concat("chunk_id", F.lit(":m")).alias("mention_id"), "doc_id", "chunk_id", F.concat(F.lit("g"), F.col("chunk_index") % 25).alias(f"global_{level}_id"), F.concat(F.lit("l"), "doc_id").alias(f"local_{level}_id"))


def _hits(spark, sf):
    """Nations of the first region as hits of the group's level, those of the others as hits of documents."""
    n = B.table(spark, sf, "nation")
    own = F.col("n_regionkey") == 0
    key = F.col("n_nationkey").cast("string")
    return n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.when(own, F.concat(F.lit("g"), key)).otherwise(F.concat(F.lit("l"), key)).alias("source_id"), F.when(own, F.lit(search.GLOBAL)).otherwise(key).alias("doc_id"))


_HIT = """, hit AS (SELECT CASE WHEN n_regionkey = 0 THEN 'g' ELSE 'l' END || n_nationkey AS id, n_regionkey = 0 AS g FROM nation),
found AS (SELECT DISTINCT men.* FROM men JOIN hit ON (g AND id = global_id) OR (NOT g AND id = local_id)), top AS (SELECT * FROM found ORDER BY doc_id DESC, chunk_id, mention_id LIMIT 300)"""


@query(with_sql("chunks") + _MENTIONS + _HIT + " SELECT mention_id, doc_id, chunk_id FROM top")
def entity_evidence(spark, sf):
    return evidence.mentions_of(_hits(spark, sf), _mentions(spark, sf, "entity"), "entity").select("mention_id", "doc_id", "chunk_id")


@query(with_sql("chunks") + _MENTIONS + _HIT + " SELECT DISTINCT c.chunk_id, c.text FROM chunks c JOIN top USING (group_id, chunk_id)")
def relation_evidence(spark, sf):
    mentions = evidence.mentions_of(_hits(spark, sf), _mentions(spark, sf, "relation"), "relation")
    return evidence.chunks_of(mentions, B.chunks(spark, sf)).select("chunk_id", "text")


@query(with_sql("chunks", "ents", "rels") + _MENTIONS + _HIT + """, seed AS (SELECT n_name AS name FROM nation ORDER BY n_nationkey LIMIT 8),
inc AS (SELECT DISTINCT relation_id, subject, object FROM und WHERE a IN (SELECT name FROM seed) ORDER BY relation_id LIMIT 200),
around AS (SELECT canonical_name FROM ents WHERE canonical_name IN (SELECT subject FROM inc UNION SELECT object FROM inc) LIMIT 200),
n AS (SELECT 'seeds' AS part, (SELECT count(*) FROM seed) AS n UNION ALL SELECT 'relations', (SELECT count(*) FROM inc) UNION ALL SELECT 'entities', (SELECT count(*) FROM around)
UNION ALL SELECT 'entity_mentions', (SELECT count(*) FROM top) UNION ALL SELECT 'relation_mentions', 0 UNION ALL SELECT 'chunks', (SELECT count(DISTINCT (group_id, chunk_id)) FROM top))
SELECT part, n, n > 0 AS used FROM n""")
def graph_search_parts(spark, sf):
    hits = _hits(spark, sf)
    none = hits.limit(0).select("pos", F.lit("").alias("head_name"), F.lit("").alias("tail_name"), "source_id", "doc_id")
    parts = evidence.graph_search(hits, none, B.relations(spark, sf), B.entities(spark, sf), _mentions(spark, sf, "entity"), _mentions(spark, sf, "relation"), B.chunks(spark, sf))
    return evidence.result_counts(parts)


@query(with_sql("rels") + """, seed AS (SELECT DISTINCT r_name AS name FROM region), one AS (SELECT name AS seed, b AS node, relation_id FROM und JOIN seed ON a = name),
two AS (SELECT seed, b AS node FROM one JOIN und ON und.a = one.node AND und.relation_id <> one.relation_id)
SELECT seed, node, 1 AS hops FROM one UNION ALL SELECT seed, node, 2 FROM two""")
def triple_expansion(spark, sf):
    r = B.table(spark, sf, "region")
    triples = r.select(F.col("r_name").alias("head"), F.concat(F.lit(" "), "r_name").alias("tail")).unionByName(r.select(F.lit("").alias("head"), F.col("r_name").alias("tail")))
    return evidence.expand_by_triples(B.relations(spark, sf), triples, 2, None).select("seed", "node", "hops")


@query(with_sql("ents") + "SELECT canonical_name AS name, 'name: ' || canonical_name || chr(10) || 'aliases: ' || array_to_string(aliases, ', ') || chr(10) || 'type: ' || type || chr(10) || 'description: ' || description AS text FROM ents")
def node_texts(spark, sf):
    e = B.entities(spark, sf).withColumns({"name": F.col("canonical_name"), "doc_name": F.lit(None).cast("string")})
    return e.select("name", evidence.node_text().alias("text"))


@query(with_sql("rels") + "SELECT relation_id, 'triple: ' || subject || ' ' || relation_type || ' ' || object || chr(10) || 'description: ' || description AS text FROM rels")
def hit_texts(spark, sf):
    none = F.lit(None).cast("string")
    r = B.relations(spark, sf).withColumns({"head_name": F.col("subject"), "tail_name": F.col("object"), "canonical_name": none, "name": F.lit(""), "entity_name": none, "type": none, "doc_name": none, "aliases": F.array().cast("array<string>")})
    return r.select("relation_id", evidence.hit_text().alias("text"))


@query(with_sql("ents") + "SELECT canonical_name AS name, canonical_name || CASE WHEN type = 'region' THEN '' ELSE '｜' || type || '｜' || description END AS text FROM ents")
def cluster_texts(spark, sf):
    blank = F.col("type") == "region"
    e = B.entities(spark, sf).select(F.col("canonical_name").alias("name"), F.when(~blank, F.col("type")).alias("type"), F.when(blank, "").otherwise(F.col("description")).alias("description"))
    return e.select("name", evidence.cluster_text().alias("text"))


@query(with_sql("chunks") + "SELECT doc_id, chunk_index AS pos, CASE WHEN len(t) > 320 THEN rtrim(left(t, 319), ' ') || '…' ELSE t END AS text FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM chunks WHERE chunk_index < 5)")
def compact_items(spark, sf):
    return evidence.compact_items(B.chunks(spark, sf).withColumnRenamed("chunk_index", "pos"), ["doc_id"]).select("doc_id", "pos", "text")


@query("SELECT user_id AS task_id, CAST(n - 1 AS INTEGER) AS pos, evidence FROM (SELECT user_id, event_type || ' ' || k AS evidence, row_number() OVER (PARTITION BY user_id ORDER BY event_id, k) AS n FROM events, (VALUES (1), (2)) x(k)) WHERE n <= 20")
def first_evidence(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), F.array(F.concat("event_type", F.lit(" 1")), F.concat("event_type", F.lit(" 2"))).alias("evidence"))
    return evidence.first_evidence(e, ["task_id"])


@query("SELECT event_type AS name, count(*) AS n, round(avg(value), 4) AS mean_ms, round(max(value), 4) AS most_ms, count(*) FILTER (event_id % 7 = 0) AS failed FROM events GROUP BY 1")
def span_durations(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), (F.col("event_id") % 7 == 0).alias("failed"))
    return monitor.spans(e).withColumns({"mean_ms": F.round("mean_ms", 4), "most_ms": F.round("most_ms", 4)})


@query("SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY 1")
def counter_totals(spark, sf):
    return monitor.counters(B.table(spark, sf, "events"), ["user_id"]).withColumn("total", F.round("total", 2))


@query("""WITH b AS (SELECT user_id, max(ts) AS started FROM events WHERE event_type = 'view' GROUP BY 1), e AS (SELECT user_id, min(ts) AS ended FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id AS invocation_id, CASE WHEN started IS NULL THEN 'generic' ELSE 'tool' END AS kind, CASE WHEN started IS NULL THEN 'unknown' ELSE 'view' END AS name, 'completed' AS status, round((epoch_us(ended) - epoch_us(coalesce(started, ended))) / 1000, 2) AS latency_ms FROM e LEFT JOIN b USING (user_id)""")
def invocations(spark, sf):
    e = B.table(spark, sf, "events")
    starts = e.filter("event_type = 'view'").select(F.col("user_id").alias("invocation_id"), F.lit("tool").alias("kind"), F.col("event_type").alias("name"), "ts")
    ends = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("invocation_id"), F.lit("").alias("status"), "ts")
    return monitor.invocations(starts, ends).select("invocation_id", "kind", "name", "status", "latency_ms")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own ' || event_id ELSE '2030' END AS timestamp FROM events")
def published_events(spark, sf):
    e = B.table(spark, sf, "events")
    own = F.create_map(F.lit("timestamp"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("own "), "event_id")).otherwise(""))
    return monitor.published(e.select("event_id", F.col("event_type").alias("type"), own.alias("payload")), F.lit("2030")).select("event_id", "timestamp")


@query("SELECT doc_id, len(text) > 200 AS cut, CASE WHEN len(text) > 200 THEN left(text, 200) || '...<truncated>' ELSE text END AS first, 2 AS n FROM documents")
def sanitised_results(spark, sf):
    d = B.table(spark, sf, "documents")
    payload = F.create_map(F.lit("b"), F.array("lang"), F.lit("a"), F.array("text", "source", "lang"), F.lit("c"), F.array("source"))
    s = monitor.sanitised(payload, 2, 200)
    return d.select("doc_id", (F.length("text") > 200).alias("cut"), s["a"][0].alias("first"), F.when(F.size(s) == 2, F.size(s["a"])).alias("n"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS json FROM nation""")
def json_rows(spark, sf):
    return monitor.json_safe(B.table(spark, sf, "nation").withColumn("none", F.lit(None).cast("string")), ["n_nationkey", "n_name", "none"])


@query("SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'graph_completed' ELSE 'base' END AS stage FROM documents")
def metadata_overlay(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("stage"), F.lit("base")).alias("metadata"))
    more = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("stage"), F.lit("graph_completed")))
    out = recovery.with_metadata(d, more)
    return out.select("doc_id", F.col("metadata")["source"].alias("source"), F.col("metadata")["stage"].alias("stage"))


@query("SELECT n_nationkey AS k, 1 AS entities, 0 AS relations, n_name AS name FROM nation")
def parsed_round_trip(spark, sf):
    n = B.table(spark, sf, "nation")
    entity = lambda name: F.struct(name.alias("name"), F.lit("nation").alias("type"), F.lit("").alias("description"))
    relation = F.struct(F.col("n_name").alias("subject"), F.lit(" ").alias("object"), F.lit("").alias("description"), F.lit("T").alias("relation_type"), F.lit(1).alias("confidence"))
    parsed = F.struct(F.array(entity(F.col("n_name")), entity(F.lit("  "))).alias("entities"), F.array(relation).alias("relations"), F.array().cast("array<string>").alias("errors"))
    back = n.select(F.col("n_nationkey").alias("k"), recovery.from_json(recovery.to_json(parsed)).alias("p"))
    return back.select("k", F.size("p.entities").alias("entities"), F.size("p.relations").alias("relations"), F.col("p.entities")[0]["name"].alias("name"))


@query("""SELECT 's' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'renamed ' || s_suppkey END AS canonical_name, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' ELSE 'firm' END AS type, CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE 'old' END AS description FROM supplier
UNION ALL SELECT 'new', 'New', '', ''""")
def entity_update(spark, sf):
    s = B.table(spark, sf, "supplier")
    key = F.concat(F.lit("s"), "s_suppkey")
    none = F.lit(None).cast("string")
    stored = s.select(key.alias("entity_id"), F.lit("g").alias("group_id"), F.lit("d").alias("doc_id"), F.col("s_name").alias("canonical_name"), F.lit("supplier").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit("old").alias("description"))
    changes = s.filter("s_suppkey % 2 = 1").select(key.alias("entity_id"), F.lit("g").alias("group_id"), F.lit("").alias("doc_id"), F.concat(F.lit("renamed "), "s_suppkey").alias("canonical_name"), F.lit("firm").alias("type"), F.lit(None).cast("array<string>").alias("aliases"), F.when(F.col("s_suppkey") % 4 == 1, "").alias("description"))
    more = spark.range(2).select(F.when(F.col("id") == 0, "new").otherwise("nameless").alias("entity_id"), F.lit("g").alias("group_id"), F.lit("d").alias("doc_id"), F.when(F.col("id") == 0, "New").alias("canonical_name"), none.alias("type"), F.lit(None).cast("array<string>").alias("aliases"), none.alias("description"))
    return recovery.updated_entity(stored, changes.unionByName(more)).select("entity_id", "canonical_name", "type", "description")


@query("SELECT p_name AS name FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name")
def fresh_skills(spark, sf):
    p = B.table(spark, sf, "part")
    shape = [F.col("p_partkey").alias("skill_md_mtime_ns"), F.col("p_size").cast("long").alias("skill_md_size"), F.lit(0).cast("long").alias("manifest_mtime_ns")]
    have = p.select(F.col("p_name").alias("name"), F.lit("").alias("metadata"), *shape, F.lit(0).cast("long").alias("manifest_size"))
    asked = p.select(F.col("p_name").alias("name"), *shape, F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0).cast("long").alias("manifest_size"))
    return skills.fresh(have, asked).select("name").distinct()


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part)")
def kept_skills(spark, sf):
    p = B.table(spark, sf, "part")
    first = p.agg(F.min("p_brand").alias("p_brand"))
    return skills.keep_only(p.select(F.col("p_name").alias("name")).distinct(), p.join(F.broadcast(first), "p_brand", "left_semi").select(F.col("p_name").alias("name")))


@query("SELECT n_nationkey AS k, '# ' || n_name || chr(10) || '- one two' || chr(10) || '1. use `x`' AS text FROM nation")
def skill_prompts(spark, sf):
    text = F.concat(F.lit("---\nname: x\n---\n# "), "n_name", F.lit("\nplain words\n\n-  one\t two\n- one two\n1. use `x`\n"))
    return B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), skills.compact_prompt(text).alias("text"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 2 THEN [0, 1, 2] ELSE [CAST(n_nationkey % 3 AS INTEGER), 2] END AS places FROM nation")
def rerank_replies(spark, sf):
    n = B.table(spark, sf, "nation")
    some = F.concat(F.lit('{"results": [{"index": '), F.col("n_nationkey") % 3, F.lit(', "relevance_score": 0.9}, {"index": 7}, {"index": 2, "score": "x"}]}'))
    return n.select(F.col("n_nationkey").alias("k"), F.transform(models.rerank_reply(F.when(F.col("n_nationkey") % 3 == 2, "busy").otherwise(some), F.lit(3)), lambda r: r["index"]).alias("places"))


@query("SELECT n_nationkey AS k, n_name || ' is big. ' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'It' END || ' grows.' AS text FROM nation")
def coreference_tagged(spark, sf):
    n = B.table(spark, sf, "nation")
    reply = F.concat(F.lit("so:\n<|item_start|> <|raw_start|>It<|raw_end|><|result_start|> "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(""), F.lit(" <|result_end|> <|item_end|>"))
    from .functions.text import replace_all

    return n.select(F.col("n_nationkey").alias("k"), replace_all(F.concat("n_name", F.lit(" is big. It grows.")), replies.tagged_replacements(reply)).alias("text"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n, n_nationkey % 2 = 1 AS failed FROM nation")
def coreference_json(spark, sf):
    n = B.table(spark, sf, "nation")
    reply = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('Here: [{"row": "It", "result": "'), "n_name", F.lit('"}, {"raw": "x"}, 5] done'))).otherwise('{"raw": "a"}')
    r = replies.json_replacements(replies.first_value(reply, "["))
    return n.select(F.col("n_nationkey").alias("k"), r.alias("r")).select("k", F.size("r.items").alias("n"), F.col("r.error").isNotNull().alias("failed"))


@query("SELECT n_regionkey AS cluster, n_name AS canonical_name, CASE WHEN n_regionkey % 2 = 0 THEN 'Country' ELSE 'nation' END AS type FROM nation")
def cluster_fusion(spark, sf):
    """A model's fusion of each cluster; where it fails, one entity of each name."""
    n = B.table(spark, sf, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.lit("").alias("description"))

    def fused(prompt):
        import json

        rows = json.loads(prompt)
        if rows[0]["cluster"] % 2:
            raise ValueError("busy")
        return json.dumps([{"canonical_name": r["name"], "type": "Country"} for r in rows])

    return resolution.fuse_clusters(n, ["cluster"], fused, tries=1).select("cluster", "canonical_name", "type")


@query("SELECT c_nationkey AS cluster, 'kind ' || c_custkey % 7 AS canonical_name, max(c_mktsegment) AS description, CAST(min(c_custkey) AS BIGINT) AS seq FROM customer GROUP BY 1, 2")
def cluster_fusion_tree(spark, sf):
    """Clusters beyond one prompt (of 2,000 characters), fused level by level by a model that merges equal names."""
    import json

    def merge(prompt):
        if len(prompt) > 2000:
            raise ValueError("the prompt is too long")
        best: dict[str, dict] = {}
        for r in json.loads(prompt):
            have = best.setdefault(r["name"], {"canonical_name": r["name"], "type": r["type"], "description": r["description"]})
            have["description"] = max(have["description"], r["description"])
        return json.dumps(list(best.values()))

    c = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").cast("long").alias("seq"), F.concat(F.lit("kind "), F.col("c_custkey") % 7).alias("name"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("description"))
    out = resolution.fuse_tree(c, ["cluster"], merge, 2000, tries=1, staged=written)
    # the model's entities have the first place of their part; that of the name is the least
    first = c.groupBy("cluster", F.col("name").alias("canonical_name")).agg(F.min("seq").alias("first"))
    return out.join(first, ["cluster", "canonical_name"]).select("cluster", "canonical_name", "description", F.col("first").alias("seq"))


@query(with_sql("emb") + f"SELECT chunk_id, round({_DOT}, 4) AS score FROM emb, q ORDER BY round({_DOT}, 6) DESC, pk LIMIT 20")
def inverted_lists(spark, sf):
    """Vector search over inverted lists: two are probed, then those whose bound reaches the k-th score, so it is exact."""
    e, q = B.embeddings(spark, sf), B.query_vector(spark, sf)
    c = ann.fit(e, "pk", 24)
    index = written(ann.build(e, c), "lists")
    reach = {r["list"]: (r["radius"], r["longest"]) for r in ann.radii(index, c, ["list"]).collect()}  # a row for each of 24 lists
    reached = ann.bounded(index, c, reach, q, 20, probes=2)
    some = index if reached is None else index.filter(F.col("list").isin(reached))
    return search.vector_top(some, q, 20, "pk", ["chunk_id"]).withColumn("score", F.round("score", 4))


@query(with_sql("ents", "rels") + "SELECT relation_id AS chunk_id, subject, object, 'l' || relation_id AS local_relation_id, 'g' || relation_id AS global_relation_id FROM rels WHERE relation_type = 'PART_OF'")
def relation_mentions(spark, sf):
    r = B.relations(spark, sf)
    found = r.select("group_id", "doc_id", F.col("relation_id").alias("chunk_id"), F.upper("subject").alias("subject"), "object", "relation_type", "description", F.lit("text").alias("chunk_text"))
    amap = r.select("group_id", "doc_id", F.col("subject").alias("alias"), F.col("subject").alias("canonical_name")).distinct()
    local = r.select("group_id", "doc_id", "subject", "object", "relation_type", F.concat(F.lit("l"), "relation_id").alias("relation_id"))
    overall = r.filter("relation_type = 'PART_OF'").select("group_id", "subject", "object", "relation_type", F.concat(F.lit("g"), "relation_id").alias("global_relation_id"))
    out = resolution.relation_mentions(found, amap, local, overall)
    # the mention tells the name as it was read; here that is upper case
    names = r.select(F.col("relation_id").alias("chunk_id"), F.col("subject").alias("_s"))
    return out.join(names, "chunk_id").select("chunk_id", F.col("_s").alias("subject"), "object", "local_relation_id", "global_relation_id")


@query(with_sql("rels") + "SELECT relation_id, relation_type AS name, subject || ' -[' || relation_type || ']-> ' || object || chr(10) || description AS text FROM rels")
def relation_index_text(spark, sf):
    return evidence.relation_index(B.relations(spark, sf)).select(F.col("source_id").alias("relation_id"), "name", "text")


@query(with_sql("ents", "rels") + """
SELECT relation_id, CASE WHEN confidence > 5 THEN 'merge_global_relation' ELSE 'create_global_relation' END AS method FROM rels""")
def relation_alignment(spark, sf):
    """Relations against a group's level that has those of confidence over 5."""
    from .functions import ids

    e = B.entities(spark, sf).select("group_id", "canonical_name").distinct().withColumn("global_entity_id", ids.global_entity_id(F.col("group_id"), F.col("canonical_name")))
    r = B.relations(spark, sf)
    known = resolution.merge_relations(r.filter("confidence > 5"), e)
    _, links = resolution.aligned_relations(r, e, known)
    return links.select(F.col("local_relation_id").alias("relation_id"), F.col("alignment_method").alias("method"))


@query("""SELECT s_suppkey AS k, s_name AS global_name, CASE WHEN s_suppkey % 2 = 0 THEN 'old words of it' ELSE 'new words, which are more' END AS description, 2 AS aliases FROM supplier""")
def level_merge(spark, sf):
    """Entities in upper case aligned with a level that has their names: longest descriptions, all names."""
    s = B.table(spark, sf, "supplier")
    none = F.array().cast("array<double>")
    key = F.concat(F.lit("g"), "s_suppkey")
    old = s.select(key.alias("global_entity_id"), F.lit("g").alias("group_id"), F.col("s_name").alias("canonical_name"), F.lit("supplier").alias("type"), F.array("s_name").alias("aliases"), F.lit("old words of it").alias("description"), none.alias("embedding"))
    text = F.when(F.col("s_suppkey") % 2 == 0, "new").otherwise("new words, which are more")
    new = s.select(F.lit("g").alias("group_id"), F.lit("d").alias("doc_id"), F.upper("s_name").alias("canonical_name"), F.lit("").alias("type"), F.array().cast("array<string>").alias("aliases"), text.alias("description"), none.alias("embedding"))
    merged = resolution.merged_level(resolution.align_group(new, old), old)
    return merged.select(F.substring("global_entity_id", 2, 20).cast("long").alias("k"), F.col("canonical_name").alias("global_name"), "description", F.size("aliases").alias("aliases"))


@query(with_sql("rels") + ", top AS (SELECT DISTINCT relation_id FROM und WHERE a IN (SELECT r_name FROM region)) SELECT relation_id FROM top ORDER BY relation_id LIMIT 200")
def incident_of_regions(spark, sf):
    names = [r.r_name for r in B.table(spark, sf, "region").select("r_name").collect()]  # the names that a caller asks for
    return graph.relations_by_entities(B.relations(spark, sf), B.entities(spark, sf), names).select("relation_id")


def _event_model(prompt: str) -> str:
    """Stands in for a model: lines are sentences, an event is a sentence's length."""
    import json

    task, _, rest = prompt.partition("\n\n")
    if task.startswith("Name"):
        return json.dumps({"resolved_text": rest})
    if task.startswith("Part"):
        return json.dumps({"sentences": [{"id": i, "sentence": line} for i, line in enumerate(rest.split("\n"), 1)]})
    if task.startswith("Give"):
        return json.dumps({"length": len(rest.split("\nsentence: ", 1)[1])})
    lengths = [e["length"] for e in json.loads(rest.rsplit("\nsentence_events: ", 1)[1])]
    return "so: " + json.dumps({"events": len(lengths), "length": sum(lengths), "last": lengths[-1]})


@query("""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE t <> '')
SELECT doc_id, count(*) AS events, CAST(sum(length(x)) AS BIGINT) AS total, CAST(arg_max(length(x), i) AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS error FROM l WHERE x <> '' GROUP BY 1
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'the text is empty' FROM d WHERE t = ''""")
def sentence_events(spark, sf):
    found = events.sentence_events(B.table(spark, sf, "documents").select("doc_id", "text"), _event_model, wait=0.0)
    told = F.try_parse_json("aggregated")
    member = lambda k: F.try_variant_get(told, f"$.{k}", "long")
    return found.select("doc_id", member("events").alias("events"), member("length").alias("total"), member("last").alias("last"), "error")
