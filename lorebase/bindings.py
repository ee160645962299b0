"""The store's records as views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    time = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    return d.select(F.col("source").alias("group_id"), F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc_"), "doc_id").alias("doc_name"), time.alias("doc_time"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each non-blank line."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = d.select(F.col("source").alias("group_id"), F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(lines).alias("chunk_index", "text"))
    return rows.select("group_id", "doc_id", F.concat("doc_id", F.lit("::chunk_"), (F.col("chunk_index") + 1).cast("string")).alias("chunk_id"), "chunk_index", "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat_ws(":", "label", "vec_id").alias("pk"), F.col("label").cast("string").alias("group_id"), (F.col("vec_id") % 97).cast("string").alias("doc_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are entities, odd ones relations; every third is of the group's level."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 2 == 0, "entity").otherwise("relation")
    doc = F.when(F.col("vec_id") % 3 == 0, "__global__").otherwise((F.col("vec_id") % 97).cast("string"))
    return e.select(F.concat(F.left(kind, F.lit(1)), F.lit(":"), "vec_id").alias("pk"), kind.alias("kind"), (F.col("label") % 2).cast("string").alias("group_id"), doc.alias("doc_id"), F.concat(F.lit("name "), "vec_id").alias("name"), "embedding")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, label: str, text: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.lit("trade").alias("group_id"), F.lit("d1").alias("doc_id"), F.col(label).alias("canonical_name"), F.lit(name).alias("type"), F.array(F.concat(F.lit(f"{name[0]}#"), F.col(key).cast("string"))).alias("aliases"), F.expr(text).alias("description"))

    out = of("customer", "c_custkey", "c_name", "concat('segment ', c_mktsegment)")
    for args in (("supplier", "s_suppkey", "s_name", "concat('nation ', s_nationkey)"), ("nation", "n_nationkey", "n_name", "concat('region ', n_regionkey)"), ("region", "r_regionkey", "r_name", "'region'")):
        out = out.unionByName(of(*args))
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def of(df: DataFrame, prefix: str, key: str, subject: str, obj: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("relation_id"), F.lit("trade").alias("group_id"), F.lit("d1").alias("doc_id"), F.col(subject).alias("subject"), F.col(obj).alias("object"), F.lit(kind).alias("relation_type"), F.concat(F.lit(f"{kind} "), F.col(key).cast("string")).alias("description"), (1 + F.col(key) % 10).cast("int").alias("confidence"))

    out = of(c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]), "cn:", "c_custkey", "c_name", "n_name", "LOCATED_IN")
    out = out.unionByName(of(s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]), "sn:", "s_suppkey", "s_name", "n_name", "LOCATED_IN"))
    return out.unionByName(of(n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]), "nr:", "n_nationkey", "n_name", "r_name", "PART_OF"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of the task user_id, by a status their type stands for."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.create_map(*(F.lit(x) for pair in {"click": "processing", "view": "queued", "purchase": "done", "signup": "Succeeded", "error": "error"}.items() for x in pair)), F.col("event_type"))
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id"), F.col("event_type").alias("stage"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "docs": "docs AS (SELECT source AS group_id, CAST(doc_id AS VARCHAR) AS doc_id, 'doc_' || doc_id AS doc_name, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS doc_time FROM documents)",
    "chunks": """lined AS (SELECT source AS group_id, CAST(doc_id AS VARCHAR) AS doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
chunks AS (SELECT group_id, doc_id, doc_id || '::chunk_' || i AS chunk_id, CAST(i - 1 AS INTEGER) AS chunk_index, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lined))""",
    "emb": "emb AS (SELECT label || ':' || vec_id AS pk, CAST(label AS VARCHAR) AS group_id, CAST(vec_id % 97 AS VARCHAR) AS doc_id, CAST(vec_id AS VARCHAR) AS chunk_id, embedding, vec_id FROM embeddings), q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)",
    "gidx": "gidx AS (SELECT (CASE WHEN vec_id % 2 = 0 THEN 'e' ELSE 'r' END) || ':' || vec_id AS pk, CASE WHEN vec_id % 2 = 0 THEN 'entity' ELSE 'relation' END AS kind, CAST(label % 2 AS VARCHAR) AS group_id, CASE WHEN vec_id % 3 = 0 THEN '__global__' ELSE CAST(vec_id % 97 AS VARCHAR) END AS doc_id, 'name ' || vec_id AS name, embedding FROM embeddings), q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)",
    "ents": """ents AS (SELECT 'trade' AS group_id, 'd1' AS doc_id, * FROM (
SELECT c_name AS canonical_name, 'customer' AS type, ['c#' || c_custkey] AS aliases, 'segment ' || c_mktsegment AS description FROM customer
UNION ALL SELECT s_name, 'supplier', ['s#' || s_suppkey], 'nation ' || s_nationkey FROM supplier
UNION ALL SELECT n_name, 'nation', ['n#' || n_nationkey], 'region ' || n_regionkey FROM nation
UNION ALL SELECT r_name, 'region', ['r#' || r_regionkey], 'region' FROM region))""",
    "rels": """rels AS (SELECT relation_id, 'trade' AS group_id, 'd1' AS doc_id, subject, object, relation_type, relation_type || ' ' || k AS description, CAST(1 + k % 10 AS INTEGER) AS confidence FROM (
SELECT 'cn:' || c_custkey AS relation_id, c_name AS subject, n_name AS object, 'LOCATED_IN' AS relation_type, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'sn:' || s_suppkey, s_name, n_name, 'LOCATED_IN', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'nr:' || n_nationkey, n_name, r_name, 'PART_OF', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)),
und AS (SELECT *, subject AS a, object AS b FROM rels UNION ALL SELECT *, object, subject FROM rels WHERE subject <> object)""",
    "steps": "steps AS (SELECT user_id AS task_id, event_id, event_type AS stage, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'Succeeded' WHEN 'error' THEN 'error' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS updated_at, value FROM events)",
    "msgs": "msgs AS (SELECT conv_id, turn, role, text AS content FROM conversations)",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + "\n"
