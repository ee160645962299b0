"""Record types of the store, as Spark schemas, with the key by which each is merged."""

from __future__ import annotations

_PARSED = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<subject:string,object:string,description:string,relation_type:string,confidence:int>>,errors:array<string>>"

SCHEMAS: dict[str, str] = {
    "groups": "group_id string, group_name string, group_desc string, created_at string",
    "documents": "group_id string, doc_id string, doc_name string, doc_time string, metadata map<string,string>",
    "chunks": "group_id string, doc_id string, chunk_id string, chunk_index int, text string",
    "chunk_grams": "group_id string, doc_id string, chunk_id string, gram string, n int",
    "chunk_embeddings": "pk string, group_id string, doc_id string, doc_time string, chunk_id string, embedding array<float>, list int",
    "entities": "entity_id string, group_id string, doc_id string, canonical_name string, type string, aliases array<string>, description string",
    "relations": "relation_id string, group_id string, doc_id string, subject string, object string, relation_type string, description string, confidence int",
    "global_entities": "global_entity_id string, group_id string, canonical_name string, type string, aliases array<string>, description string",
    "entity_alignments": "group_id string, doc_id string, local_entity_id string, global_entity_id string, local_name string, global_name string, alignment_method string, alignment_score double",
    "global_relations": "global_relation_id string, group_id string, subject_id string, object_id string, subject string, object string, relation_type string, description string, confidence int",
    "relation_alignments": "group_id string, doc_id string, local_relation_id string, global_relation_id string, subject string, object string, relation_type string, alignment_method string, alignment_score double",
    "entity_mentions": "mention_id string, group_id string, doc_id string, chunk_id string, entity_name string, entity_type string, description string, evidence_text string, local_entity_id string, global_entity_id string",
    "relation_mentions": "mention_id string, group_id string, doc_id string, chunk_id string, subject string, object string, relation_type string, description string, evidence_text string, local_relation_id string, global_relation_id string",
    "ingest_tasks": "task_id string, group_id string, doc_id string, doc_name string, doc_time string, status string, stage string, message string, created_at string, updated_at string, trace_id string, retry_count int, cancel_requested boolean, metadata map<string,string>",
    "chunk_checkpoints": f"group_id string, doc_id string, chunk_id string, chunk_index int, status string, resolved_text string, raw string, parsed {_PARSED}, error string, updated_at string",
    "pipeline_checkpoints": "group_id string, doc_id string, stage string, status string, payload map<string,string>, error string, updated_at string",
    "graph_index": "pk string, kind string, group_id string, doc_id string, source_id string, name string, text string, head_name string, tail_name string, relation_type string, embedding array<float>, list int",
    "vector_lists": "name string, list int, centroid array<float>",
    "list_radii": "group_id string, name string, list int, radius double, longest double",
    "skills": "name string, metadata string, skill_md_mtime_ns bigint, skill_md_size bigint, manifest_mtime_ns bigint, manifest_size bigint",
}

KEYS: dict[str, list[str]] = {
    "groups": ["group_id"],
    "documents": ["group_id", "doc_id"],
    "chunks": ["group_id", "chunk_id"],
    "chunk_grams": ["group_id", "chunk_id", "gram"],
    "chunk_embeddings": ["pk"],
    "entities": ["group_id", "doc_id", "canonical_name"],
    "relations": ["group_id", "relation_id"],
    "global_entities": ["group_id", "global_entity_id"],
    "entity_alignments": ["group_id", "doc_id", "local_entity_id"],
    "global_relations": ["group_id", "global_relation_id"],
    "relation_alignments": ["group_id", "doc_id", "local_relation_id"],
    "entity_mentions": ["mention_id"],
    "relation_mentions": ["mention_id"],
    "ingest_tasks": ["task_id"],
    "chunk_checkpoints": ["group_id", "doc_id", "chunk_id"],
    "pipeline_checkpoints": ["group_id", "doc_id", "stage"],
    "graph_index": ["pk"],
    "vector_lists": ["name", "list"],
    "list_radii": ["group_id", "name", "list"],
    "skills": ["name"],
}

#: The column by which a table's rows lie in their files: a search for a few of its values reads the pages that have them.
LAID: dict[str, str] = {"chunk_grams": "gram", "chunk_embeddings": "list", "graph_index": "list"}

#: Columns that a conflicting row keeps from the stored one.
IMMUTABLE: dict[str, list[str]] = {
    "groups": ["created_at"],
    "entity_mentions": ["group_id", "doc_id", "chunk_id"],
    "relation_mentions": ["group_id", "doc_id", "chunk_id"],
    "ingest_tasks": ["group_id", "doc_id", "doc_name", "doc_time", "created_at"],
}
