"""Deterministic name-based UUIDs (version 5) without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace under which every id is made.
NAMESPACE = "6b45223b-b3b8-4a2f-b7b7-3d6ad9d2f3f0"


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    part = lambda a, b: F.substring(h, a, b - a + 1)
    variant = F.lower(F.hex(F.conv(part(17, 18), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)).cast("long")))
    return F.concat(part(1, 8), F.lit("-"), part(9, 12), F.lit("-5"), part(14, 16), F.lit("-"), variant, part(19, 20), F.lit("-"), part(21, 32))


def entity_id(group: Column, doc: Column, name: Column) -> Column:
    return uuid5(F.concat_ws(":", group, doc, name))


def relation_id(group: Column, doc: Column, subject: Column, kind: Column, obj: Column) -> Column:
    return uuid5(F.concat_ws(":", group, doc, subject, kind, obj))


def global_entity_id(group: Column, name: Column) -> Column:
    return uuid5(F.concat_ws(":", group, F.lit("global"), name))


def global_relation_id(group: Column, subject_id: Column, kind: Column, object_id: Column) -> Column:
    return uuid5(F.concat_ws(":", group, F.lit("global_rel"), subject_id, kind, object_id))


def chunk_id(doc: Column, index: Column) -> Column:
    """`doc::chunk_i`, counted from 1 while chunk_index counts from 0."""
    return F.concat(doc, F.lit("::chunk_"), (index + 1).cast("string"))
