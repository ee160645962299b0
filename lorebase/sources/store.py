"""The store on disk: Parquet folders by group and part, and manifests that say which folders count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import GLOBAL
from ..operators.store import delete_document, empty, newest, upsert_table
from ..schemas import KEYS, LAID, SCHEMAS

#: Parts that a new store deals a group's rows to, so that a write touches few of them.
PARTS = 64
#: Manifests that are kept besides the current one.
KEPT = 5
_PLACE = ("group_id", "part")


def _fields(name: str) -> list[str]:
    depth, out = 0, [""]
    for c in SCHEMAS[name]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.split()[0] for f in out]


def part_key(name: str) -> str:
    """The column that parts a table: the document, or its last key where a table has none."""
    return "doc_id" if "doc_id" in _fields(name) else KEYS[name][-1]


def part_of(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(part_key(name)), F.lit(parts)).cast("int")


class Store:
    """Tables below a folder. Rows of a group and part lie in one folder; a write makes new folders for those it touches only.

    A manifest lists the folders of all tables. It is written last, under the next number: readers see all of a change
    or nothing, over all tables that `batch` spans, and a writer that dies leaves folders nobody reads. One writer at a
    time; the manifest has one line for each table, group and part.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        """parts: of a new store; one that is there already keeps its own."""
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: tuple[int, dict[str, dict[str, str]]] = (0, {})
        self.parts = int(self._stored().get("", {}).get("parts", parts))
        self._pending: dict[str, dict[str, str]] | None = None

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, pattern: str) -> list[str]:
        fs, p = self._fs(pattern)
        return sorted(x.getPath().toString() for x in (fs.globStatus(p) or ()))

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _versions(self) -> list[int]:
        return [int(x.rstrip("/").split("/")[-2]) for x in self._list(f"{self.root}/_manifests/*/_SUCCESS")]

    def _manifest(self) -> dict[str, dict[str, str]]:
        """By table: folder of a group and part -> version it is of."""
        if self._pending is not None:
            return self._pending
        return self._stored()

    def _stored(self) -> dict[str, dict[str, str]]:
        newest = max(self._versions(), default=0)
        if newest != self._seen[0]:
            out: dict[str, dict[str, str]] = {}
            for row in self.spark.read.text(f"{self.root}/_manifests/{newest}").collect():  # a line for each folder
                table, place, version = json.loads(row.value)
                out.setdefault(table, {})[place] = version
            self._seen = newest, out
        return self._seen[1]

    def _commit(self, manifest: dict[str, dict[str, str]]) -> None:
        if self._pending is not None:
            self._pending = manifest
            return
        known = self._versions()
        number = max(known, default=0) + 1
        self._delete(f"{self.root}/_manifests/{number}")  # what a writer left that died
        manifest = manifest | {"": {"parts": str(self.parts)}}
        lines = [(json.dumps([t, p, v]),) for t, places in manifest.items() for p, v in sorted(places.items())]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{self.root}/_manifests/{number}")
        for old in sorted(known)[:-KEPT]:
            self._delete(f"{self.root}/_manifests/{old}")

    @contextmanager
    def batch(self):
        """Writes inside count together, when the block ends without an error; reads inside see them."""
        if self._pending is not None:
            yield self
            return
        self._pending = self._manifest()
        try:
            yield self
            made = self._pending
        finally:
            self._pending = None
        self._commit(made)

    def vacuum(self) -> int:
        """Delete folders that no manifest names; how many there were."""
        used = {f"{t}/{v}" for t, places in self._manifest().items() for v in places.values()}
        for n in self._versions():
            used |= {f"{t}/{v}" for r in self.spark.read.text(f"{self.root}/_manifests/{n}").collect() for t, _, v in [json.loads(r.value)]}
        gone = [x for x in self._list(f"{self.root}/data/*/*") if "/".join(x.split("/")[-2:]) not in used]
        for x in gone:
            self._delete(x)
        return len(gone)

    # --- tables

    def _folder(self, name: str, group_id: str | None, part: int) -> str:
        one = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join([*([one("group_id", group_id)] if "group_id" in _fields(name) else []), one("part", str(part))])

    def _read(self, name: str, places: dict[str, str]) -> DataFrame:
        if not places:
            return empty(self.spark, name)
        base = f"{self.root}/data/{name}"
        paths = [f"{base}/{v}/{p}" for p, v in places.items()]
        return self.spark.read.schema(f"{SCHEMAS[name]}, part int, v string").option("basePath", base).parquet(*paths).select(*_fields(name))

    def read(self, name: str) -> DataFrame:
        """The whole table; a filter on group_id reads that group's folders only."""
        return self._read(name, self._manifest().get(name, {}))

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        version = f"v={uuid.uuid4()}"
        at = f"{self.root}/data/{name}/{version}"
        by = [c for c in _PLACE if c == "part" or c in _fields(name)]
        out = rows.select(*_fields(name), part_of(name, self.parts).alias("part"))
        # dealt by folder, but a folder with very many rows is split over tasks and files
        out = out.hint("rebalance", *by)
        (out.sortWithinPartitions(*by, LAID[name]) if name in LAID else out).write.partitionBy(*by).parquet(at)
        depth = len(by)
        return {"/".join(x.rstrip("/").split("/")[-depth:]): version for x in self._list(f"{at}/{'/'.join(f'{c}=*' for c in by)}")}

    def _put(self, name: str, rows: DataFrame, touched: set[str] | None = None) -> None:
        """Rows are all there is in the touched folders (None: in the table)."""
        made = self._write(name, rows)
        manifest = dict(self._manifest())
        kept = {p: v for p, v in manifest.get(name, {}).items() if touched is not None and p not in touched}
        self._commit(manifest | {name: kept | made})

    def _touched(self, name: str, rows: DataFrame) -> set[str]:
        by = [c for c in _PLACE if c == "part" or c in _fields(name)]
        found = rows.select(*[c for c in by if c != "part"], part_of(name, self.parts).alias("part")).distinct().collect()  # a row for each folder
        return {self._folder(name, r.group_id if "group_id" in by else None, r.part) for r in found}

    def _here(self, name: str, touched: set[str]) -> DataFrame:
        return self._read(name, {p: v for p, v in self._manifest().get(name, {}).items() if p in touched})

    @contextmanager
    def staged(self, rows: DataFrame):
        """The rows as files: what made them (a model, say) runs once, and what is read below isn't written to meanwhile."""
        at = f"{self.root}/_staging/{uuid.uuid4()}"
        rows.write.parquet(at)
        try:
            yield self.spark.read.schema(rows.schema).parquet(at)
        finally:
            self._delete(at)

    def replace(self, name: str, rows: DataFrame) -> None:
        self._put(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows beside those that are there, read together."""
        with self.staged(rows) as new:
            touched = self._touched(name, new)
            self._put(name, self._here(name, touched).unionByName(new.select(*_fields(name))), touched)

    def upsert(self, name: str, rows: DataFrame, sequence: str = "seq") -> None:
        """Merge by the table's keys; of rows of one key the last by `sequence` counts, without that column the greatest as text."""
        with self.staged(rows) as new:
            self._same_size(name, new)
            touched = self._touched(name, new)
            some = new if sequence in new.columns else new.withColumn(sequence, F.lit(0))
            self._put(name, upsert_table(name, self._here(name, touched), some, sequence), touched)

    def _same_size(self, name: str, rows: DataFrame) -> None:
        """Vectors of one table have one length, as a search compares them all: another is an error before anything is written."""
        if "embedding" not in _fields(name) or not (told := rows.filter("size(embedding) > 0").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first())[1]:
            return
        one = self.read(name).filter("size(embedding) > 0").select(F.size("embedding")).first()
        if len(sizes := {*told, *(one or ())}) > 1:
            raise ValueError(f"vectors of {name} have different sizes: {sorted(sizes)}")

    def forget_graph(self, documents: DataFrame) -> None:
        """Take away the graph of documents (group_id, doc_id), and what of their groups' level stood on them alone.

        Only global ids that these documents were aligned to are asked about: those that no other alignment names go, and
        their rows of the graph index with them.
        """
        scope = ["group_id", "doc_id"]
        with self.batch(), ExitStack() as stack:
            docs = stack.enter_context(self.staged(documents.select(*scope).distinct()))
            for kind, level, links in (("relation", "global_relations", "relation_alignments"), ("entity", "global_entities", "entity_alignments")):
                key = f"global_{kind}_id"
                held = self.read(links).join(docs.select("group_id").distinct(), "group_id", "left_semi")
                mine = held.join(docs, scope, "left_semi").select("group_id", key).distinct()
                alone = stack.enter_context(self.staged(mine.join(held.join(docs, scope, "left_anti"), ["group_id", key], "left_anti")))
                self.remove(links, docs)
                self.remove(level, alone)
                self.remove("graph_index", alone.select("group_id", F.lit(GLOBAL).alias("doc_id"), F.lit(kind).alias("kind"), F.col(key).alias("source_id")))
            for name in ("entities", "relations", "entity_mentions", "relation_mentions", "graph_index"):
                self.remove(name, docs)

    def merge_newest(self, name: str, rows: DataFrame, order: str = "updated_at") -> None:
        """Merge by the table's keys, stored rows too giving way only to later ones: merging twice, or late, changes nothing."""
        with self.staged(rows) as new:
            touched = self._touched(name, new)
            self._put(name, newest(self._here(name, touched), new, KEYS[name], order), touched)

    def remove(self, name: str, keys: DataFrame) -> None:
        """Without the rows that agree with any row of keys, whose columns are some of the table's."""
        on = keys.columns
        places = None
        if set(on) >= ({"group_id", part_key(name)} & set(_fields(name))):
            places = self._touched(name, keys)
        every = self._manifest().get(name, {})
        touched = set(every) if places is None else places & set(every)
        if touched:
            self._put(name, self._here(name, touched).join(keys.distinct(), on, "left_anti"), touched)

    def _of_group(self, name: str, group_id: str) -> set[str]:
        head = self._folder(name, group_id, 0).split("/")[0] + "/"
        return {p for p in self._manifest().get(name, {}) if p.startswith(head)}

    def delete_document(self, group_id: str, doc_id: str, graph_only: bool = False) -> bool:
        """Whether the document was there. Chunk vectors and its graph-index rows go with it; only its group is read."""
        names = ["documents", "chunks", "entities", "relations", "global_entities", "entity_alignments", "global_relations", "relation_alignments", "entity_mentions", "relation_mentions"]
        here = (F.col("group_id") == group_id) & (F.col("doc_id") == doc_id)
        own = {n: self._of_group(n, group_id) for n in [*names, "graph_index", "chunk_embeddings", "chunk_grams"]}
        tables = {n: self._here(n, own[n]) for n in names}
        was = not tables["documents"].filter(here).isEmpty()
        with self.batch():
            for name, rows in delete_document(tables, group_id, doc_id, graph_only).items():
                # a document's rows lie in one part of their table
                touched = own[name] & {self._doc_folder(name, group_id, doc_id)} if "doc_id" in _fields(name) else own[name]
                if rows is not tables[name] and touched:
                    self._put(name, self._here(name, touched).filter(~here) if "doc_id" in _fields(name) else rows, touched)
            for name in ["graph_index"] + ["chunk_embeddings", "chunk_grams"] * (not graph_only):
                touched = own[name] & {self._doc_folder(name, group_id, doc_id)}
                if touched:
                    self._put(name, self._here(name, touched).filter(~here), touched)
        return True if graph_only else was

    def _doc_folder(self, name: str, group_id: str, doc_id: str) -> str:
        part = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id)), F.lit(self.parts)).cast("int")).first()[0]
        return self._folder(name, group_id, part)

    def delete_group(self, group_id: str) -> None:
        """All rows of a group but its own record: its folders are left out of the manifest, no row is read."""
        manifest = self._manifest()
        out = {n: {p: v for p, v in places.items() if n in ("", "groups") or "group_id" not in _fields(n) or p not in self._of_group(n, group_id)} for n, places in manifest.items()}
        self._commit(out)

    def clear(self, names: Sequence[str] | None = None, really: bool = False) -> dict[str, int]:
        """How many folders of the tables would go (all tables without names); they go if `really`."""
        manifest = self._manifest()
        gone = {n: len(places) for n, places in manifest.items() if n and (names is None or n in names)}
        if really:
            self._commit({n: places for n, places in manifest.items() if n not in gone})
        return gone
