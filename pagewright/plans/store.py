"""Tables of a knowledge base: append-only Parquet, published by one manifest.

A write appends rows under the next sequence number and becomes visible when the manifest names
that number; of the rows of one key the latest wins. A reader never sees half a write, and a crash
leaves at most rows that no manifest names.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError
from pagewright.functions import text as tx
from pagewright.lineage import fetched, written_once
from pagewright.operators import fulltext, graph
from pagewright.operators.parse import BLOCK, LOSS
from pagewright.sources.files import Store

VERSION = 3
SCHEMAS = {
    "documents": f"doc_id string, state string, title string, canonical_text string, source_uri string, source_hash string, parser string, parser_version int, segmenter_version int, version_id string, blocks array<{BLOCK}>, losses array<{LOSS}>, created_at timestamp, batch long, no long",
    "block_order": "doc_id string, version_id string, position long, block_idx long",
    "block_edges": "doc_id string, version_id string, from_idx long, to_idx long, relation string",
    "enrichments": "doc_id string, title string, summary string, tags array<string>, provider string, content_hash string",
    "search_results": "result_id string, query string, query_digest string, doc_id string, segment_id string, block_idx long, block_kind string, bm25_score double, bm25_rank int, vector_score double, vector_rank int, fused_score double, fused_rank int, reranker_score double, reranker_rank int, fts_gen long, vec_gen long",
    "concepts": "concept_id string, scheme_uri string, pref_label string, alt_labels array<string>, definition string",
    "concept_relations": "from_id string, to_id string, relation string",
    "concept_closure": "ancestor string, descendant string, depth int",
    "doc_concepts": "doc_id string, concept_id string, source string",
    "blobs": "hash string, content binary",
    "postings": "term string, batch long, n int, docs binary, segs binary, tfs binary, places binary",
    "lengths": "doc_id string, seg_index long, doc_len long, batch long, no long",
    "vectors": "doc_id string, seg_index long, embedding array<float>",
}
KEYS = {
    "documents": ["doc_id"],
    "enrichments": ["doc_id"],
    "search_results": ["result_id"],
    "concepts": ["concept_id"],
    "concept_relations": ["from_id", "to_id", "relation"],
    "doc_concepts": ["doc_id", "concept_id"],
    "blobs": ["hash"],
    "vectors": ["segment_id"],
}
#: Tables whose rows carry whole texts: what of them is the latest is found by key alone.
WIDE = {"documents", "blobs", "vectors"}
#: Tables that no operation depends on; rows are appended to them without a lock and without a place in the manifest.
LOGS = {"search_results"}
#: What of a table is stored beside its columns.
BESIDE = {"documents": ", sliced boolean"}
#: Texts are most of the store, so they are compressed harder. Postings stay packed, as whole bytes compress better than Parquet's packed bits; sorted terms are stored by what differs from the one before.
OPTIONS = {"documents": {"parquet.compression.codec.zstd.level": "6"}, "postings": {"parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("term", "docs", "segs", "tfs", "places")}}
#: Replaced rows of a wide table up to which all others are read as they stand.
REPLACED = 1_000
GENERATIONS = {"fts": ("postings", "lengths"), "vectors": ("vectors",), "closure": ("concept_closure",)}


def stripped(docs: DataFrame) -> DataFrame:
    """Documents as they are stored: texts of blocks that are slices of the document's text, as their spans say, are left out."""
    same = F.transform(F.array(F.col("canonical_text").cast("binary")), lambda t: F.forall("blocks", lambda b: tx.slice_bytes(t, b["span_start"], b["span_end"]) == b["text"]))
    bare = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["span_start"].alias("span_start"), b["span_end"].alias("span_end"), F.lit(None).cast("string").alias("text")))
    return docs.withColumn("sliced", F.coalesce(same[0], F.lit(False))).withColumn("blocks", F.when(F.col("sliced"), bare).otherwise(F.col("blocks")))


def restored(docs: DataFrame) -> DataFrame:
    """What stripped() got. The text goes through an array, so that it is turned into bytes once and not for each block."""

    def of(t):
        return F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["span_start"].alias("span_start"), b["span_end"].alias("span_end"), tx.slice_bytes(t, b["span_start"], b["span_end"]).alias("text")))

    full = F.transform(F.array(F.col("canonical_text").cast("binary")), of)[0]
    return docs.withColumn("blocks", F.when(F.col("sliced"), full).otherwise(F.col("blocks"))).drop("sliced")


def named(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, seg_index) with the segment's id, which follows from them."""
    return rows.withColumn("segment_id", tx.derived_id("seg", F.col("doc_id"), F.col("seg_index")))


#: What turns stored rows into those that are read.
FINISHED = {"documents": restored, "lengths": named, "vectors": named, "postings": fulltext.unpacked}


class Tables:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.files = spark, home.rstrip("/"), Store(spark)
        self._replaced: dict[tuple[str, int], list | None] = {}

    @property
    def _manifest(self) -> str:
        return f"{self.home}/manifest.json"

    def init(self) -> bool:
        """Create the knowledge base; False if it is there."""
        self.files.make_dir(self.home)
        return self.files.create_new(self._manifest, json.dumps({"version": VERSION, "seq": 0, "active": {}, "generations": []}))

    def manifest(self) -> dict:
        if not self.files.exists(self._manifest):
            raise EngineError("E_NOT_FOUND", f"no knowledge base at {self.home}: init it first")
        try:
            found = json.loads(self.files.read(self._manifest))
        except ValueError as e:
            raise EngineError("E_STORE_CORRUPT", f"unreadable manifest: {e}") from None
        if found.get("version", 0) > VERSION:
            raise EngineError("E_SCHEMA_MIGRATION", f"version {found['version']} is newer than {VERSION}")
        if found.get("version", 0) < VERSION:
            raise EngineError("E_SCHEMA_MIGRATION", f"version {found.get('version', 0)} is older than {VERSION}: init a new knowledge base and ingest again")
        return found

    @contextmanager
    def writing(self, wait_s: float = 5.0):
        """The lock around a change of the manifest. The lock of a process that ended on this machine is stale."""
        path, began = f"{self.home}/write.lock", time.time()
        me = json.dumps({"host": os.uname().nodename, "pid": os.getpid()})
        while not self.files.create_new(path, me):
            try:
                other = json.loads(self.files.read(path))
                if other["host"] == os.uname().nodename and not os.path.exists(f"/proc/{other['pid']}"):
                    self.files.remove(path)
                    continue
            except Exception:  # the lock went or is being written
                pass
            if time.time() - began > wait_s:
                raise EngineError("E_LOCK_BUSY", "another process is writing")
            time.sleep(0.1)
        try:
            yield
        finally:
            self.files.remove(path)

    def _dir(self, name: str, generation: int | None = None) -> str:
        return f"{self.home}/tables/{name}" + (f"/gen={generation}" if generation is not None else "")

    def _write(self, name: str, df: DataFrame, seq: int, to: str) -> None:
        rows = df.select(*(c.strip().split(" ")[0] for c in _split(SCHEMAS[name])))
        if name == "documents":
            rows = df.select(*rows.columns, "sliced") if "sliced" in df.columns else stripped(rows)
        with written_once(self.spark):
            rows.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").options(compression="zstd", **OPTIONS.get(name, {})).parquet(to)

    def commit(self, **tables: DataFrame | Callable) -> int:
        """Append to several tables at once and publish; returns the sequence number.

        A table may be given by a function that makes its parts, which are written one after another.
        It gets a function that reads what this commit has written so far into tables that aren't indexes.
        """
        with self.writing():
            manifest = self.manifest()
            seq = manifest["seq"] + 1
            written = lambda name: self._read(name, self._dir(name)).where(F.col("seq") == seq)
            for name, df in tables.items():
                kind = next((k for k, names in GENERATIONS.items() if name in names), None)
                to = self._dir(name, manifest["active"].get(kind, 0) if kind else None)
                for part in [df] if isinstance(df, DataFrame) else df(written):
                    self._write(name, part, seq, to)
                if kind:
                    manifest.setdefault("appended", {})[kind] = manifest["active"].get(kind, 0)
            manifest["seq"] = seq
            self.files.write(self._manifest, json.dumps(manifest))
        return seq

    def publish(self, kind: str, tables: dict[str, DataFrame | Callable], about: Callable[[Callable], dict] = lambda written: {}) -> int:
        """Write a new generation of an index beside the active one, then switch to it.

        A table may be given by a function that makes its parts, which are written one after another.
        It and ``about``, which gives what the manifest is to know, get a function that reads the tables written so far.
        """
        with self.writing():
            manifest = self.manifest()
            gen = max([0, *(g["gen"] for g in manifest["generations"] if g["kind"] == kind)]) + 1
            seq = manifest["seq"] + 1
            written = lambda name: FINISHED.get(name, lambda x: x)(self.spark.read.schema(SCHEMAS[name]).parquet(self._dir(name, gen)))
            for name, df in tables.items():
                self.files.remove(self._dir(name, gen))  # of a build that broke off
                for part in [df] if isinstance(df, DataFrame) else df(written):
                    self._write(name, part, seq, self._dir(name, gen))
            manifest["seq"] = seq
            manifest["generations"].append({"kind": kind, "gen": gen} | about(written))
            manifest["active"][kind] = gen
            self.files.write(self._manifest, json.dumps(manifest))
        return gen

    def active(self, kind: str) -> int:
        return self.manifest()["active"].get(kind, 0)

    def added(self, kind: str) -> bool:
        """Whether rows were appended to the active generation of an index since it was built."""
        about = self.about(kind)
        return about is not None and self.manifest().get("appended", {}).get(kind) == about["gen"]

    def about(self, kind: str) -> dict | None:
        m = self.manifest()
        return next((g for g in m["generations"] if g["kind"] == kind and g["gen"] == m["active"].get(kind)), None)

    def _read(self, name: str, path: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}{BESIDE.get(name, '')}, seq long").parquet(path)

    def rows(self, name: str, where: Column | None = None) -> DataFrame:
        """All published rows of a table, of an index those of the active generation; with ``where`` those whose stored columns meet it. Segments are read from the documents, whose blocks they are."""
        if name == "segments":
            return graph.segments_of(self.rows("documents"), more=("version_id", "seq"))
        manifest = self.manifest()
        kind = next((k for k, names in GENERATIONS.items() if name in names), None)
        path = self._dir(name, manifest["active"].get(kind, 0) if kind else None)
        schema = f"{SCHEMAS[name]}{BESIDE.get(name, '')}, seq long"
        finished = FINISHED.get(name, lambda x: x)
        if not self.files.exists(path):
            return finished(self.spark.createDataFrame([], schema))
        if name in LOGS:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        found = self._read(name, path).where(F.col("seq") <= manifest["seq"])
        return finished(found if where is None else found.where(where))

    def log(self, name: str, df: DataFrame) -> None:
        """Append to a table of LOGS. Writers don't wait for one another, as each has a folder of its own; the latest row of a key is that written last by the clock."""
        columns = [c.strip().split(" ")[0] for c in _split(SCHEMAS[name])]
        df.select(*columns).withColumn("seq", F.lit(time.time_ns())).coalesce(1).write.option("compression", "zstd").parquet(f"{self._dir(name)}/{uuid.uuid4().hex}")

    def _few_replaced(self, name: str, rows: DataFrame) -> list | None:
        """The keys that have several rows, with the last and the first sequence number; None if they are many."""
        about = (name, self.manifest()["seq"])
        if about not in self._replaced:
            n = rows.groupBy(*KEYS[name]).agg(F.max("seq").alias("_last"), F.min("seq").alias("_first")).where("_last <> _first")
            found = fetched(n.limit(REPLACED + 1))
            self._replaced = {k: v for k, v in self._replaced.items() if k[0] != name} | {about: found if len(found) <= REPLACED else None}
        return self._replaced[about]

    def latest(self, name: str, *columns: str) -> DataFrame:
        """Per key the row written last, or some of its columns.

        Of a wide table without ``columns``, keys and sequence numbers are aggregated first. If few keys
        have several rows, these are broadcast and all others are read as they stand; else the rows
        themselves join the result, so texts of old versions are neither aggregated nor sorted.
        """
        rows, keys = self.rows(name), KEYS[name]
        rest = [c for c in rows.columns if c not in keys and c != "seq" and (not columns or c in columns)]
        if name in WIDE and not columns:
            heads = rows.groupBy(*keys).agg(F.max("seq").alias("seq"), F.min("seq").alias("first_seq"))
            few = self._few_replaced(name, rows)
            if few is None:
                return rows.join(heads, [*keys, "seq"]).select(*keys, *rest, "seq", "first_seq")
            if few:
                again = self.spark.createDataFrame(few, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _last long, _first long")
                rows = rows.join(F.broadcast(again), keys, "left").where("_last IS NULL OR seq = _last").withColumn("first_seq", F.coalesce("_first", "seq"))
            else:
                rows = rows.withColumn("first_seq", F.col("seq"))
            return rows.select(*keys, *rest, "seq", "first_seq")
        if not rest:
            return rows.select(*keys).distinct()
        best = F.max_by(F.struct(*rest), F.col("seq")).alias("r")
        return rows.groupBy(*keys).agg(best, F.max("seq").alias("seq"), F.min("seq").alias("first_seq")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), "seq", "first_seq")


def _split(schema: str) -> list[str]:
    """The fields of a schema text; commas inside angle brackets belong to a field."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]
