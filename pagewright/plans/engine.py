"""The engine: operations on a knowledge base of documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError, invalid, not_found
from pagewright.functions import text as tx
from pagewright.lineage import cut, drop, fetched, parts
from pagewright.operators import context, enrich, fulltext, fusion, graph, parse, query, taxonomy, vectors
from pagewright.plans import ports
from pagewright.plans.store import Tables, named, restored, stripped
from pagewright.sources import files

SEGMENTER_VERSION = 1
TEXT_LIMIT = 50_000
#: Failures that an ingestion's report names; all are counted, and ``found`` (see Engine.take) has all.
REPORTED = 1_000
#: Rows of a batch that aren't stored up to which they are broadcast: a number each.
LEFT_OUT = 1_000_000
#: Shares of the files behind a batch that get into the store one after another.
SHARES = 8
#: A whole index of more than PASS segments is made from so many shares of the documents in turn, so that only a share of its postings is shuffled at once.
PASS, PASSES = 100_000, 8
#: Hits up to which a search brings them to the driver on its way, rather than write them.
FEW = 1_000
STATES = ("STAGED", "INDEXING", "READY", "FAILED", "DELETED")
TRANSITIONS = {("STAGED", "INDEXING"), ("INDEXING", "READY"), ("INDEXING", "FAILED"), ("FAILED", "STAGED"), *((s, "DELETED") for s in STATES if s != "DELETED")}


def digest(text: str, digits: int = 16) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:digits]


def check_transition(before: str, after: str) -> None:
    if (before, after) not in TRANSITIONS:
        raise invalid(f"a document can't go from {before} to {after}")


@dataclass
class Engine:
    """Operations return plain values; ``frame_*`` methods return DataFrames for further work."""

    spark: SparkSession
    home: str
    embedder: ports.Embedder | None = None
    reranker: ports.Reranker | None = None
    config: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tables = Tables(self.spark, self.home)
        self._seen: tuple[int, dict] = (-1, {})
        self._lent = False

    # Writing documents.

    def init(self) -> dict:
        return {"home": self.home, "created": self.tables.init()}

    def add(self, path: str, parser: str = "auto") -> dict:
        """Ingest one file; content that is there already is not changed."""
        rows, report = self._ingest([path], parser, None)
        if report["failures"]:
            raise EngineError(report["failures"][0]["code"], report["failures"][0]["message"])
        doc = rows.select("doc_id").first()["doc_id"]
        now = self._document(doc)
        n = self.tables.rows("segments").where((F.col("doc_id") == doc) & (F.col("version_id") == now["version_id"])).select("segment_id").distinct().count()
        return {"doc_id": doc, "status": now["state"], "title": now["title"], "segments": n, "changed": report["added"] == 1}

    def ingest(self, dirs: list[str], max_files: int | None = None, parser: str = "auto") -> dict:
        """Ingest all files under directories: added, ready, failed and what failed."""
        for d in dirs:
            if not self.tables.files.is_dir(d):
                raise EngineError("E_IO", f"not a directory: {d}")
        return self._ingest(dirs, parser, max_files)[1]

    def _ingest(self, paths: list[str], parser: str, max_files: int | None) -> tuple[DataFrame, dict]:
        found = cut(files.documents(files.files(self.spark, paths, max_files=max_files), parser))
        return found, self.take(found)

    def take(self, found: DataFrame, index: bool = True) -> dict:
        """Store parsed documents (see ``files.documents``); equal contents count as ready, failures are reported.

        Without ``index`` no search finds them before the next ``reindex``: for a first load, which is indexed as a whole anyway.
        """
        self._outdated()
        # Parsed and written once, with what the index knows a document by; which rows are new follows from narrow columns, so that no text is shuffled.
        batch = uuid.uuid4().int >> 65
        stored = cut(stripped(found).withColumns({"batch": F.lit(batch), "no": F.monotonically_increasing_id(), "created_at": F.current_timestamp()}))
        heads = stored.select("doc_id", "source_uri", "error_code", "error", "no")
        bad, good = heads.where(F.col("error_code").isNotNull()), heads.where(F.col("error_code").isNull())
        # Of what is stored, only the rows of documents in this batch are looked at.
        known = self.tables.rows("documents").select("doc_id", "version_id", "state", "seq").join(good.select("doc_id").distinct(), "doc_id", "left_semi")
        known = known.groupBy("doc_id").agg(F.max_by("state", "seq").alias("now"), F.countDistinct("version_id").alias("n"))
        firsts = good.groupBy("doc_id").agg(F.min(F.struct("source_uri", "no"))["no"].alias("no"))
        chosen = cut(firsts.join(known, "doc_id", "left").where("now IS NULL OR now = 'DELETED'").select("no", "n"))
        left_out = cut(heads.select("no").join(chosen, "no", "left_anti"))
        added, left, again = chosen.count(), left_out.count(), not chosen.where("n IS NOT NULL").isEmpty()
        total, failed = good.count(), bad.count()
        rows = bad.select("source_uri", "error_code", "error").orderBy("source_uri").limit(REPORTED).collect()
        failures = [{"path": r["source_uri"], "code": r["error_code"], "message": r["error"]} for r in rows]
        few = F.broadcast if left <= LEFT_OUT else lambda x: x
        parser_version = F.coalesce(*(F.when(F.col("parser") == k, F.lit(v[0])) for k, v in parse.PARSERS.items()))

        def docs(_):
            # What has its place in the store goes, so that the texts don't stand on the disk twice.
            for part in parts(stored, SHARES):
                new = part.join(few(left_out), "no", "left_anti") if left else part
                new = new.join(chosen.where("n IS NOT NULL"), "no", "left") if again else new.withColumn("n", F.lit(None).cast("long"))
                version = tx.derived_id("ver", F.col("doc_id"), F.coalesce("n", F.lit(0)) + 1)
                yield new.select(
                    "doc_id", F.lit("READY").alias("state"), "title", "canonical_text", "source_uri", "source_hash", "parser", parser_version.alias("parser_version"),
                    F.lit(SEGMENTER_VERSION).alias("segmenter_version"), version.alias("version_id"), "blocks", "losses", "created_at", "batch", "no", "sliced",
                )
                drop(part)

        own = lambda written: written("documents").where(F.col("batch") == batch)
        tables = {"documents": docs} | {name: lambda written, make=make: [make(own(written), more=("version_id",))] for name, make in (("block_order", graph.order_of), ("block_edges", graph.edges_of))}
        if index:
            tables |= {name: lambda written, name=name: [self._index_rows(restored(own(written)), False)[name]] for name in ("postings", "lengths")}
        self.tables.commit(**tables)
        drop(stored, chosen, left_out)
        return {"added": added, "ready": total, "failed": failed, "failures": failures}

    def _index_rows(self, docs: DataFrame, whole: bool) -> dict[str, DataFrame]:
        """Rows of the full-text index of documents; of a ``whole`` index dealt out by term."""
        segments = graph.segments_of(docs, more=("batch", "no"))
        lens = segments.where(F.col("body").isNotNull()).select("doc_id", "seg_index", F.size(tx.terms(F.col("body"))).cast("bigint").alias("doc_len"), "batch", "no")
        rows = fulltext.packed(segments)
        return {"postings": fulltext.dealt(rows) if whole else rows, "lengths": lens}

    # Reading documents.

    def resolve(self, name: str) -> str:
        """A document's id from its id or its title; of several titles the first one added."""
        docs = self.tables.latest("documents", "title", "created_at")
        found = fetched(docs.where((F.col("doc_id") == name) | (F.col("title") == name)).orderBy(F.desc(F.col("doc_id") == name), "created_at", "first_seq", "doc_id").select("doc_id").limit(1))
        if not found:
            raise not_found(name)
        return found[0]["doc_id"]

    def _document(self, doc: str):
        r = self._latest_of(doc).first()
        if r is None:
            raise not_found(doc)
        return r

    def _current(self, docs: DataFrame, live: DataFrame, limit: int) -> DataFrame:
        """The current rows, with their texts, of the few documents ``docs``."""
        rows = self._with(self.tables.rows("documents"), "doc_id", docs, limit).where("state = 'READY'")
        return rows.join(live, ["doc_id", "version_id"], "left_semi").dropDuplicates(["doc_id"])

    def _latest_of(self, doc: str) -> DataFrame:
        """The current row of one document, with its text."""
        return self.tables.rows("documents").where(F.col("doc_id") == doc).orderBy(F.desc("seq")).limit(1)

    def read(self, id: str, mode: str = "text") -> dict:
        """A document's text (cut at a character after 50 000 bytes), blocks or outline."""
        doc = self._document(self.resolve(id))
        if mode == "text":
            text = doc["canonical_text"] or ""
            content: dict = {"text": parse.cut_bytes(text, TEXT_LIMIT), "truncated": len(text.encode()) > TEXT_LIMIT}
        elif mode == "blocks":
            content = {"blocks": [{"index": i, "kind": b["kind"], "span_start": b["span_start"], "span_end": b["span_end"], "body": b["text"]} for i, b in enumerate(doc["blocks"])]}
        elif mode == "outline":
            bodies = [b["text"].strip() for b in doc["blocks"]]
            content = {"lines": [f"[{i}] {x.splitlines()[0]}" for i, x in enumerate(x for x in bodies if x)]}
        else:
            raise invalid(f"unknown mode: {mode}")
        return {"doc_id": doc["doc_id"], "title": doc["title"], "state": doc["state"], "content": content}

    def frame_graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Blocks, reading order and edges of the current versions of all documents that are ready."""
        live = self._live()
        blocks = graph.exploded(self.tables.latest("documents").where("state = 'READY'"))
        order, edges = (self.tables.rows(n).join(live, ["doc_id", "version_id"], "left_semi").drop("seq", "version_id").distinct() for n in ("block_order", "block_edges"))
        return blocks, order, edges

    def list(self, limit: int = 100, tag: str | None = None, concept: str | None = None) -> dict:
        docs = self._filtered(self.tables.latest("documents", "title", "state", "source_uri", "created_at"), tag, concept, None)
        rows = docs.orderBy("created_at", "first_seq", "doc_id").limit(limit + 1).select("doc_id", "title", "state", "source_uri").collect()
        return {"documents": [r.asDict() for r in rows[:limit]], "truncated": len(rows) > limit}

    def _filtered(self, rows: DataFrame, tag: str | None, concept: str | None, doc: str | None) -> DataFrame:
        """Rows of documents with a tag, with a concept or one below it, or of one document."""
        if doc is not None:
            rows = rows.where(F.col("doc_id") == doc)
        if tag is not None:
            rows = rows.join(self.tables.latest("enrichments").where(F.array_contains("tags", tag.lower())).select("doc_id"), "doc_id", "left_semi")
        if concept is not None:
            below = self.tables.rows("concept_closure").where(F.col("ancestor") == concept).select(F.col("descendant").alias("concept_id"))
            wanted = below.unionByName(self.spark.createDataFrame([(concept,)], "concept_id string"))
            rows = rows.join(self.tables.latest("doc_concepts").join(wanted, "concept_id", "left_semi").select("doc_id"), "doc_id", "left_semi")
        return rows

    def transition(self, doc: str, state: str) -> str:
        """Put a document into another state; returns the state it had."""
        now = self._document(doc)
        check_transition(now["state"], state)
        self.tables.commit(documents=cut(self._latest_of(doc).withColumn("state", F.lit(state)).drop("seq")))
        return now["state"]

    def remove(self, id: str, purge: bool = False) -> dict:
        """Tombstone a document: no search finds it from then on. ``purge`` also drops it from the next index generation."""
        doc = self.resolve(id)
        before = self.transition(doc, "DELETED")
        if purge:
            self.reindex()
        return {"doc_id": doc, "previous_state": before}

    # Searching.

    def _live(self) -> DataFrame:
        return self.tables.latest("documents", "state", "version_id").where("state = 'READY'").select("doc_id", "version_id")

    def _once(self, what: str, make: Callable[[], Any]) -> Any:
        """What ``make`` gives, kept until something is published."""
        self._outdated()
        if what not in self._seen[1]:
            self._seen[1][what] = make()
        return self._seen[1][what]

    def _outdated(self) -> None:
        """Forget what is kept if something was published since. Its tables go, but for those that a returned DataFrame may read."""
        seq = self.tables.manifest()["seq"]
        if self._seen[0] != seq:
            if not self._lent:
                drop(*(x for x in self._seen[1].values() if hasattr(x, "cut_path")))
            self._seen, self._lent = (seq, {}), False

    def _few(self, rows: DataFrame, limit: int) -> DataFrame:
        """The rows of a result, computed: as a local table if they are few, else written."""
        if limit > FEW:
            return cut(rows)
        found = fetched(rows)
        out = self.spark.createDataFrame(found, rows.schema)
        out.found = found
        return out

    def _with(self, rows: DataFrame, column: str, of: DataFrame, limit: int) -> DataFrame:
        """Rows whose ``column`` is among that of a few others: by a filter that reaches the scan, else by a broadcast."""
        if limit <= FEW:
            return rows.where(F.col(column).isin(list({r[column] for r in of.found})))
        return rows.join(F.broadcast(of.select(column)), column, "left_semi")

    def frame_segments(self) -> DataFrame:
        """Segments of the current versions of all documents that are ready."""
        return graph.segments_of(self._ready(), more=("version_id",))

    def _ready(self) -> DataFrame:
        """The current rows, with their texts, of all documents that are ready."""
        return self.tables.latest("documents").where("state = 'READY'")

    def _lengths(self) -> DataFrame:
        """Lengths of the segments that searches may find, each once; kept until something is published."""

        def make() -> DataFrame:
            lens = self.tables.rows("lengths").drop("seq", "segment_id").join(self._once("live", lambda: cut(self._live())).select("doc_id"), "doc_id", "left_semi")
            if not self.tables.active("fts") or self.tables.added("fts"):
                lens = lens.groupBy("doc_id", "seg_index").agg(F.max(F.struct("batch", "no", "doc_len")).alias("r")).select("doc_id", "seg_index", "r.*")
            return cut(lens)

        return named(self._once("lengths", make))

    def _words(self, text: str, k: int, docs: DataFrame, whole: bool) -> DataFrame:
        """The best segments by words. Of the postings only those of the query's terms are joined or shuffled."""
        lens = self._lengths() if whole else self._lengths().join(docs, "doc_id", "left_semi")
        place = ["batch", "no", "seg_index"]
        hits = self.tables.rows("postings", query.reads(text)).select("term", "batch", F.inline("hits"))
        # Counted before the join, so that positions are shuffled for phrases only.
        hits = hits.select("term", "batch", "no", F.col("seg_index").cast("bigint").alias("seg_index"), F.size("positions").alias("tf"), "positions")
        posted = hits.join(lens.select(*place, "segment_id", "doc_len"), place).select("term", "segment_id", "tf", "positions", "doc_len")
        stats = self._once("stats", lambda: fulltext.corpus_stats(lens).first()) if whole else fulltext.corpus_stats(lens).first()
        return query.search(self.spark, query.Index(posted, lens.select("segment_id", "doc_len"), (stats["n_segments"], stats["avg_len"] or 1.0), lens.select("segment_id", "doc_id")), text, k)

    def _vectors(self, text: str, k: int, docs: DataFrame) -> DataFrame:
        about = self.tables.about("vectors")
        if about and about.get("fingerprint") != self.embedder.fingerprint():
            raise EngineError("E_FINGERPRINT_MISMATCH", "the vectors were made by another embedder: reindex them")
        return vectors.nearest(self.tables.rows("vectors").join(docs, "doc_id", "left_semi"), self.embedder.embed([text])[0], k)

    def frame_search(self, text: str, mode: str = "hybrid", limit: int = 10, *, tag: str | None = None, concept: str | None = None, doc: str | None = None, candidates: int | None = None) -> DataFrame:
        """Hits with their scores, ranks, document, body and block."""
        found = self._search(text, mode, limit, tag, concept, doc, candidates)
        self._lent = True
        return found

    def _search(self, text: str, mode: str, limit: int, tag: str | None = None, concept: str | None = None, doc: str | None = None, candidates: int | None = None) -> DataFrame:
        """frame_search() for a caller that is done with it before anything is published."""
        if mode not in ("bm25", "vector", "hybrid"):
            raise invalid(f"unknown mode: {mode}")
        has_vectors = self.embedder is not None and self.tables.active("vectors") > 0
        if mode == "vector" and not has_vectors:
            raise EngineError("E_SEARCH_FAILED", "there is no vector index or no embedder")
        live = self._once("live", lambda: cut(self._live()))
        docs = self._filtered(live.select("doc_id"), tag, concept, doc)
        k = candidates or limit
        empty = not text.strip() or limit <= 0
        words = self._words(text if mode != "vector" else "", k, docs, tag is concept is doc is None)
        near = self._vectors(text, k, docs) if mode != "bm25" and has_vectors and not empty else self.spark.createDataFrame([], "segment_id string, vector_score double, vector_rank int")
        fused = self._few(fusion.fuse(words, near, limit=max(0, limit)), limit)
        # Only the segments of hits go on, and only the blocks of their documents.
        at = self._with(self._lengths().select("segment_id", "doc_id"), "segment_id", fused, limit)
        if has_vectors:
            at = at.unionByName(self._with(self.tables.rows("vectors").select("segment_id", "doc_id"), "segment_id", fused, limit))
        at = self._few(at.select("doc_id").distinct(), limit)
        own = self._with(graph.segments_of(self._current(at, live, limit)), "segment_id", fused, limit)
        hits = self._few(fused.join(own.select("segment_id", "doc_id", "seg_index", "span_start", "span_end", "body"), "segment_id"), limit)
        blocks = graph.exploded(self._current(hits, live, limit))
        at = context.resolve_blocks(hits, blocks, "segment_id")
        kinds = blocks.select("doc_id", "block_idx", F.col("kind").alias("block_kind"))
        return hits.join(at, ["segment_id", "doc_id"]).join(kinds, ["doc_id", "block_idx"], "left")

    def search(self, query: str, mode: str = "hybrid", limit: int | None = None, expand: bool = False, max_blocks: int = 12, max_chars: int = 8000, rerank: bool = False, tag: str | None = None, concept: str | None = None, doc: str | None = None) -> dict:
        """The best segments; each hit is stored, so that it can be explained."""
        limit = int(self.config.get("search.limit", 10)) if limit is None else limit
        found = self._few(self._search(query, mode, limit, tag, concept, doc), limit)
        rows = sorted((r.asDict() for r in (found.found if limit <= FEW else found.collect())), key=lambda r: r["fused_rank"])
        info = {"bm25": mode != "vector", "vector": any(r["vector_rank"] for r in rows), "reranked": False}
        scores: dict[int, tuple[float, int]] = {}
        if rerank and self.reranker and rows:
            top = int(self.config.get("rerank.top_k", len(rows)))
            try:
                scores = {i: (float(s), n + 1) for n, (i, s) in enumerate(self.reranker(query, [r["body"] for r in rows], top))}
                info["reranked"] = True
            except Exception as e:  # a failing reranker leaves the fused order
                info["rerank_error"] = str(e)
        windows = {}
        if expand and rows:
            order = graph.exploded(self._current(found, self._once("live", lambda: cut(self._live())), limit)).select("doc_id", F.col("block_idx").alias("position"), F.col("canonical_text").alias("body"))
            hits = found.select("segment_id", "doc_id", F.col("block_idx").alias("position"))
            around = context.as_array(context.window(hits, order, "segment_id", max_blocks=max_blocks, max_chars=max_chars), "segment_id")
            windows = {r["segment_id"]: [x.asDict() for x in r["context_window"]] for r in around.collect()}
        gens = {"fts_gen": self.tables.active("fts"), "vec_gen": self.tables.active("vectors")}
        out = []
        for i, r in enumerate(rows):
            score, rank = scores.get(i, (None, None))
            out.append(r | {"result_id": f"res_{digest(query + ':' + r['segment_id'])}", "reranker_score": score, "reranker_rank": rank, "query": query, "query_digest": digest(query)} | gens)
        if out:
            names = [c.strip().split(" ")[0] for c in self._result_schema().split(",")]
            self.tables.log("search_results", self.spark.createDataFrame([tuple(r[c] for c in names) for r in out], self._result_schema()))
        out.sort(key=lambda r: (r["reranker_rank"] is None, r["reranker_rank"] or 0, r["fused_rank"]))
        hits = [
            {k: r[k] for k in ("result_id", "doc_id", "segment_id", "block_idx", "block_kind", "span_start", "span_end")}
            | {"snippet": snippet(r["body"]), "scores": {k: r[k] for k in ("bm25_score", "bm25_rank", "vector_score", "vector_rank", "fused_score", "fused_rank", "reranker_score", "reranker_rank")}, "context_window": windows.get(r["segment_id"])}
            for r in out
        ]
        return {"query": query, "mode": mode, "fts_generation": gens["fts_gen"], "hits": hits, "retrieval_info": info}

    @staticmethod
    def _result_schema() -> str:
        from pagewright.plans.store import SCHEMAS

        return SCHEMAS["search_results"]

    def explain(self, result_id: str) -> dict:
        """Where a stored hit's score comes from."""
        r = self.tables.latest("search_results").where(F.col("result_id") == result_id).first()
        if r is None:
            raise not_found(result_id)
        trace = {}
        for source in ("bm25", "vector"):
            rank = r[f"{source}_rank"]
            trace[source] = None if rank is None else {"rank": rank, "score": r[f"{source}_score"], "contribution": 1 / (fusion.K + rank)}
        trace["fused"] = {"score": r["fused_score"], "rank": r["fused_rank"], "k": fusion.K}
        trace["reranker"] = None if r["reranker_rank"] is None else {"rank": r["reranker_rank"], "score": r["reranker_score"]}
        return {k: r[k] for k in ("result_id", "query", "doc_id", "segment_id", "block_idx", "block_kind", "fts_gen", "vec_gen")} | {"retrieval_trace": trace}

    # Deriving.

    def enrich(self, id: str) -> dict:
        doc = self._document(self.resolve(id))
        if doc["state"] != "READY":
            raise invalid(f"document {doc['doc_id']} is in state {doc['state']}, it must be READY")
        rows = cut(enrich.enrich(self._latest_of(doc["doc_id"])))
        self.tables.commit(enrichments=rows)
        r = rows.first()
        return {"doc_id": r["doc_id"], "title": r["title"], "summary_length": len((r["summary"] or "").encode()), "tags": r["tags"]}

    def enrich_all(self) -> int:
        """Enrich every document that is ready, in one job."""
        rows = cut(enrich.enrich(self._ready()))
        self.tables.commit(enrichments=rows)
        n = rows.count()
        drop(rows)
        return n

    def reindex(self) -> dict:
        """Build a new generation of the full-text index from the segments of documents that are ready."""
        self._outdated()
        stale = self.tables.latest("documents", "segmenter_version").where(F.col("segmenter_version") != SEGMENTER_VERSION)
        stale = fetched(stale.agg(F.count("*")))[0][0]
        docs, about = self._ready(), {}

        def shares(lengths: DataFrame):
            about.update(fetched(lengths.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("segments")))[0].asDict())
            passes = PASSES if about["segments"] > PASS else 1
            for k in range(passes):
                yield self._index_rows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == k), True)["postings"]

        gen = self.tables.publish("fts", {"lengths": self._index_rows(docs, True)["lengths"], "postings": lambda written: shares(written("lengths"))}, lambda _: about)
        return {"index": "fts", "status": "ok", **about, "generation": gen, "stale_documents": stale}

    def reindex_vector(self) -> dict:
        """Embed all segments anew into a new generation of the vector index."""
        if self.embedder is None:
            raise EngineError("E_INDEX_BUILD_VEC", "no embedder is configured")
        self._outdated()
        n: dict[str, int] = {}

        def about(written) -> dict:
            rows = vectors.checked(written("vectors"), self.embedder.dimensions)
            n.update(fetched(rows.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("segments")))[0].asDict())
            return n | {"dimensions": self.embedder.dimensions, "fingerprint": self.embedder.fingerprint(), "checksum": vectors.checksum(rows)}

        gen = self.tables.publish("vectors", {"vectors": self.embedder.apply(self.frame_segments(), ("doc_id", "seg_index"))}, about)
        return {"index": "vector", "status": "ok", **n, "generation": gen}

    # Checking.

    def doctor(self) -> dict:
        """Checks of the knowledge base; healthy if its home, store and full-text index are."""
        checks: list[dict] = []

        def check(name: str, status: str, message: str) -> None:
            checks.append({"name": name, "status": status, "message": message})

        there = self.tables.files.exists(self.home)
        check("home_directory", "ok" if there else "fail", self.home if there else f"{self.home} does not exist")
        try:
            manifest = self.tables.manifest()
            states = {r["state"]: r["count"] for r in self.tables.latest("documents", "state").groupBy("state").count().collect()}
            check("store", "ok", f"the store holds {sum(states.values())} documents")
            check("schema_version", "ok", f"schema version {manifest['version']}")
            stuck = states.get("INDEXING", 0)
            check("document_states", "warn" if stuck else "ok", f"{stuck} documents are stuck in INDEXING" if stuck else f"{states.get('READY', 0)} documents are ready")
            missing = self.tables.latest("documents", "state", "parser", "parser_version").where("state = 'READY' AND (parser IS NULL OR parser_version IS NULL)").count()
            check("processing_fingerprints", "warn" if missing else "ok", f"{missing} documents lack a fingerprint")
            indexed = self.tables.rows("lengths").select("segment_id").distinct().join(self.frame_segments().select("segment_id"), "segment_id", "left_semi").count()
            segments = self.frame_segments().count()
            check("fts_index", "ok", f"the index covers {indexed} segments")
            check("fts_consistency", "ok" if indexed == segments else "fail", f"{indexed} of {segments} segments are indexed")
            about = self.tables.about("vectors")
            if about is None:
                check("vector_index", "warn", "there is no vector index")
            else:
                same = vectors.checksum(self.tables.rows("vectors")) == about["checksum"]
                check("vector_index", "ok" if same else "fail", f"{about['segments']} vectors, dims={about['dimensions']}" if same else "vectors differ from their checksum")
        except EngineError as e:
            check("store", "fail", e.message)
        needed = {"home_directory", "store", "fts_consistency"}
        return {"checks": checks, "healthy": needed <= {c["name"] for c in checks if c["status"] == "ok"}}

    # Taxonomy.

    def add_concept(self, scheme_uri: str, pref_label: str, alt_labels: tuple[str, ...] = (), definition: str | None = None) -> str:
        rows = cut(taxonomy.concepts_of(self.spark.createDataFrame([(scheme_uri, pref_label, [*alt_labels], definition, [], [], [])], taxonomy.IMPORT_SCHEMA)))
        self.tables.commit(concepts=rows)
        return rows.first()["concept_id"]

    def relate(self, from_id: str, to_id: str, relation: str = taxonomy.BROADER) -> None:
        known = self.tables.latest("concepts").where(F.col("concept_id").isin(from_id, to_id)).count()
        if known < len({from_id, to_id}):
            raise not_found(f"{from_id} or {to_id}")
        rows = self.spark.createDataFrame([(from_id, to_id, relation)], "from_id string, to_id string, relation string")
        self._closed(rows)
        self.tables.commit(concept_relations=rows)
        self.rebuild_closure()

    def _closed(self, more: DataFrame) -> DataFrame:
        """The closure with more relations; raises on a cycle."""
        all_ = self.tables.latest("concept_relations").select("from_id", "to_id", "relation").unionByName(more)
        return taxonomy.closure(taxonomy.hierarchy(all_))

    def import_concepts(self, path: str) -> dict:
        """Concepts first, then relations between concepts that exist; a cycle stops the import before it is published."""
        rows = cut(taxonomy.read_concepts(self.spark, path))
        concepts = cut(taxonomy.concepts_of(rows))
        before = self.tables.latest("concepts").select("concept_id")
        new = concepts.join(before, "concept_id", "left_anti")
        known = before.unionByName(concepts.select("concept_id")).distinct()
        relations = taxonomy.relations_of(rows)
        for side in ("from_id", "to_id"):
            relations = relations.join(known.withColumnRenamed("concept_id", side), side, "left_semi")
        relations = cut(relations.select("from_id", "to_id", "relation").join(self.tables.latest("concept_relations").select("from_id", "to_id", "relation"), ["from_id", "to_id", "relation"], "left_anti"))
        self._closed(relations)
        created, total, added = new.count(), concepts.count(), relations.count()
        self.tables.commit(concepts=new, concept_relations=relations)
        self.rebuild_closure()
        return {"created": created, "skipped": total - created, "relations": added}

    def rebuild_closure(self) -> int:
        none = self.spark.createDataFrame([], "from_id string, to_id string, relation string")
        return self.tables.publish("closure", {"concept_closure": self._closed(none)})

    def assign(self, id: str, concept_id: str, source: str = "manual") -> None:
        rows = self.spark.createDataFrame([(self.resolve(id), concept_id, source)], "doc_id string, concept_id string, source string")
        self.tables.commit(doc_concepts=rows)

    def concepts(self, limit: int = 100) -> list[dict]:
        return [r.asDict() for r in self.tables.latest("concepts").orderBy("concept_id").limit(limit).select("concept_id", "scheme_uri", "pref_label", "alt_labels", "definition").collect()]

    def relations(self, concept_id: str) -> list[dict]:
        rows = self.tables.latest("concept_relations").where((F.col("from_id") == concept_id) | (F.col("to_id") == concept_id))
        return [r.asDict() for r in rows.select("from_id", "to_id", "relation").orderBy("relation", "from_id", "to_id").collect()]

    def put_blobs(self, rows: DataFrame) -> int:
        """Store contents (column content) that aren't there yet, by hash."""
        blobs = rows.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
        new = cut(blobs.join(self.tables.rows("blobs").select("hash"), "hash", "left_anti"))
        self.tables.commit(blobs=new)
        return new.count()


def snippet(body: str, limit: int = 200) -> str:
    if len(body.encode()) <= limit:
        return body
    head = parse.cut_bytes(body, limit)
    return (head.rsplit(" ", 1)[0] if " " in head else head) + "..."


def run_id() -> str:
    return f"run_{uuid.uuid4().hex[:16]}"
