"""Queries that run the engine itself: a knowledge base is built from the driver's tables, and its operations answer.

The texts of documents are files whose lines are paragraphs; nations, regions and conversations
make Markdown, structured exports, taxonomies and block graphs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import queries as base
from pagewright.errors import EXIT_CODES, EngineError
from pagewright.functions import text as tx
from pagewright.functions.stats import nearest_rank
from pagewright.lineage import cut, fetched, shared_dir
from pagewright.operators import graph, parse, query, vectors
from pagewright.plans import dsl, ports, serve, spec
from pagewright.plans.config import Config
from pagewright.plans.engine import Engine
from pagewright.sources import files
from pagewright.streaming.ingest import watch

table = base.table
_built: dict[tuple[str, str, str], Engine] = {}


def _new(spark: SparkSession, name: str) -> Engine:
    engine = Engine(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", embedder=ports.hashed(32), reranker=ports.lexical)
    engine.init()
    return engine


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files (path, content) whose lines are paragraphs."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.format_string("in/%012d.txt", "doc_id").alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).cast("binary").alias("content"))


def _engine(spark: SparkSession, sf_dir: str, *needed: str) -> Engine:
    """The knowledge base of all documents, made once for a session and a folder; what else is ``needed`` of "enrichments", "words" and "vectors" is made when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, "documents")
    if key not in _built:
        engine = _new(spark, "kb")
        engine.report = engine.take(files.documents(_texts(spark, sf_dir)), index=False)
        engine.made = set()
        _built[key] = engine
    engine = _built[key]
    for name, make in (("enrichments", engine.enrich_all), ("words", engine.reindex), ("vectors", engine.reindex_vector)):
        if name in needed and name not in engine.made:
            make()
            engine.made.add(name)
    return engine


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Documents and segments.


def kb_documents(spark, sf_dir):
    """Every document's identity, title, state, version and parser."""
    docs = _engine(spark, sf_dir).tables.latest("documents", "state", "title", "version_id", "parser", "segmenter_version", "source_hash")
    return docs.select("doc_id", "state", "title", "version_id", "parser", "source_hash", F.col("segmenter_version").cast("long").alias("segmenter_version"))


def kb_ingest_report(spark, sf_dir):
    """Counters of the ingestion and of each index generation."""
    engine = _engine(spark, sf_dir, "words", "vectors")
    r, about = engine.report, [engine.tables.about(k) for k in ("fts", "vectors")]
    return _rows(spark, [(r["added"], r["ready"], r["failed"], *(x[k] for x in about for k in ("documents", "segments")))], "added long, ready long, failed long, fts_documents long, fts_segments long, vec_documents long, vec_segments long")


def kb_segments(spark, sf_dir):
    """Every segment of the current versions."""
    return _engine(spark, sf_dir).frame_segments().select("segment_id", "doc_id", "seg_index", "span_start", "span_end", "body")


def kb_states(spark, sf_dir):
    """Documents in each state after one is removed, one fails and one is staged again."""
    engine = _new(spark, "states")
    engine.take(files.documents(_texts(spark, sf_dir)))
    docs = [r["doc_id"] for r in fetched(engine.tables.latest("documents", "state").orderBy("doc_id").limit(3))]
    engine.remove(docs[0])
    return engine.tables.latest("documents", "state").groupBy("state").agg(F.count("*").alias("n"))


def kb_removed(spark, sf_dir):
    """What a search finds after the documents it found first are removed, and after one of them is added again."""
    engine = _new(spark, "removed")
    engine.take(files.documents(_texts(spark, sf_dir)))
    first = [h["doc_id"] for h in engine.search("the", "bm25", 3)["hits"]]
    for doc in sorted(set(first)):
        engine.remove(doc)
    gone = engine.search("the", "bm25", 3)["hits"]
    # Chosen before it is parsed: a condition on what the parser gives would parse all again.
    again = engine.take(files.documents(_texts(spark, sf_dir).where(tx.content_id("doc", F.col("content")) == sorted(set(first))[0])))
    n = engine.tables.rows("documents").where(F.col("doc_id") == sorted(set(first))[0]).select("version_id").distinct().count()
    engine.reindex()
    return _rows(spark, [(len(set(first) & {h["doc_id"] for h in gone}), again["added"], n, engine.tables.active("fts"))], "still_found long, added_again long, versions long, generation long")


def kb_list(spark, sf_dir):
    """The first hundred documents by time and id, and whether there are more."""
    got = _engine(spark, sf_dir).list(100)
    return _rows(spark, [(d["doc_id"], d["title"], d["state"], got["truncated"]) for d in got["documents"]], "doc_id string, title string, state string, truncated boolean")


def _a_document(engine: Engine) -> str:
    return engine.tables.latest("documents", "state").agg(F.min("doc_id")).first()[0]


def kb_blocks(spark, sf_dir):
    """The blocks of the document with the least id, as it is read."""
    engine = _engine(spark, sf_dir)
    got = engine.read(_a_document(engine), "blocks")["content"]["blocks"]
    return _rows(spark, [(b["index"], b["kind"], b["span_start"], b["span_end"], b["body"]) for b in got], "block_idx long, kind string, span_start long, span_end long, body string")


def kb_graph(spark, sf_dir):
    """The stored reading order and edges of every document, beside its blocks."""
    # Written as narrow tables, one after another, so that what was shuffled for one is gone before the next.
    blocks, order, edges = (cut(x.drop("kind", "canonical_text")) for x in _engine(spark, sf_dir).frame_graph())
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    found = n(blocks, "blocks").join(n(order, "places"), "doc_id", "left").join(n(edges, "edges"), "doc_id", "left")
    broken = cut(graph.violations(_engine(spark, sf_dir).tables.latest("documents").select("doc_id", "canonical_text"), blocks, order, edges))
    return found.join(broken.groupBy("doc_id").agg(F.count("*").alias("broken")), "doc_id", "left").fillna(0)


def kb_outline(spark, sf_dir):
    """Its outline, read by its title."""
    engine = _engine(spark, sf_dir)
    lines = engine.read(_a_document(engine), "outline")["content"]["lines"]
    return _rows(spark, list(enumerate(lines)), "position long, line string")


def kb_text(spark, sf_dir):
    """Its text, which is cut after 50 000 bytes."""
    engine = _engine(spark, sf_dir)
    content = engine.read(_a_document(engine))["content"]
    return _rows(spark, [(content["text"], content["truncated"])], "text string, truncated boolean")


def kb_enrichments(spark, sf_dir):
    """What enrichment derives for every document."""
    rows = _engine(spark, sf_dir, "enrichments").tables.latest("enrichments")
    return rows.select("doc_id", "title", F.char_length("summary").cast("long").alias("summary_chars"), F.size("tags").cast("long").alias("n_tags"), "provider", "content_hash")


def kb_transitions(spark, sf_dir):
    """Which state may follow which."""
    from pagewright.plans.engine import STATES, check_transition

    def allowed(a: str, b: str) -> bool:
        try:
            check_transition(a, b)
        except EngineError:
            return False
        return True

    return _rows(spark, [(a, b, allowed(a, b)) for a in STATES for b in STATES], "before string, after string, allowed boolean")


# Searching.

#: What kb_search asks, by number.
ASKED = ("license", "license version", "+license +version", "+license -version", "(license OR version) AND NOT that", '"under the"', '"the under"~2', "licen*", "[licence TO license]", "IN [license version]", "license^2 that", "nothingsuch", '"under th"*')


def kb_search(spark, sf_dir):
    """The best segments for queries of every kind."""
    engine, out = _engine(spark, sf_dir, "words"), None
    for n, text in enumerate(ASKED):
        hits = engine.frame_search(text, "bm25", 10).select(F.lit(n).cast("long").alias("asked"), "segment_id", F.round("bm25_score", 6).alias("score"), F.col("bm25_rank").cast("long").alias("place"))
        out = hits if out is None else out.unionByName(hits)
    return out


def kb_search_errors(spark, sf_dir):
    """Queries that can't be read, and their code."""
    out = []
    for text in ("(a", "a)", "a AND", "AND a", 'a "b', "title:x", "a ?", "+"):
        try:
            query.parse(text)
            out.append((text, "none"))
        except EngineError as e:
            out.append((text, e.code))
    return _rows(spark, out, "asked string, code string")


def kb_vector_search(spark, sf_dir):
    """Segments whose vectors are nearest to that of a text: the text itself first."""
    engine = _engine(spark, sf_dir, "words", "vectors")
    text = engine.frame_segments().agg(F.min("body")).first()[0]
    hits = engine.frame_search(text, "vector", 5)
    return hits.join(engine.frame_segments().select("segment_id"), "segment_id", "left_semi").select(F.col("vector_rank").cast("long").alias("place"), F.round("vector_score", 6).alias("score"), "segment_id")


def kb_hybrid(spark, sf_dir):
    """Hits of words and vectors, fused; with the block that each stands for."""
    engine = _engine(spark, sf_dir, "words", "vectors")
    text = engine.frame_segments().where("body LIKE '% % % %' AND octet_length(body) < 200").agg(F.min("body")).first()[0]
    hits = engine.frame_search(text, "hybrid", 8)
    ranks = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bm25_rank", "vector_rank"))
    fused = F.coalesce(1 / (60 + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("vector_rank")), F.lit(0.0))
    checked = hits.select("segment_id", *ranks, F.col("fused_rank").cast("long").alias("fused_rank"), (F.abs(fused - F.col("fused_score")) < 1e-12).alias("adds_up"), (F.col("block_idx") == F.col("seg_index")).alias("own_block"), "block_kind")
    sources = F.max(F.when(F.col("fused_rank") == 1, (F.col("bm25_rank") == 1) & (F.col("vector_rank") == 1)))
    return checked.groupBy("adds_up", "own_block", "block_kind").agg(F.count("*").alias("n"), F.min("fused_rank").alias("first"), F.max("fused_rank").alias("last"), sources.alias("best_by_both"))


def kb_search_expanded(spark, sf_dir):
    """A search's hits with the blocks around them, and snippets."""
    got = _engine(spark, sf_dir, "words").search("license version", "bm25", 10, expand=True, max_blocks=3, max_chars=400)
    rows = [(h["segment_id"], h["block_idx"], w["position"], w["is_hit"], h["snippet"]) for h in got["hits"] for w in h["context_window"]]
    return _rows(spark, rows, "segment_id string, block_idx long, position long, is_hit boolean, snippet string")


def kb_explain(spark, sf_dir):
    """Each hit of a search, explained from what was stored of it."""
    engine, out = _engine(spark, sf_dir, "words"), []
    for h in engine.search("license version", "bm25", 10)["hits"]:
        e = engine.explain(h["result_id"])
        t = e["retrieval_trace"]
        out.append((e["result_id"], e["doc_id"], e["segment_id"], t["bm25"]["rank"], round(t["bm25"]["contribution"], 9), t["vector"] is None, t["fused"]["rank"], e["fts_gen"]))
    return _rows(spark, out, "result_id string, doc_id string, segment_id string, place long, contribution double, no_vector boolean, fused_rank long, fts_gen long")


def kb_rerank(spark, sf_dir):
    """A search reranked by the share of its words in each hit."""
    got = _engine(spark, sf_dir, "words").search("license version", "bm25", 10, rerank=True)
    rows = [(h["scores"]["reranker_rank"], round(h["scores"]["reranker_score"], 6)) for h in got["hits"]]
    return _rows(spark, [(len(rows), [r for r, _ in rows] == list(range(1, len(rows) + 1)), all(a[1] >= b[1] for a, b in zip(rows, rows[1:], strict=False)), got["retrieval_info"]["reranked"])], "n long, in_order boolean, falling boolean, reranked boolean")


def kb_doctor(spark, sf_dir):
    """The checks of a sound knowledge base."""
    got = _engine(spark, sf_dir, "words", "vectors").doctor()
    return _rows(spark, [(c["name"], c["status"], got["healthy"]) for c in got["checks"]], "name string, status string, healthy boolean")


def kb_snippets(spark, sf_dir):
    """Every segment's snippet."""
    return _engine(spark, sf_dir).frame_segments().select("segment_id", tx.snippet(F.col("body")).alias("snippet"))


# Filters and taxonomy.


def _taxonomy(spark: SparkSession, sf_dir: str) -> Engine:
    """A knowledge base of regions and nations: one document for each nation, concepts for both."""
    key = (spark.sparkContext.applicationId, sf_dir, "taxonomy")
    if key not in _built:
        engine = _new(spark, "taxonomy")
        nations = table(spark, sf_dir, "nation")
        engine.take(files.documents(nations.select(F.format_string("n/%04d.txt", F.col("n_nationkey").cast("int")).alias("path"), F.concat(F.lit("# Land "), "n_name", F.lit("\n\n## Region "), F.col("n_regionkey").cast("string"), F.lit("\n\nA land.")).cast("binary").alias("content"))))
        engine.enrich_all()
        rows = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
        regions = sorted({r["r_name"] for r in rows})
        concepts = [{"scheme_uri": "lands", "pref_label": r["n_name"], "alt_labels": [r["n_name"].lower()], "broader": [r["r_name"]]} for r in rows]
        concepts += [{"scheme_uri": "lands", "pref_label": r, "broader": ["World"]} for r in regions] + [{"scheme_uri": "lands", "pref_label": "World", "definition": "all", "related": ["nowhere"]}]
        path = f"{engine.home}-concepts.json"
        engine.tables.files.write(path, json.dumps(concepts))
        engine.imported = engine.import_concepts(path)
        titles = engine.tables.latest("documents", "title").select("doc_id", F.replace("title", F.lit("# Land "), F.lit("")).alias("pref_label"))
        engine.tables.commit(doc_concepts=titles.join(engine.tables.latest("concepts"), "pref_label").select("doc_id", "concept_id", F.lit("import").alias("source")))
        _built[key] = engine
    return _built[key]


def kb_concepts(spark, sf_dir):
    """Concepts as they were imported."""
    rows = _taxonomy(spark, sf_dir).tables.latest("concepts")
    return rows.select("concept_id", "scheme_uri", "pref_label", F.array_join("alt_labels", "|").alias("alt_labels"), "definition")


def kb_import_report(spark, sf_dir):
    engine = _taxonomy(spark, sf_dir)
    r = engine.imported
    return _rows(spark, [(r["created"], r["skipped"], r["relations"], len(engine.concepts(5)))], "created long, skipped long, relations long, listed long")


def kb_closure(spark, sf_dir):
    """Ancestors of every concept, from the published generation."""
    rows = _taxonomy(spark, sf_dir).tables.rows("concept_closure")
    return rows.select("ancestor", "descendant", F.col("depth").cast("long").alias("depth"))


def kb_cycle(spark, sf_dir):
    """A relation that would close a cycle, one to a concept that isn't there, and one that is there already."""
    engine = _taxonomy(spark, sf_dir)
    ids = {r["pref_label"]: r["concept_id"] for r in engine.tables.latest("concepts").collect()}
    region = min(k for k in ids if k not in ("World",) and engine.relations(ids[k]) and any(x["to_id"] == ids["World"] for x in engine.relations(ids[k])))
    out = []
    for name, a, b in (("cycle", ids["World"], ids[region]), ("unknown", "con_none", ids["World"])):
        try:
            engine.relate(a, b)
            out.append((name, "none"))
        except EngineError as e:
            out.append((name, e.code))
    return _rows(spark, out, "tried string, code string")


def kb_by_concept(spark, sf_dir):
    """Documents under each region's concept, and all under the world."""
    engine, out = _taxonomy(spark, sf_dir), None
    wanted = engine.tables.latest("concepts").where("pref_label = 'World' OR pref_label NOT LIKE 'NATION%'").select("concept_id", "pref_label").collect()
    for r in wanted:
        docs = engine._filtered(engine.tables.latest("documents", "title"), None, r["concept_id"], None)
        part = docs.select(F.lit(r["pref_label"]).alias("concept"), "title")
        out = part if out is None else out.unionByName(part)
    return out


def kb_by_tag(spark, sf_dir):
    """Documents with the tag of one region, and a search within them."""
    engine = _taxonomy(spark, sf_dir)
    listed = [d["title"] for d in engine.list(100, tag="Region 1")["documents"]]
    found = [h["doc_id"] for h in engine.search("land", "bm25", 100, tag="region 1")["hits"]]
    titles = {r["doc_id"]: r["title"] for r in engine.tables.latest("documents", "title").collect()}
    return _rows(spark, [(t, t in {titles[d] for d in found}) for t in listed], "title string, found boolean")


def kb_of_document(spark, sf_dir):
    """A search within one document, which its title names."""
    engine = _taxonomy(spark, sf_dir)
    doc = engine.resolve("# Land NATION_3")
    return _rows(spark, [(h["block_idx"], h["block_kind"]) for h in engine.search("land OR region", "bm25", 10, doc=doc)["hits"]], "block_idx long, block_kind string")


# Parsers.


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: F.col(x).cast("string")
    parts = (
        F.lit("---\nkind: land\n---\n# **"), s("n_name"), F.lit("** of _region_ "), s("n_regionkey"), F.lit("\n\nKnown as `N"), s("n_nationkey"), F.lit("` and [elsewhere](http://x/y) too,\nover two lines.\n\n## Facts\n\n- number "), s("n_nationkey"),
        F.lit("\n- region "), s("n_regionkey"), F.lit("\n\n1. first\n2. second\n\n```py\nx = "), s("n_nationkey"), F.lit("\n\ny = 2\n```\n\nUnderlined\n==========\n\n> quoted words\n\n***\n\nLast \\*one\\*.\n"),
    )
    return table(spark, sf_dir, "nation").select(F.format_string("n/%04d.md", F.col("n_nationkey").cast("int")).alias("path"), F.concat(*parts).cast("binary").alias("content"))


def markdown_blocks(spark, sf_dir):
    """Blocks of Markdown files."""
    docs = files.documents(_markdown(spark, sf_dir))
    return docs.select("source_uri", F.posexplode("blocks").alias("pos", "b")).select("source_uri", F.col("pos").cast("long").alias("block_idx"), "b.kind", "b.span_start", "b.span_end", "b.text")


def markdown_documents(spark, sf_dir):
    """Their titles and texts: every block's span slices the text back to the block."""
    docs = files.documents(_markdown(spark, sf_dir))
    same = F.forall("blocks", lambda b: tx.slice_bytes(F.col("canonical_text"), b["span_start"], b["span_end"]) == b["text"])
    return docs.select("source_uri", "title", "parser", same.alias("spans_hold"), F.size("blocks").cast("long").alias("n_blocks"), "error_code")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured export for each region: headings, texts, a list in a group, a table of its nations, a picture."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    ref = lambda kind, k: F.struct(F.concat(F.lit(f"#/{kind}/"), F.lit(k).cast("string")).alias("$ref"))
    item = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    texts = F.array(item("section_header", F.concat(F.lit("  Region "), "r_name", F.lit(" "))), item("text", F.lit("Intro.")), item("list_item", F.concat(F.size("n").cast("string"), F.lit(" lands"))), item("caption", F.lit("The lands")), item("footnote", F.lit("note")), item("code", F.lit("x = 1")), item("strange", F.lit("other")), item("text", F.lit("   ")))
    cell = lambda text, r, c: F.struct(text.alias("text"), r.alias("row_index"), F.lit(c).alias("col_index"))
    cells = F.flatten(F.transform("n", lambda x, i: F.array(cell(x["n_nationkey"].cast("string"), i, 0), cell(x["n_name"], i, 1))))
    grid = F.struct(F.struct(F.size("n").alias("num_rows"), F.lit(2).alias("num_cols"), cells.alias("table_cells")).alias("data"))
    none = F.struct(F.struct(F.lit(0).alias("num_rows"), F.lit(0).alias("num_cols"), F.filter(cells, lambda x: F.lit(False)).alias("table_cells")).alias("data"))
    group = F.struct(F.array(ref("texts", 2), ref("texts", 99)).alias("children"))
    body = F.struct(F.array(ref("texts", 0), ref("texts", 1), ref("groups", 0), ref("tables", 0), ref("texts", 3), ref("pictures", 0), ref("tables", 1), ref("texts", 4), ref("texts", 5), ref("texts", 6), ref("texts", 7)).alias("children"))
    doc = F.struct(F.lit("DoclingDocument").alias("schema_name"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("report "), "r_name")).alias("name"), texts.alias("texts"), F.array(grid, none).alias("tables"), F.array(F.struct(F.lit("p").alias("id"))).alias("pictures"), F.array(group).alias("groups"), body.alias("body"))
    return rows.select(F.format_string("r/%04d.json", F.col("r_regionkey").cast("int")).alias("path"), F.to_json(doc).cast("binary").alias("content"))


def structured_blocks(spark, sf_dir):
    """Blocks of structured exports, in the order of their body."""
    docs = files.documents(_exports(spark, sf_dir))
    return docs.select("source_uri", "title", F.posexplode("blocks").alias("pos", "b")).select("source_uri", "title", F.col("pos").cast("long").alias("block_idx"), "b.kind", "b.text")


def structured_losses(spark, sf_dir):
    """What they hold that is no text."""
    docs = files.documents(_exports(spark, sf_dir))
    return docs.select("source_uri", F.posexplode("losses").alias("pos", "l")).select("source_uri", F.col("pos").cast("long").alias("loss_idx"), "l.kind", F.col("l.span_start").isNull().alias("no_span"))


def parser_errors(spark, sf_dir):
    """Files that don't parse, and files whose parser isn't there, with their codes."""
    rows = [("a.txt", b"\xff\xfe"), ("b.md", b"\xff"), ("c.json", b"{"), ("d.json", b"[]"), ("e.pdf", b"%PDF"), ("f.txt", b"fine"), ("g.unknown", b"fine"), ("h.MD", b"# fine")]
    docs = files.documents(_rows(spark, rows, "path string, content binary"))
    return docs.select("source_uri", "parser", F.coalesce("error_code", F.lit("none")).alias("code"), "title")


def pdf_documents(spark, sf_dir):
    """PDF files under an extractor that gives their text: title, blocks, and the loss of files with little text."""
    before = parse.PARSERS["pdf"]
    try:
        parse.register("pdf", parse.pdf_blocks(lambda data: data.decode().rstrip("%")), 1, "E_PARSE_PDF")
        docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
        short = F.col("doc_id") % 3 == 0
        text = F.when(short, F.rpad(F.concat(F.lit("page "), F.col("doc_id").cast("string")), 10_001, "%")).otherwise(F.replace("text", F.lit("%"), F.lit("")))
        found = files.documents(docs.select(F.format_string("p/%012d.pdf", "doc_id").alias("path"), text.cast("binary").alias("content")))
        return found.select("source_uri", F.octet_length("title").cast("long").alias("title_bytes"), F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("losses", lambda x: x["kind"]), "|").alias("losses"))
    finally:
        parse.PARSERS["pdf"] = before


def graph_rules(spark, sf_dir):
    """Graphs of conversations that each break one rule, and the rules found broken."""
    blocks = base._turns(spark, sf_dir).withColumnRenamed("body", "canonical_text").select("doc_id", "block_idx", "canonical_text", "span_start", "span_end")
    docs = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "canonical_text"))), lambda x: x["canonical_text"]), "\n\n").alias("canonical_text"))
    order = graph.reading_order(blocks, ["doc_id"])
    edges = graph.chain(order, ["doc_id"])
    rule = F.col("doc_id") % 7
    last = blocks.groupBy("doc_id").agg(F.max("block_idx").alias("last"))
    blocks = blocks.withColumn("span_end", F.when(rule == 1, F.col("span_end") + 1_000_000).otherwise(F.col("span_end")))
    order = order.withColumn("block_idx", F.when((rule == 2) & (F.col("position") == 0), F.lit(999)).otherwise(F.col("block_idx")))
    order = order.unionByName(order.where((rule == 3) & (F.col("position") == 0)).withColumn("position", F.lit(100)))
    order = order.join(last, "doc_id").where(~((rule == 4) & (F.col("block_idx") == F.col("last")))).drop("last")
    edges = edges.unionByName(edges.where((rule == 5) & (F.col("from_idx") == 0)).withColumn("to_idx", F.lit(999)))
    turned = (rule == 6) & (F.col("from_idx") == 0)
    edges = edges.select("doc_id", F.when(turned, F.col("to_idx")).otherwise(F.col("from_idx")).alias("from_idx"), F.when(turned, F.col("from_idx")).otherwise(F.col("to_idx")).alias("to_idx"), "relation")
    return graph.violations(docs, blocks, order, edges)


# Sources and sinks.


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files, one for each nation, beside files of another suffix."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n"), F.concat(F.lit("land "), "n_name").alias("value")).coalesce(1)
    rows.write.partitionBy("n").text(f"{path}/in")
    rows.select("n").write.csv(f"{path}/in/other")
    return path


def file_walk(spark, sf_dir):
    """Files under a folder by suffix, the first five of them by path, and one named itself."""
    path = f"{_written(spark, sf_dir)}/in"
    n = F.regexp_extract("path", r"/n=(\d+)/", 1).cast("long").alias("n")
    all_ = files.files(spark, [path]).select(F.lit("all").alias("asked"), n, F.col("content").cast("string").alias("content"))
    five = files.files(spark, [path], max_files=5).select(F.lit("five").alias("asked"), n, F.col("content").cast("string").alias("content"))
    one = files.files(spark, [files.files(spark, [path], max_files=1).first()["path"]]).select(F.lit("one").alias("asked"), n, F.col("content").cast("string").alias("content"))
    return all_.unionByName(five).unionByName(one)


def file_stream(spark, sf_dir):
    """Files ingested as they arrive, then the same files again."""
    path, engine = _written(spark, sf_dir), _new(spark, "stream")
    for n in range(2):
        watch(engine, f"{path}/in", f"{path}/checkpoint{n}", once=True).awaitTermination()
    docs = engine.tables.latest("documents", "title", "state").select("title", "state")
    versions = engine.tables.rows("documents").count()
    return docs.withColumn("rows", F.lit(versions).cast("long"))


def blobs(spark, sf_dir):
    """Contents stored by hash, each once however often it is put."""
    engine = _new(spark, "blobs")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("content"))
    first, second = engine.put_blobs(rows), engine.put_blobs(rows)
    return engine.tables.rows("blobs").select("hash", F.octet_length("content").cast("long").alias("bytes"), F.lit(first).cast("long").alias("first"), F.lit(second).cast("long").alias("second"))


def vector_lines(spark, sf_dir):
    """Vectors read from lines of JSON; malformed lines and other dimensions are left out."""
    rows = table(spark, sf_dir, "embeddings")
    dims = len(rows.first()["embedding"])
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("segment_id"), F.lit("d").alias("doc_id"), F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")).alias("embedding")))
    rows.select(F.when(F.col("vec_id") % 10 == 4, F.substring(line, 1, 20)).when(F.col("vec_id") % 10 == 5, F.lit("no json")).otherwise(line).alias("value")).write.text(path)
    return vectors.read_jsonl(spark, path, dims).select("segment_id", F.size("embedding").cast("long").alias("dims"))


def vector_index(spark, sf_dir):
    """Vectors after upserts and deletes, by segment and by document."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("segment_id"), (F.col("vec_id") % 11).cast("string").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"), "vec_id")
    dims = len(rows.first()["embedding"])
    index = vectors.VectorIndex.empty(spark, dims).upsert(rows.drop("vec_id"))
    index = index.upsert(rows.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)).drop("vec_id"))
    index = index.delete(rows.where("vec_id % 5 = 0").select("segment_id")).delete_by_doc(spark.createDataFrame([("7",)], "doc_id string"))
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    opened = vectors.VectorIndex.open(spark, path, dims, index.flush(path))
    return opened.rows.select("segment_id", "doc_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.lit(opened.count()).cast("long").alias("n"))


# Programs, descriptions, configuration.


def program(spark, sf_dir):
    """A program that lists, reads each document it got, and returns from a branch: its trace."""
    ops = dsl.dispatch(_taxonomy(spark, sf_dir))
    nodes = [
        {"type": "let", "name": "got", "call": {"op": "list", "params": {"limit": 3}}},
        {"type": "for_each", "collection": "$got.documents", "item": "d", "body": [{"type": "call", "op": "read", "params": {"id": "$d.doc_id"}}]},
        {"type": "if", "condition": "$got.truncated", "then": [{"type": "return", "value": {"more": "$got.truncated", "third": "$got.documents.2.state"}}]},
        {"type": "return", "value": None},
    ]
    out = dsl.execute(nodes, ops)
    return _rows(spark, [(t["step"], t["node_type"], t.get("op"), json.dumps(out["value"], sort_keys=True)) for t in out["trace"]], "step long, node string, op string, value string")


def program_errors(spark, sf_dir):
    """Programs that can't run or go beyond a limit, and their codes."""
    ops = {"three": lambda p: [1, 2, 3], "fail": lambda p: (_ for _ in ()).throw(EngineError("E_NOT_FOUND", "gone"))}
    loop = [{"type": "let", "name": "x", "call": {"op": "three"}}, {"type": "for_each", "collection": "$x", "item": "i", "body": [{"type": "call", "op": "three"}]}]
    cases = {
        "steps": (loop, {"max_steps": 3}), "iterations": (loop, {"max_iterations": 2}), "bytes": (loop, {"max_output_bytes": 10}), "sound": (loop, None), "limit": (loop, {"max_things": 1}),
        "node": ([{"type": "while"}], None), "field": ([{"type": "call", "op": "three", "then": []}], None), "operation": ([{"type": "call", "op": "none"}], None), "variable": ([{"type": "return", "value": "$y"}], None),
        "index": ([loop[0], {"type": "return", "value": "$x.7"}], None), "not a list": ({}, None), "failing": ([{"type": "call", "op": "fail"}], None),
    }
    out = []
    for name, (nodes, limits) in cases.items():
        try:
            out.append((name, "none", dsl.execute(nodes, ops, limits)["steps_executed"]))
        except EngineError as e:
            out.append((name, e.code, None))
    return _rows(spark, out, "tried string, code string, steps long")


def replies(spark, sf_dir):
    """The server's replies to requests, one line each."""
    ops = {"three": lambda p: [1, 2, 3]}
    call = lambda i, name, args: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}})
    lines = [
        json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), "", json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/list"}),
        call(3, "search", {"query": "search"}), call(4, "execute", {"program": [{"type": "call", "op": "three"}]}), call(5, "none", {}), call(6, "search", {"more": 1}), json.dumps({"jsonrpc": "2.0", "id": 7, "method": "none"}), "{",
    ]
    out = []
    for r in map(json.loads, serve.serve(lines, ops)):
        result = r.get("result", {})
        kind = "tools" if "tools" in result else "content" if "content" in result else "server" if "serverInfo" in result else "error"
        out.append((r["id"], kind, (r.get("error") or {}).get("code"), len(result.get("tools", [])) or len(result.get("content", []))))
    return _rows(spark, out, "id long, kind string, code long, n long")


def operation_search(spark, sf_dir):
    """Descriptions of operations that a query's words match, best first."""
    rows = [(q, n + 1, x["name"], x["score"]) for q in ("search", "document id", "", "nothing-like-it", "rebuild") for n, x in enumerate(spec.search(q, 3))]
    return _rows(spark, rows, "asked string, place long, name string, score long")


def exit_codes(spark, sf_dir):
    """Error codes with the exit code of a process that ends with them."""
    return _rows(spark, [(code, serve.envelope("x", _raiser(code))[1]) for code in EXIT_CODES], "code string, exit long")


def _raiser(code: str) -> Callable:
    def act():
        raise EngineError(code, "tried")

    return act


def configuration(spark, sf_dir):
    """Configuration after some keys are set: all keys with type and value, and what is refused."""
    config = Config(spark, f"{shared_dir(spark)}/config-{uuid.uuid4().hex}")
    config.set("search.limit", "7")
    config.set("embed.model", 'a "quoted" näme')
    config.set("embed.api_key", "secret")
    out = [(r["key"], r["type"], None if r["value"] is None else str(r["value"])) for r in config.show()]
    for key, value in (("search.limit", "many"), ("search.limit", -1), ("no.key", 1)):
        try:
            config.set(key, value)
            out.append((f"{key}={value}", "none", None))
        except EngineError as e:
            out.append((f"{key}={value}", e.code, None))
    return _rows(spark, out, "key string, kind string, value string")


def latencies(spark, sf_dir):
    """Percentiles of the events' values by type, by nearest rank."""
    return nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95, 0.99))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kb_documents, kb_ingest_report, kb_segments, kb_states, kb_removed, kb_list, kb_blocks, kb_graph, kb_outline, kb_text, kb_enrichments, kb_transitions, kb_search, kb_search_errors, kb_vector_search, kb_hybrid, kb_search_expanded, kb_explain,
        kb_rerank, kb_doctor, kb_snippets, kb_concepts, kb_import_report, kb_closure, kb_cycle, kb_by_concept, kb_by_tag, kb_of_document, markdown_blocks, markdown_documents, structured_blocks, structured_losses, parser_errors,
        pdf_documents, graph_rules, file_walk, file_stream, blobs, vector_lines, vector_index, program, program_errors, replies, operation_search, exit_codes, configuration, latencies,
    )
}


# The same in SQL.

_T = base._trimmed
_SRC = "src AS (SELECT DISTINCT replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL), docs AS (SELECT 'doc_' || sha256(t) AS doc_id, t FROM src)"
_TITLE = "list_filter(list_transform(string_split(t, chr(10)), lambda x: " + _T("x") + "), lambda x: x <> '')[1]"
_SEGS = f"""{_SRC},
    parts AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS part, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS pos FROM docs),
    placed AS (SELECT doc_id, pos, part, coalesce(sum(strlen(part) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM parts),
    spans AS (SELECT doc_id, pos, CAST(begins + strlen(part) - strlen({base._LEAD}) AS BIGINT) AS span_start, {_T("part")} AS body FROM placed),
    segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seg_index, span_start, CAST(span_start + strlen(body) AS BIGINT) AS span_end, body FROM spans WHERE body <> ''),
    named AS (SELECT 'seg_' || sha256(doc_id || ':' || seg_index) AS segment_id, * FROM segs)"""
_WORDS = r"list_transform(list_filter(regexp_split_to_array(body, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40), lambda x: lower(x))"
_INDEX = f"""{_SEGS},
    words AS (SELECT segment_id, {_WORDS} AS w FROM named),
    toks AS (SELECT segment_id, unnest(w) AS term, generate_subscripts(w, 1) AS at FROM words),
    tf AS (SELECT term, segment_id, count(*) AS tf FROM toks GROUP BY ALL),
    lens AS (SELECT segment_id, len(w) AS doc_len FROM words),
    stats AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
    idf AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN stats GROUP BY term),
    one AS (SELECT term, segment_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS s FROM tf JOIN idf USING (term) JOIN lens USING (segment_id) CROSS JOIN stats)"""
_HAS = "(SELECT segment_id FROM tf WHERE term = '{}')".format
_SUM = "SELECT {} AS asked, segment_id, sum(s) AS s FROM one WHERE term IN ({}) {} GROUP BY segment_id".format


def _phrase(n: int, first: str, second: str, near: str) -> str:
    """Segments where the second term stands near the first, scored as one term of their summed rarity."""
    return f"""SELECT {n} AS asked, segment_id, (SELECT sum(idf) FROM idf WHERE term IN ({first}, {second})) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS s
        FROM (SELECT a.segment_id, count(DISTINCT a.at) AS tf FROM toks a JOIN toks b ON a.segment_id = b.segment_id AND {near} WHERE a.term = {first} AND b.term = {second} GROUP BY a.segment_id) JOIN lens USING (segment_id) CROSS JOIN stats"""


_ASKED = " UNION ALL ".join(
    (
        _SUM(0, "'license'", ""), _SUM(1, "'license', 'version'", ""), _SUM(2, "'license', 'version'", f"AND segment_id IN {_HAS('license')} AND segment_id IN {_HAS('version')}"), _SUM(3, "'license'", f"AND segment_id NOT IN {_HAS('version')}"),
        _SUM(4, "'license', 'version'", f"AND segment_id NOT IN {_HAS('that')}"), _phrase(5, "'under'", "'the'", "b.at = a.at + 1"), _phrase(6, "'the'", "'under'", "abs(b.at - a.at - 1) <= 2"),
        "SELECT DISTINCT 7 AS asked, segment_id, 1.0 AS s FROM tf WHERE starts_with(term, 'licen')", "SELECT DISTINCT 8, segment_id, 1.0 FROM tf WHERE term >= 'licence' AND term <= 'license'", "SELECT DISTINCT 9, segment_id, 1.0 FROM tf WHERE term IN ('license', 'version')",
        "SELECT 10, segment_id, sum(CASE term WHEN 'license' THEN 2 * s ELSE s END) FROM one WHERE term IN ('license', 'that') GROUP BY segment_id",
        """SELECT 12, segment_id, (SELECT idf FROM idf WHERE term = 'under') * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))
        FROM (SELECT a.segment_id, count(DISTINCT a.at) AS tf FROM toks a JOIN toks b ON a.segment_id = b.segment_id AND b.at = a.at + 1 WHERE a.term = 'under' AND starts_with(b.term, 'th') GROUP BY a.segment_id) JOIN lens USING (segment_id) CROSS JOIN stats""",
    )
)
_FIRST_DOC = "(SELECT min(doc_id) FROM docs)"
_BEST = f"best AS (SELECT segment_id, row_number() OVER (ORDER BY s DESC, segment_id) AS place FROM ({_SUM(1, chr(39) + 'license' + chr(39) + ', ' + chr(39) + 'version' + chr(39), '')}) QUALIFY place <= 10)"
_FITS = "list_max(list_filter(range(0, 201), lambda i: strlen(substr(body, 1, i)) <= 200))"
_HEAD = f"substr(body, 1, {_FITS})"
_SNIPPET = f"CASE WHEN strlen(body) <= 200 THEN body WHEN contains({_HEAD}, ' ') THEN left({_HEAD}, length({_HEAD}) - strpos(reverse({_HEAD}), ' ')) || '...' ELSE {_HEAD} || '...' END"
_CON = "'con_' || sha256('lands:' || {})".format
_LANDS = "lands AS (SELECT n_name, n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _values(rows: list[tuple], *columns: str) -> str:
    """A table of fixed rows."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({', '.join(columns)})"


_MARKDOWN = """lines AS (SELECT printf('n/%04d.md', n_nationkey::INT) AS source_uri, unnest([
        {k: 'HEADING', x: n_name || ' of region ' || n_regionkey}, {k: 'PARAGRAPH', x: 'Known as N' || n_nationkey || ' and elsewhere too,' || chr(10) || 'over two lines.'}, {k: 'HEADING', x: 'Facts'},
        {k: 'LIST_ITEM', x: 'number ' || n_nationkey}, {k: 'LIST_ITEM', x: 'region ' || n_regionkey}, {k: 'LIST_ITEM', x: 'first'}, {k: 'LIST_ITEM', x: 'second'}, {k: 'CODE', x: 'x = ' || n_nationkey || chr(10) || chr(10) || 'y = 2'},
        {k: 'HEADING', x: 'Underlined'}, {k: 'PARAGRAPH', x: 'quoted words'}, {k: 'PARAGRAPH', x: 'Last *one*.'}]) AS b, unnest(range(11)) AS block_idx FROM nation),
    laid AS (SELECT source_uri, block_idx, b.k AS kind, b.x AS text, CAST(coalesce(sum(strlen(b.x) + 2) OVER (PARTITION BY source_uri ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM lines)"""
_EXPORT = """lands AS (SELECT n_regionkey, count(*) AS n, string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS grid FROM nation GROUP BY ALL),
    found AS (SELECT printf('r/%04d.json', r_regionkey::INT) AS source_uri, CASE WHEN r_regionkey % 2 = 0 THEN 'report ' || r_name ELSE 'Region ' || r_name END AS title, unnest([
        {k: 'HEADING', x: 'Region ' || r_name}, {k: 'PARAGRAPH', x: 'Intro.'}, {k: 'LIST_ITEM', x: n || ' lands'}, {k: 'TABLE_CELL', x: grid}, {k: 'CAPTION', x: 'The lands'}, {k: 'FOOTNOTE', x: 'note'}, {k: 'CODE', x: 'x = 1'}, {k: 'PARAGRAPH', x: 'other'}]) AS b, unnest(range(8)) AS block_idx
        FROM region JOIN lands ON n_regionkey = r_regionkey)"""
_CODES = [(k, v) for k, v in EXIT_CODES.items()]
_STEPS = [("STAGED", "INDEXING"), ("STAGED", "DELETED"), ("INDEXING", "READY"), ("INDEXING", "FAILED"), ("INDEXING", "DELETED"), ("READY", "DELETED"), ("FAILED", "STAGED"), ("FAILED", "DELETED")]
_ALL = ("STAGED", "INDEXING", "READY", "FAILED", "DELETED")

ORACLE_SQL: dict[str, str] = {
    "kb_documents": f"WITH {_SRC} SELECT doc_id, 'READY' AS state, {_TITLE} AS title, 'ver_' || sha256(doc_id || ':1') AS version_id, 'plain' AS parser, sha256(t) AS source_hash, CAST(1 AS BIGINT) AS segmenter_version FROM docs",
    "kb_ingest_report": f"WITH {_SEGS} SELECT (SELECT count(*) FROM docs) AS added, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS ready, CAST(0 AS BIGINT) AS failed, count(DISTINCT doc_id) AS fts_documents, count(*) AS fts_segments, count(DISTINCT doc_id) AS vec_documents, count(*) AS vec_segments FROM named",
    "kb_segments": f"WITH {_SEGS} SELECT segment_id, doc_id, seg_index, span_start, span_end, body FROM named",
    "kb_states": f"WITH {_SRC} SELECT 'READY' AS state, count(*) - 1 AS n FROM docs UNION ALL SELECT 'DELETED', 1",
    "kb_removed": "SELECT CAST(0 AS BIGINT) AS still_found, CAST(1 AS BIGINT) AS added_again, CAST(2 AS BIGINT) AS versions, CAST(1 AS BIGINT) AS generation",
    "kb_list": f"WITH {_SRC} SELECT doc_id, {_TITLE} AS title, 'READY' AS state, (SELECT count(*) > 100 FROM docs) AS truncated FROM docs ORDER BY doc_id LIMIT 100",
    "kb_blocks": f"WITH {_SEGS} SELECT seg_index AS block_idx, 'PARAGRAPH' AS kind, span_start, span_end, body FROM named WHERE doc_id = {_FIRST_DOC}",
    "kb_graph": f"WITH {_SEGS} SELECT doc_id, count(*) AS blocks, count(*) AS places, count(*) - 1 AS edges, CAST(0 AS BIGINT) AS broken FROM named GROUP BY doc_id",
    "kb_outline": f"WITH {_SEGS} SELECT seg_index AS position, '[' || seg_index || '] ' || body AS line FROM named WHERE doc_id = {_FIRST_DOC}",
    "kb_text": f"WITH {_SRC} SELECT t AS text, false AS truncated FROM docs WHERE doc_id = {_FIRST_DOC}",
    "kb_enrichments": f"WITH {_SRC} SELECT doc_id, {_TITLE} AS title, length(substr(t, 1, 500)) AS summary_chars, CAST(0 AS BIGINT) AS n_tags, 'heuristic' AS provider, sha256(t) AS content_hash FROM docs",
    "kb_transitions": _values([(a, b, (a, b) in _STEPS) for a in _ALL for b in _ALL], "before", "after", "allowed"),
    "kb_search": f"WITH {_INDEX}, asked AS ({_ASKED}) SELECT CAST(asked AS BIGINT) AS asked, segment_id, round(CAST(s AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY asked ORDER BY s DESC, segment_id) AS place FROM asked QUALIFY place <= 10",
    "kb_search_errors": _values([(x, "E_SEARCH_FAILED") for x in ("(a", "a)", "a AND", "AND a", 'a "b', "title:x", "a ?", "+")], "asked", "code"),
    "kb_vector_search": f"""WITH {_SEGS}, vecs AS (SELECT segment_id, list_transform(range(32), lambda i: ('0x' || substr(sha256(body), 2 * i + 1, 2))::INT / 127.5::DOUBLE - 1) AS v FROM named),
        q AS (SELECT v AS q FROM vecs JOIN named USING (segment_id) WHERE body = (SELECT min(body) FROM named) LIMIT 1),
        near AS (SELECT segment_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) AS s FROM vecs CROSS JOIN q)
        SELECT row_number() OVER (ORDER BY round(s, 7) DESC, segment_id) AS place, round(s, 6) AS score, segment_id FROM near QUALIFY place <= 5""",
    "kb_hybrid": _values([(True, True, "PARAGRAPH", 8, 1, 8, True)], "adds_up", "own_block", "block_kind", "n", "first", "last", "best_by_both"),
    "kb_search_expanded": f"""WITH {_INDEX}, {_BEST}, h AS (SELECT segment_id, doc_id, seg_index AS at, body AS own FROM best JOIN named USING (segment_id)),
        a AS (SELECT h.segment_id, h.at AS block_idx, n.seg_index AS position, n.seg_index = h.at AS is_hit, strlen(n.body) AS size, own AS body, CASE WHEN n.seg_index < h.at THEN 2 * (h.at - n.seg_index) - 1 ELSE 2 * (n.seg_index - h.at) END AS visit FROM h JOIN named n USING (doc_id)),
        v AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS total FROM a WINDOW w AS (PARTITION BY segment_id ORDER BY visit)),
        f AS (SELECT *, min(CASE WHEN n > 1 AND (total > 400 OR n > 3 OR total - size >= 400) THEN n END) OVER (PARTITION BY segment_id) AS stop FROM v)
        SELECT segment_id, block_idx, position, is_hit, {_SNIPPET} AS snippet FROM f WHERE stop IS NULL OR n < stop""",
    "kb_explain": f"WITH {_INDEX}, {_BEST} SELECT 'res_' || substr(sha256('license version:' || segment_id), 1, 16) AS result_id, doc_id, segment_id, place, round(1.0::DOUBLE / (60 + place), 9) AS contribution, true AS no_vector, place AS fused_rank, CAST(1 AS BIGINT) AS fts_gen FROM best JOIN named USING (segment_id)",
    "kb_rerank": f"WITH {_INDEX}, {_BEST} SELECT count(*) AS n, true AS in_order, true AS falling, true AS reranked FROM best",
    "kb_doctor": _values([(x, "ok", True) for x in ("home_directory", "store", "schema_version", "document_states", "processing_fingerprints", "fts_index", "fts_consistency", "vector_index")], "name", "status", "healthy"),
    "kb_snippets": f"WITH {_SEGS} SELECT segment_id, {_SNIPPET} AS snippet FROM named",
    "kb_concepts": f"WITH {_LANDS} SELECT {_CON('n_name')} AS concept_id, 'lands' AS scheme_uri, n_name AS pref_label, lower(n_name) AS alt_labels, NULL::VARCHAR AS definition FROM lands UNION ALL SELECT DISTINCT {_CON('r_name')}, 'lands', r_name, '', NULL FROM lands UNION ALL SELECT {_CON(chr(39) + 'World' + chr(39))}, 'lands', 'World', '', 'all'",
    "kb_import_report": f"WITH {_LANDS} SELECT count(*) + count(DISTINCT r_name) + 1 AS created, CAST(0 AS BIGINT) AS skipped, count(*) + count(DISTINCT r_name) AS relations, least(5, count(*)) AS listed FROM lands",
    "kb_closure": f"WITH {_LANDS}, w AS (SELECT {_CON(chr(39) + 'World' + chr(39))} AS world) SELECT {_CON('r_name')} AS ancestor, {_CON('n_name')} AS descendant, CAST(1 AS BIGINT) AS depth FROM lands UNION ALL SELECT world, {_CON('n_name')}, 2 FROM lands, w UNION ALL SELECT DISTINCT world, {_CON('r_name')}, 1 FROM lands, w",
    "kb_cycle": _values([("cycle", "E_TAXONOMY_CYCLE"), ("unknown", "E_NOT_FOUND")], "tried", "code"),
    "kb_by_concept": f"WITH {_LANDS} SELECT r_name AS concept, '# Land ' || n_name AS title FROM lands UNION ALL SELECT 'World', '# Land ' || n_name FROM lands",
    "kb_by_tag": "SELECT '# Land ' || n_name AS title, true AS found FROM nation WHERE n_regionkey = 1",
    "kb_of_document": _values([(0, "PARAGRAPH"), (1, "PARAGRAPH"), (2, "PARAGRAPH")], "block_idx", "block_kind"),
    "markdown_blocks": f"WITH {_MARKDOWN} SELECT source_uri, block_idx, kind, span_start, CAST(span_start + strlen(text) AS BIGINT) AS span_end, text FROM laid",
    "markdown_documents": "SELECT printf('n/%04d.md', n_nationkey::INT) AS source_uri, n_name || ' of region ' || n_regionkey AS title, 'markdown' AS parser, true AS spans_hold, CAST(11 AS BIGINT) AS n_blocks, NULL::VARCHAR AS error_code FROM nation",
    "structured_blocks": f"WITH {_EXPORT} SELECT source_uri, title, block_idx, b.k AS kind, b.x AS text FROM found",
    "structured_losses": "SELECT printf('r/%04d.json', r_regionkey::INT) AS source_uri, loss_idx, kind, true AS no_span FROM region CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'IMAGE'), (1, 'TABLE')) v(loss_idx, kind)",
    "parser_errors": _values([("a.txt", "plain", "E_PARSE_MD", None), ("b.md", "markdown", "E_PARSE_MD", None), ("c.json", "docling", "E_PARSE_EXTERNAL", None), ("d.json", "docling", "E_PARSE_EXTERNAL", None), ("e.pdf", "pdf", "E_PARSE_PDF", None), ("f.txt", "plain", "none", "fine"), ("g.unknown", "plain", "none", "fine"), ("h.MD", "markdown", "none", "fine")], "source_uri", "parser", "code", "title"),
    "pdf_documents": f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'page ' || doc_id ELSE replace(text, '%', '') END AS t FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, {_TITLE} AS title FROM p)
        SELECT printf('p/%012d.pdf', doc_id) AS source_uri, CAST(strlen(substr(title, 1, list_max(list_filter(range(0, 201), lambda i: strlen(substr(title, 1, i)) <= 200)))) AS BIGINT) AS title_bytes, CAST(CASE WHEN {_T("t")} = '' THEN 0 ELSE 1 END AS BIGINT) AS n_blocks, CASE WHEN doc_id % 3 = 0 THEN 'IMAGE' ELSE '' END AS losses FROM f""",
    "graph_rules": """WITH c AS (SELECT conv_id AS doc_id, count(*) AS n, min(turn) AS lo FROM conversations GROUP BY conv_id)
        SELECT doc_id, 'SPAN_OUT_OF_BOUNDS' AS problem FROM c WHERE doc_id % 7 = 1 UNION ALL SELECT doc_id, unnest(['ORDER_OUT_OF_BOUNDS', 'ORDER_INCOMPLETE']) FROM c WHERE doc_id % 7 = 2 AND lo = 0
        UNION ALL SELECT doc_id, 'ORDER_DUPLICATE' FROM c WHERE doc_id % 7 = 3 AND lo = 0 UNION ALL SELECT doc_id, 'ORDER_INCOMPLETE' FROM c WHERE doc_id % 7 = 4
        UNION ALL SELECT doc_id, 'EDGE_OUT_OF_BOUNDS' FROM c WHERE doc_id % 7 = 5 AND n > 1 AND lo = 0 UNION ALL SELECT doc_id, 'READING_CYCLE' FROM c WHERE doc_id % 7 IN (3, 6) AND n > 1 AND lo = 0""",
    "file_walk": """WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS n, 'land ' || n_name || chr(10) AS content, row_number() OVER (ORDER BY 'n=' || n_nationkey || '/') AS k FROM nation)
        SELECT 'all' AS asked, n, content FROM f UNION ALL SELECT 'five', n, content FROM f WHERE k <= 5 UNION ALL SELECT 'one', n, content FROM f WHERE k = 1""",
    "file_stream": "SELECT 'land ' || n_name AS title, 'READY' AS state, (SELECT count(*) FROM nation) AS rows FROM nation",
    "blobs": "WITH b AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) SELECT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, (SELECT count(*) FROM b) AS first, CAST(0 AS BIGINT) AS second FROM b",
    "vector_lines": "SELECT 's' || vec_id AS segment_id, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings WHERE vec_id % 10 NOT IN (3, 4, 5)",
    "vector_index": "WITH i AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 11 <> 7) SELECT CAST(vec_id AS VARCHAR) AS segment_id, CAST(vec_id % 11 AS VARCHAR) AS doc_id, round(CAST(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS first, (SELECT count(*) FROM i) AS n FROM i",
    "program": _values([(0, "call", "list"), (1, "for_each", None), (2, "call", "read"), (3, "call", "read"), (4, "call", "read"), (5, "if", None), (6, "return", None)], "step", "node", "op").replace("SELECT *", """SELECT *, '{"more": true, "third": "READY"}' AS value"""),
    "program_errors": _values([("steps", "E_EXECUTION_LIMIT", None), ("iterations", "E_EXECUTION_LIMIT", None), ("bytes", "E_EXECUTION_LIMIT", None), ("sound", "none", 5), ("limit", "E_INVALID_INPUT", None), ("node", "E_INVALID_INPUT", None), ("field", "E_INVALID_INPUT", None), ("operation", "E_INVALID_INPUT", None), ("variable", "E_DSL_ERROR", None), ("index", "E_DSL_ERROR", None), ("not a list", "E_INVALID_INPUT", None), ("failing", "E_NOT_FOUND", None)], "tried", "code", "steps"),
    "replies": _values([(1, "server", None, 0), (2, "tools", None, 2), (3, "content", None, 1), (4, "content", None, 1), (5, "error", -32602, 0), (6, "error", -32602, 0), (7, "error", -32601, 0), (None, "error", -32700, 0)], "id", "kind", "code", "n"),
    "operation_search": _values([("search", 1, "search", 110), ("search", 2, "explain", 10), ("document id", 1, "enrich", 45), ("document id", 2, "read", 45), ("document id", 3, "remove", 45), ("", 1, "add", 1), ("", 2, "doctor", 1), ("", 3, "enrich", 1), ("rebuild", 1, "reindex", 10)], "asked", "place", "name", "score"),
    "exit_codes": _values(_CODES, "code", "exit"),
    "configuration": _values([("embed.api_key", "str", "set"), ("embed.base_url", "str", None), ("embed.cache_dir", "str", None), ("embed.dimensions", "int", None), ("embed.model", "str", 'a "quoted" näme'), ("embed.provider", "str", None), ("rerank.model", "str", None), ("rerank.provider", "str", None), ("rerank.top_k", "int", None), ("search.limit", "int", "7"), ("search.limit=many", "E_CONFIG", None), ("search.limit=-1", "E_CONFIG", None), ("no.key=1", "E_CONFIG", None)], "key", "kind", "value"),
    "latencies": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, n, max(CASE WHEN k = floor(0.5 * (n - 1) + 0.5) THEN value END) AS p50, max(CASE WHEN k = floor(0.95 * (n - 1) + 0.5) THEN value END) AS p95, max(CASE WHEN k = floor(0.99 * (n - 1) + 0.5) THEN value END) AS p99 FROM r GROUP BY ALL""",
}
