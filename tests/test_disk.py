"""What a knowledge base takes of the disk, and that nothing is lost by it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright import engine_queries
from pagewright.functions import text as tx
from pagewright.lineage import shared_dir
from pagewright.operators import fulltext, graph, parse, query
from pagewright.plans import engine as plans
from pagewright.plans import store
from pagewright.sources import files


def bytes_in(path):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path.removeprefix("file://")) for x in names)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of documents of many lines, with its knowledge base, and the bytes of its input and of what building the base left on disk."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3_000)]
    line = lambda: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(50))
    rows = [(i, "\n".join(line() for _ in range(10))) for i in range(1_000)]
    folder = f"file://{tmp_path_factory.mktemp('in')}"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(1).write.option("compression", "snappy").parquet(f"{folder}/documents.parquet")
    before = bytes_in(shared_dir(spark))
    engine = engine_queries._engine(spark, folder, "enrichments", "words", "vectors")
    return folder, engine, bytes_in(f"{folder}/documents.parquet"), bytes_in(shared_dir(spark)) - before


def test_a_knowledge_base_takes_less_than_four_times_its_input(made):
    _, _, size, taken = made
    assert taken < 4 * size


def test_a_query_makes_only_what_it_reads(spark, made):
    folder = made[0].replace("file://", "file:///.", 1)
    assert engine_queries.kb_documents(spark, folder).count() == 1_000
    engine = engine_queries._engine(spark, folder)
    assert engine.tables.active("fts") == engine.tables.active("vectors") == 0 and engine.tables.latest("enrichments").count() == 0
    assert engine_queries.kb_enrichments(spark, folder).count() == 1_000 and engine.tables.active("fts") == 0


def test_stored_postings_are_those_of_the_segments(made):
    engine = made[1]
    segments = engine.frame_segments()
    hits = engine.tables.rows("postings").select("term", "batch", F.inline("hits"))
    got = hits.join(engine.tables.rows("lengths"), ["batch", "no", "seg_index"]).select("term", "segment_id", "positions")
    want = fulltext.postings(segments).select("term", "segment_id", "positions")
    assert want.count() == got.count() > 100_000 and want.exceptAll(got).isEmpty()


def test_packing_in_small_blocks_of_several_batches(spark):
    bodies = ["b a b", "", "a", "c " * 300 + "a", "ä 1", None]
    rows = [(b, n * (1 << 33) + 5, k, x) for b in (7, 1 << 62) for n in (3, 0, 2) for k, x in enumerate(bodies)]
    segments = spark.createDataFrame(rows, "batch long, no long, seg_index long, body string").repartition(3)
    for whole in (False, True):
        packed = fulltext.packed(segments)
        found = fulltext.unpacked(fulltext.dealt(packed) if whole else packed).select("term", "batch", F.inline("hits")).collect()
        got = sorted((r["term"], r["batch"], r["no"], r["seg_index"], tuple(r["positions"])) for r in found)
        want = sorted((t, b, n, k, tuple(i for i, w in enumerate(x.split()) if w == t)) for b, n, k, x in rows for t in set((x or "").split()))
        assert got == want


def test_texts_of_blocks_come_back(spark):
    block = "struct<kind:string,span_start:bigint,span_end:bigint,text:string>"
    rows = [
        ("a", "ä bc\n\nd", [("P", 0, 5, "ä bc"), ("P", 7, 8, "d")]), ("b", "xyz", [("P", 0, 1, "x"), ("P", 0, 3, "other")]), ("c", "x", [("P", 0, 1, None)]),
        ("d", None, [("P", 0, 0, "")]), ("e", "x", None), ("f", "x", []),
    ]
    docs = spark.createDataFrame(rows, f"doc_id string, canonical_text string, blocks array<{block}>")
    held = store.stripped(docs)
    assert {r["doc_id"] for r in held.where("sliced").collect()} == {"a", "f"}
    assert held.where("doc_id = 'a' AND exists(blocks, b -> b.text IS NOT NULL)").isEmpty()
    assert sorted(map(tuple, store.restored(held).collect())) == sorted(map(tuple, docs.collect()))
    assert graph.segments_of(store.restored(held)).count() == graph.segments_of(docs).count() == 4


def test_an_ingestion_parses_each_file_once(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def counted(data):
        with seen.open("ab") as f:
            f.write(data + b"\n")
        return plain(data)

    version, plain, code = parse.PARSERS["plain"]
    monkeypatch.setitem(parse.PARSERS, "plain", (version, counted, code))
    rows = [("b.txt", b"one\n\ntwo"), ("a.txt", b"one\n\ntwo"), ("c.txt", b"three"), ("d.txt", b"\xff")]
    engine = engine_queries._new(spark, "once")
    got = engine.take(files.documents(spark.createDataFrame(rows, "path string, content binary").repartition(2)))
    assert (got["added"], got["ready"], got["failed"]) == (2, 3, 1)
    assert sum(len(data) + 1 for _, data in rows) == seen.stat().st_size
    docs = {r["source_uri"]: r for r in engine.tables.latest("documents").collect()}
    assert set(docs) == {"a.txt", "c.txt"} and [b["text"] for b in docs["a.txt"]["blocks"]] == ["one", "two"]
    engine.remove(docs["c.txt"]["doc_id"])
    again = engine.take(files.documents(spark.createDataFrame(rows, "path string, content binary")))
    assert (again["added"], again["ready"]) == (1, 3)
    versions = {(r["doc_id"], r["version_id"]) for r in engine.tables.rows("documents").select("doc_id", "version_id").collect()}
    assert sorted(sum(d == x["doc_id"] for d, _ in versions) for x in docs.values()) == [1, 2]


def test_an_index_made_in_several_passes_is_whole(spark, monkeypatch):
    monkeypatch.setattr(plans, "PASS", 1)
    rows = [(f"{i}.txt", f"common word{i}\n\ncommon again common".encode()) for i in range(30)]
    engine = engine_queries._new(spark, "passes")
    engine.take(files.documents(spark.createDataFrame(rows, "path string, content binary")), index=False)
    written, write = [], engine.tables._write
    monkeypatch.setattr(engine.tables, "_write", lambda name, *rest: written.append(name) or write(name, *rest))
    got = engine.reindex()
    assert written.count("postings") == plans.PASSES > 1
    assert (got["documents"], got["segments"]) == (30, 60) and engine.tables.about("fts")["segments"] == 60
    hits = engine.tables.rows("postings").select("term", "batch", F.inline("hits")).join(engine.tables.rows("lengths"), ["batch", "no", "seg_index"])
    want = fulltext.postings(engine.frame_segments()).select("term", "segment_id", "positions")
    assert sorted(map(tuple, hits.select("term", "segment_id", "positions").collect())) == sorted(map(tuple, want.collect()))


def test_trimming(spark):
    spaces = "\t\n\x0b\f\r \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    texts = ["", " ", spaces, "a", "a b", "\u200bä\u200b", None, *(f"{x}a{x}b" for x in spaces), *(f"a{x}b{x}{x}" for x in spaces), *(f"{x}\U0001f600{x}" for x in spaces)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.trim(F.col("t")).alias("u")).collect()
    assert all(r["u"] == (None if r["t"] is None else r["t"].strip(spaces)) for r in got)


def test_a_search_leaves_no_shuffle_files(spark):
    engine = engine_queries._new(spark, "few")
    files_now = lambda: {f.getName() for f in (lambda x: [x.apply(i) for i in range(x.size())])(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    rows = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = files_now()
    assert len(engine._few(rows, 10).found) == 7 and not files_now() - before


def test_texts_of_an_ingestion_do_not_stand_on_the_disk_twice(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"{i}.txt", "".join(rng.choice("abcdefghijklmnop \n") for _ in range(20_000)).encode()) for i in range(64)]
    rows += [("bad.txt", b"\xff"), ("copy.txt", rows[0][1])]
    engine, peak, before = engine_queries._new(spark, "moved"), [], bytes_in(shared_dir(spark))
    write = engine.tables._write
    monkeypatch.setattr(engine.tables, "_write", lambda *x: (write(*x), peak.append(bytes_in(shared_dir(spark)) - before)))
    for added in (64, 1):
        got = engine.take(files.documents(spark.createDataFrame(rows, "path string, content binary").repartition(8)), index=False)
        assert (got["added"], got["ready"], got["failed"]) == (added, 65, 1)
        if added == 64:
            assert max(peak) < 1.5 * bytes_in(f"{engine.home}/tables/documents")
            engine.remove(engine.tables.latest("documents").where("source_uri = '7.txt'").first()["doc_id"])
    docs = engine.tables.latest("documents").select("canonical_text", "state").collect()
    assert {r["canonical_text"].encode() for r in docs} == {data for _, data in rows[:64]} and {r["state"] for r in docs} == {"READY"}
    n = engine.tables.rows("documents").groupBy("doc_id").agg(F.countDistinct("version_id").alias("n")).groupBy("n").count().collect()
    assert sorted(map(tuple, n)) == [(1, 63), (2, 1)]


def test_a_query_unpacks_the_postings_it_reads_and_no_others(spark):
    rows = [(f"{i}.txt", f"common word{i} other{i % 3}".encode()) for i in range(30)]
    engine = engine_queries._new(spark, "reads")
    engine.take(files.documents(spark.createDataFrame(rows, "path string, content binary")))
    terms = lambda text: {r["term"] for r in engine.tables.rows("postings", query.reads(text)).select("term").collect()}
    assert terms("word1 -other2") == {"word1", "other2"} and terms('"common word2"*') == {"common", *(f"word{i}" for i in (2, *range(20, 30)))}
    assert terms("[other1 TO *] OR IN [common]") == {"common", "other1", "other2", *(f"word{i}" for i in range(30))} and terms("{other1 TO other2}") == terms("doc_id:x *") == terms(" ") == set()
    assert len(engine.search("+common other1^2", "bm25", 50)["hits"]) == 30 and len(engine.search("[word0 TO word9]", "bm25", 50)["hits"]) == 30


def test_vectors_are_stored_without_ids_that_follow_from_others(made):
    engine = made[1]
    rows = engine.tables.rows("vectors")
    assert bytes_in(f"{engine.home}/tables/vectors") < 125 * rows.count() == 1_250_000
    segments = engine.frame_segments().select("segment_id", "doc_id")
    assert segments.exceptAll(rows.select("segment_id", "doc_id")).isEmpty() and len(rows.first()["embedding"]) == 32


def test_postings_are_shuffled_in_blocks(spark):
    rows = [(1, n, 0, f"common word{n} word{n % 97} {'often ' * 3}") for n in range(5_000)]
    packed = fulltext.packed(spark.createDataFrame(rows, "batch long, no long, seg_index long, body string").repartition(3)).localCheckpoint()
    dealt = fulltext.dealt(packed)
    assert dealt.columns == packed.columns and dealt.exceptAll(packed).isEmpty() and dealt.count() == packed.count() > 5_000
    with_ids = dealt.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()).select("p", "term").orderBy("i").collect()
    assert all(a["term"] <= b["term"] for a, b in zip(with_ids, with_ids[1:]) if a["p"] == b["p"])
    sent = [x for x in dealt._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1].splitlines() if "MapInArrow" in x]
    assert len(sent) == 1 and "block" in sent[0]


def test_tables_of_a_search_go_when_something_is_published(spark):
    engine = engine_queries._new(spark, "gone")
    engine.take(files.documents(spark.createDataFrame([(f"{i}.txt", f"common word{i}".encode()) for i in range(30)], "path string, content binary")))
    cuts = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("cut-")}
    before = cuts()
    first = engine.search("common", "bm25", 3)["hits"][0]["doc_id"]
    own = cuts() - before
    assert len(own) == 2
    engine.remove(first)
    engine.reindex()
    assert not own & cuts()
    frame = engine.frame_search("common", "bm25", 50)
    engine.remove(frame.first()["doc_id"])
    hits = engine.search("common", "bm25", 50)["hits"]
    assert first not in {h["doc_id"] for h in hits} and len(hits) == 28 and frame.count() > 0
