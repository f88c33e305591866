"""The engine end to end: init, ingest, search, explain, read, enrich, remove, reindex, doctor, taxonomy."""

import json

import pytest

from pagewright.errors import EngineError
from pagewright.plans import dsl, ports, serve, spec
from pagewright.plans.config import Config
from pagewright.plans.engine import Engine, snippet

FOX = "The quick brown fox.\n\nJumps over the lazy dog.\n\nSecond thoughts about foxes and dogs."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    docs = tmp_path_factory.mktemp("docs")
    (docs / "fox.txt").write_text(FOX)
    (docs / "sub").mkdir()
    (docs / "sub" / "rust.md").write_text("---\nk: v\n---\n# Rust **errors** in depth\n\nResult types.\n\n- first item about handling\n- second\n\n```\ncode here\n```\n")
    (docs / "copy.txt").write_text(FOX)
    (docs / "empty.txt").write_text("")
    (docs / "bad.md").write_bytes(b"\xff\xfe\x00")
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('home')}/kb", embedder=ports.hashed(16), reranker=ports.lexical)
    assert e.init()["created"] and not e.init()["created"]
    e.report = e.ingest([f"file://{docs}"])
    e.docs = docs
    return e


def test_ingest_counts_duplicates_as_ready_and_reports_failures(engine):
    r = engine.report
    assert (r["added"], r["ready"], r["failed"]) == (2, 3, 1)
    assert r["failures"][0]["code"] == "E_PARSE_MD"
    empty = engine.add(f"file://{engine.docs}/empty.txt")
    assert empty["changed"] and empty["status"] == "READY" and empty["segments"] == 0
    again = engine.add(f"file://{engine.docs}/fox.txt")
    assert not again["changed"] and again["status"] == "READY" and again["segments"] == 3


def test_search_explain_and_repeat(engine):
    found = engine.search("fox", "bm25", expand=True)
    hit = found["hits"][0]
    assert hit["snippet"] == "The quick brown fox." and hit["block_kind"] == "PARAGRAPH"
    assert [b["position"] for b in hit["context_window"]] == [0, 1, 2]
    assert engine.search("fox", "bm25")["hits"][0]["result_id"] == hit["result_id"]
    trace = engine.explain(hit["result_id"])["retrieval_trace"]
    assert trace["bm25"]["rank"] == 1 and trace["vector"] is None
    assert abs(trace["fused"]["score"] - 1 / 61) < 1e-12


def test_query_language(engine):
    ids = lambda q: {h["snippet"][:9] for h in engine.search(q, "bm25", 20)["hits"]}
    assert ids('"lazy dog"') == {"Jumps ove"}
    assert ids('"dog lazy"') == set()
    assert ids("fox OR dog") == {"The quick", "Jumps ove"}
    assert ids("+foxes -lazy") == {"Second th"}
    assert ids("(fox OR foxes) AND dogs") == {"Second th"}
    assert ids("  ") == set() and engine.search("fox", "bm25", 0)["hits"] == []
    with pytest.raises(EngineError, match="field"):
        engine.search("title:x", "bm25")


def test_markdown_blocks_and_list_items(engine):
    found = engine.search("handling", "bm25")["hits"][0]
    assert found["block_kind"] == "LIST_ITEM"
    doc = engine.read(found["doc_id"], "blocks")
    assert doc["title"] == "Rust errors in depth"
    assert [b["kind"] for b in doc["content"]["blocks"]] == ["HEADING", "PARAGRAPH", "LIST_ITEM", "LIST_ITEM", "CODE"]
    text = engine.read("Rust errors in depth")["content"]["text"].encode()
    assert all(text[b["span_start"] : b["span_end"]].decode() == b["body"] for b in doc["content"]["blocks"])
    assert engine.read(found["doc_id"], "outline")["content"]["lines"][0] == "[0] Rust errors in depth"


def test_vectors_hybrid_rerank_and_fingerprint(engine):
    with pytest.raises(EngineError, match="vector"):
        engine.search("fox", "vector")
    assert engine.reindex_vector()["segments"] == 8
    best = engine.search("Jumps over the lazy dog.", "vector")["hits"][0]
    assert best["snippet"] == "Jumps over the lazy dog." and abs(best["scores"]["vector_score"] - 1) < 1e-6
    both = engine.search("lazy dog", "hybrid", rerank=True)
    assert both["retrieval_info"]["vector"] and both["hits"][0]["scores"]["reranker_rank"] == 1
    other = Engine(engine.spark, engine.home, embedder=ports.zeros(16))
    with pytest.raises(EngineError) as e:
        other.search("fox", "vector")
    assert e.value.code == "E_FINGERPRINT_MISMATCH"


def test_enrich_filters_and_taxonomy(engine, tmp_path):
    doc = engine.search("Result", "bm25")["hits"][0]["doc_id"]
    made = engine.enrich(doc)
    assert made["title"] == "Rust errors in depth"
    data = [{"scheme_uri": "s", "pref_label": "Errors", "broader": ["Language"]}, {"scheme_uri": "s", "pref_label": "Language", "narrower": ["Types"], "broader": ["Computing"]}, {"scheme_uri": "s", "pref_label": "Types"}, {"scheme_uri": "s", "pref_label": "Computing"}]
    (tmp_path / "c.json").write_text(json.dumps(data))
    assert engine.import_concepts(f"file://{tmp_path}/c.json") == {"created": 4, "skipped": 0, "relations": 3}
    ids = {c["pref_label"]: c["concept_id"] for c in engine.concepts()}
    rows = {(r["ancestor"], r["descendant"]): r["depth"] for r in engine.tables.rows("concept_closure").collect()}
    assert rows[ids["Computing"], ids["Types"]] == 2 and len(rows) == 5
    engine.assign(doc, ids["Errors"])
    assert [h["doc_id"] for h in engine.search("Result OR fox", "bm25", concept=ids["Computing"])["hits"]] == [doc]
    with pytest.raises(EngineError) as e:
        engine.relate(ids["Computing"], ids["Errors"])
    assert e.value.code == "E_TAXONOMY_CYCLE"


def test_remove_hides_and_add_again_makes_a_version(engine):
    doc = engine.search("lazy", "bm25")["hits"][0]["doc_id"]
    assert engine.remove(doc)["previous_state"] == "READY"
    assert engine.search("lazy", "bm25")["hits"] == []
    with pytest.raises(EngineError):
        engine.remove(doc)
    assert engine.add(f"file://{engine.docs}/fox.txt")["changed"]
    assert engine.search("lazy", "bm25")["hits"]
    r = engine.reindex()
    assert r["generation"] == 1 and r["segments"] == 8
    assert engine.search("lazy", "bm25")["fts_generation"] == 1
    assert engine.doctor()["healthy"]
    assert engine.list(1)["truncated"]


def test_programs(engine):
    ops = dsl.dispatch(engine)
    program = [
        {"type": "let", "name": "r", "call": {"op": "search", "params": {"query": "dog"}}},
        {"type": "if", "condition": "$r.hits", "then": [{"type": "return", "value": {"first": "$r.hits.0.doc_id"}}]},
        {"type": "return", "value": None},
    ]
    out = dsl.execute(program, ops)
    assert out["value"]["first"].startswith("doc_") and out["steps_executed"] == 3
    reply = json.loads(next(serve.serve([json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "execute", "arguments": {"program": program}}})], ops)))
    assert "doc_" in reply["result"]["content"][0]["text"]


def test_program_limits():
    ops = {"list": lambda p: [1, 2, 3]}
    loop = [{"type": "let", "name": "x", "call": {"op": "list"}}, {"type": "for_each", "collection": "$x", "item": "i", "body": [{"type": "call", "op": "list"}]}]
    assert dsl.execute(loop, ops)["steps_executed"] == 5
    for limits in ({"max_steps": 4}, {"max_iterations": 2}, {"max_output_bytes": 20}):
        with pytest.raises(EngineError) as e:
            dsl.execute(loop, ops, limits)
        assert e.value.code == "E_EXECUTION_LIMIT"
    with pytest.raises(EngineError):
        dsl.execute([{"type": "call", "op": "list", "more": 1}], ops)
    with pytest.raises(EngineError) as e:
        dsl.execute([{"type": "return", "value": "$nothing"}], ops)
    assert e.value.code == "E_DSL_ERROR"
    assert dsl.Limits.of({"max_steps": 10_000}).max_steps == 200


def test_spec_and_config(spark, tmp_path):
    assert [o["name"] for o in spec.search("search")][0] == "search"
    assert spec.search("nothing-like-it") == [] and len(spec.search("", 100)) == len(spec.OPERATIONS)
    c = Config(spark, f"file://{tmp_path}")
    assert c.load() == {} and c.set("search.limit", "7") == 7 and c.get("search.limit") == 7
    with pytest.raises(EngineError):
        c.set("search.nothing", 1)


def test_snippets():
    assert snippet("short") == "short"
    cut = snippet("wörter " * 60)
    assert cut.endswith("wörter...") and len(cut.encode()) <= 203


def test_stream(engine, spark, tmp_path):
    from pagewright.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("streamed words here")
    watch(engine, f"file://{tmp_path}/in", f"file://{tmp_path}/ck", once=True).awaitTermination()
    assert engine.search("streamed", "bm25")["hits"]
