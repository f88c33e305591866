"""Parsers, graphs and scoring on small inputs."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.errors import EngineError
from pagewright.functions import text as tx
from pagewright.operators import context, fusion, graph, parse, query, taxonomy, vectors


def kinds(text):
    return [k for k, _ in parse.scan_markdown(text)]


def test_markdown():
    assert kinds("Harbour\n=======\nBoats come in.\n\n### Tides ###\n* high\n* low\n") == ["HEADING", "PARAGRAPH", "HEADING", "LIST_ITEM", "LIST_ITEM"]
    assert kinds("~~~\n# no heading\n~~~\n") == ["CODE"] and kinds("\n \n") == []
    assert parse.scan_markdown("# a *b* c [d](e) `f*g`") == [("HEADING", "a b c d f*g")]
    assert parse.without_front_matter("---\ntide: low\n---\nBoats") == "Boats"
    assert parse.without_front_matter("---\nnever closed") == "---\nnever closed"
    assert parse.markdown_blocks(b"## Tides\n\n# Harbour *wall*\n")["title"] == "Harbour wall"
    assert parse.markdown_blocks(b"\n  Boats come in.\nAnd go.")["title"] == "Boats come in."


def test_markdown_lists_and_references():
    blocks = parse.scan_markdown("- bread\n  - rye\n    and more\n  - oat\n\n    baked twice\n- tea\nwith milk\n\n1. boil\n   ```\n   water\n     salt\n   ```\n2. - pour\n\nDone.\n")
    assert blocks == [
        ("LIST_ITEM", "bread"), ("LIST_ITEM", "rye\nand more"), ("LIST_ITEM", "oat"), ("PARAGRAPH", "baked twice"), ("LIST_ITEM", "tea\nwith milk"),
        ("LIST_ITEM", "boil"), ("CODE", "water\n  salt"), ("LIST_ITEM", "pour"), ("PARAGRAPH", "Done."),
    ]
    assert parse.scan_markdown("See [the Mill] and [oven][], not [salt].\n\n[the  mill]: http://m 'Mill'\n[oven]: <o>\n") == [("PARAGRAPH", "See the Mill and oven, not [salt].")]
    assert parse.scan_markdown("- # Crust\n- [x]: y\n") == [("HEADING", "Crust"), ("LIST_ITEM", "[x]: y")]


def test_structured_export():
    doc = {
        "schema_name": "DoclingDocument", "name": "report",
        "texts": [{"label": "section_header", "text": " Head "}, {"label": "text", "text": "Body"}, {"label": "odd", "text": "Other"}, {"label": "text", "text": "  "}],
        "tables": [{"data": {"num_rows": 2, "num_cols": 2, "table_cells": [{"text": "a", "row_index": 0, "col_index": 0}, {"text": "d", "row_index": 1, "col_index": 1}, {"text": "x", "row_index": 9, "col_index": 9}]}}, {"data": None}],
        "pictures": [{}],
        "body": {"children": [{"$ref": "#/texts/0"}, {"children": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/99"}]}, {"$ref": "#/tables/0"}, {"$ref": "#/tables/1"}, {"$ref": "#/pictures/0"}, {"$ref": "#/texts/2"}, {"$ref": "#/texts/3"}]},
    }
    out = parse.structured_blocks(json.dumps(doc).encode())
    assert [b[0] for b in out["blocks"]] == ["HEADING", "PARAGRAPH", "TABLE_CELL", "PARAGRAPH"]
    assert out["blocks"][2][3] == "a | \n | d" and out["title"] == "report"
    assert [x[0] for x in out["losses"]] == ["TABLE", "IMAGE"]
    text = out["canonical_text"].encode()
    assert all(text[a:z].decode() == t for _, a, z, t in out["blocks"])


@given(st.text(alphabet="aé \n#*-`>", max_size=60))
def test_any_markdown_gives_a_valid_graph(text):
    out = parse.markdown_blocks(text.encode())
    size = len(out["canonical_text"].encode())
    assert graph.problem_of(size, [(a, z) for _, a, z, _ in out["blocks"]]) is None


def test_graph_problems():
    ok = [(0, 1), (1, 2)]
    assert graph.problem_of(2, ok, [0, 1], [(0, 1, graph.READS_BEFORE)]) is None
    assert "outside" in graph.problem_of(1, ok)
    assert "twice" in graph.problem_of(2, ok, [0, 0])
    assert "leaves" in graph.problem_of(2, ok, [0])
    assert "cycle" in graph.problem_of(2, ok, [0, 1], [(0, 1, graph.READS_BEFORE), (1, 0, graph.READS_BEFORE)])
    assert graph.problem_of(2, ok, [0, 1], [(0, 1, graph.REFERS_TO), (1, 0, graph.REFERS_TO)]) is None


def test_plain_blocks_slice_back():
    text = " Hello \n\n\n\nWörld\n\n  \n\nFoo"
    out = parse.plain_blocks(text.encode())
    assert [b[3] for b in out["blocks"]] == ["Hello", "Wörld", "Foo"]
    assert all(text.encode()[a:z].decode() == t for _, a, z, t in out["blocks"])


def test_text_functions(spark):
    row = spark.createDataFrame([("  x y  \nz",), ("é" * 150,)], "t string")
    got = row.select(tx.first_line(F.col("t")).alias("a"), tx.byte_prefix(F.col("t"), 3).alias("b"), tx.snippet(F.col("t")).alias("c"), tx.terms(F.lit("The Quick " + "a" * 50 + " über-x")).alias("d")).collect()
    assert got[0]["a"] == "x y" and got[1]["b"] == "é" and got[1]["c"] == "é" * 100 + "..."
    assert got[0]["d"] == ["the", "quick", "über", "x"]


def test_query_parser():
    q = query.parse('+a -b "c d"~2 (e AND NOT f)^2 doc_id:x1')
    assert [c.occur for c in q.clauses] == ["must", "must_not", "should", "should", "should"]
    assert q.clauses[2].node == query.Phrase(["c", "d"], 2) and q.clauses[4].node == query.Keyed("doc_id", "x1")
    assert query.parse("well-known").clauses[0].node == query.Phrase(["well", "known"])
    for bad in ("(a", "a)", "a AND", "AND a", 'a "b', "title:x"):
        with pytest.raises(EngineError) as e:
            query.parse(bad)
        assert e.value.code == "E_SEARCH_FAILED"


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("w", [1.0])], "segment_id string, embedding array<float>")
    one = [(r["segment_id"], round(r["vector_score"], 6)) for r in vectors.nearest(v, [1.0, 0.0, 0.0], 4).orderBy("vector_rank").collect()]
    assert one == [("a", 1.0), ("c", 0.707107), ("b", 0.0), ("z", 0.0)]
    q = v.where("segment_id in ('a', 'w')").withColumnRenamed("segment_id", "query_id")
    many = vectors.nearest_of_all(v, q, 2).orderBy("query_id", "vector_rank").collect()
    assert [(r["query_id"], r["segment_id"]) for r in many] == [("a", "a"), ("a", "c"), ("w", "w")]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("y", 0.5, 5)], "segment_id string, bm25_score double, bm25_rank int")
    b = spark.createDataFrame([("x", 1.0, 5), ("y", 0.5, 1), ("z", 0.1, 9)], "segment_id string, vector_score double, vector_rank int")
    rows = fusion.fuse(a, b).orderBy("fused_rank").collect()
    assert [r["segment_id"] for r in rows] == ["x", "y", "z"] and rows[0]["fused_score"] == rows[1]["fused_score"]


def plain_window(sizes, at, max_blocks, max_chars):
    got, used, lo, hi, before = [at], sizes[at], at - 1, at + 1, True
    while len(got) < max_blocks and used < max_chars and (lo >= 0 or hi < len(sizes)):
        go = lo if (before and lo >= 0) or hi >= len(sizes) else hi
        if used + sizes[go] > max_chars:
            break
        got.append(go)
        used += sizes[go]
        lo, hi = (lo - 1, hi) if go == lo else (lo, hi + 1)
        before = not before
    return sorted(got)


def test_context_window(spark):
    import random

    rng = random.Random(3)
    docs = {d: [rng.randint(1, 9) for _ in range(rng.randint(1, 12))] for d in range(40)}
    order = spark.createDataFrame([(d, i, "x" * n) for d, s in docs.items() for i, n in enumerate(s)], "doc_id long, position long, body string")
    hits = spark.createDataFrame([(d, d, rng.randrange(len(s))) for d, s in docs.items()], "hit long, doc_id long, position long")
    at = {r["hit"]: r["position"] for r in hits.collect()}
    got = {}
    for r in context.window(hits, order, "hit", max_blocks=5, max_chars=24).collect():
        got.setdefault(r["hit"], []).append(r["position"])
    assert {d: sorted(p) for d, p in got.items()} == {d: plain_window(s, at[d], 5, 24) for d, s in docs.items()}


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([("sea", "bay"), ("bay", "cove"), ("sea", "cove"), ("cove", "pool")], "ancestor string, descendant string")
    got = {(r["ancestor"], r["descendant"]): r["depth"] for r in taxonomy.closure(edges).collect()}
    assert got == {("sea", "bay"): 1, ("bay", "cove"): 1, ("sea", "cove"): 1, ("cove", "pool"): 1, ("bay", "pool"): 2, ("sea", "pool"): 2}
    back = edges.unionByName(spark.createDataFrame([("pool", "bay")], "ancestor string, descendant string"))
    with pytest.raises(EngineError):
        taxonomy.closure(back)
    assert taxonomy.closure(edges.limit(0)).count() == 0


def test_queries_have_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
