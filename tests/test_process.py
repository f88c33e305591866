"""The process entry, and what it plugs together: embedding services, converters, concurrent searches."""

import http.server
import io
import json
import stat
import sys
import threading

import pytest
from pyspark.sql import functions as F

from pagewright import __main__ as entry
from pagewright.errors import EngineError
from pagewright.functions.stats import nearest_rank
from pagewright.operators import parse, query, vectors
from pagewright.plans import ports
from pagewright.plans.engine import Engine


def run(home, *args, lines=()):
    out = io.StringIO()
    code = entry.main(["--home", home, *args], out, lines)
    return code, out.getvalue()


def test_commands(spark, tmp_path):
    home = f"file://{tmp_path}/kb"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Rivers run to the sea.\n\nMountains stay.")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    ok = lambda *a: json.loads(run(home, *a)[1])["result"]
    assert ok("init") == {"home": home, "created": True}
    assert ok("ingest", f"file://{tmp_path}/in")["failed"] == 1
    hit = ok("search", "rivers", "--mode", "bm25", "--expand")["hits"][0]
    assert hit["snippet"] == "Rivers run to the sea." and len(hit["context_window"]) == 2
    assert ok("explain", hit["result_id"])["doc_id"] == hit["doc_id"]
    assert ok("read", hit["doc_id"], "--mode", "outline")["content"]["lines"][1] == "[1] Mountains stay."
    assert len(ok("list")["documents"]) == 1 and ok("doctor")["healthy"] and ok("reindex")["segments"] == 2
    concept = ok("taxonomy", "add", "places", "Rivers")["concept_id"]
    ok("taxonomy", "assign", hit["doc_id"], concept)
    assert ok("list", "--concept", concept)["documents"] and "search" in ok("capabilities")["operations"]
    assert ok("config", "set", "search.limit", "3") == {"search.limit": 3} and ok("config", "get", "search.limit") == {"search.limit": 3}
    assert {r["key"]: r["value"] for r in ok("config", "show")}["search.limit"] == 3
    assert ok("execute", '[{"type": "call", "op": "list"}]')["steps_executed"] == 1
    code, out = run(home, "read", "nothing")
    assert code == 12 and json.loads(out)["error"]["code"] == "E_NOT_FOUND"
    assert run(home, "taxonomy", "add", "x")[0] == 2 and run(home, "execute", "no json")[0] == 2
    assert run(home, "remove", hit["doc_id"])[0] == 0 and not ok("search", "rivers", "--mode", "bm25")["hits"]
    request = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "execute", "arguments": {"program": [{"type": "call", "op": "list"}]}}})
    assert "DELETED" in run(home, "serve", lines=[request, ""])[1]
    assert all("search" in run(home, "completions", s)[1] for s in entry.SHELLS)


def test_searches_do_not_wait_for_one_another(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/kb")
    engine.init()
    (tmp_path / "a.txt").write_text("one lantern\n\ntwo lanterns")
    engine.add(f"file://{tmp_path}/a.txt")
    found, errors = [], []

    def search():
        try:
            found.append(engine.search("lantern", "bm25")["hits"][0]["result_id"])
        except Exception as e:  # what went wrong in the thread
            errors.append(e)

    with engine.tables.writing():  # even while another process writes
        threads = [threading.Thread(target=search) for _ in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert not errors and len(set(found)) == 1 and engine.explain(found[0])["query"] == "lantern"


def test_latest_reads_what_is_asked(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/kb")
    engine.init()
    (tmp_path / "a.txt").write_text("text")
    engine.add(f"file://{tmp_path}/a.txt")
    plan = engine._live()._jdf.queryExecution().toString()
    read = plan[plan.index("== Physical Plan ==") :].split("ReadSchema: ")[1].split("\n")[0]
    assert "canonical_text" not in read and "blocks" not in read and "state" in read


@pytest.fixture
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        dims = 3

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = [{"index": i, "embedding": [float(len(t))] * self.dims} for i, t in enumerate(body["input"])]
            self.send_response(200 if self.headers.get("Authorization") == "Bearer key" else 401)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data[::-1]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_embedding_service(service):
    embedder = ports.over_http(ports.post_to(service, "key"), "m", 3)
    assert embedder.embed(["a", "bbb"]) == [[1.0] * 3, [3.0] * 3]
    for broken in (ports.over_http(ports.post_to(service, "key"), "m", 4), ports.over_http(ports.post_to(service, "wrong"), "m", 3), ports.over_http(ports.post_to("http://127.0.0.1:1"), "m", 3), ports.over_http(lambda body: {}, "m", 3)):
        with pytest.raises(EngineError) as e:
            broken.embed(["a"])
        assert e.value.code == "E_EMBED_FAIL"


def test_external_converter(tmp_path):
    script = tmp_path / "convert"
    export = {"schema_name": "DoclingDocument", "texts": [{"label": "text", "text": "SIZE"}], "body": {"children": [{"$ref": "#/texts/0"}]}}
    script.write_text(f"#!{sys.executable}\nimport sys\ndata = open(sys.argv[-1], 'rb').read()\nif data == b'bad': sys.exit(3)\nif data == b'none': sys.exit(0)\nopen(sys.argv[sys.argv.index('--output') + 1] + '/x.json', 'w').write({json.dumps(json.dumps(export))}.replace('SIZE', str(len(data))))\n")
    script.chmod(script.stat().st_mode | stat.S_IXUSR)
    convert = parse.external([str(script)])
    assert convert(b"12345")["blocks"] == [("PARAGRAPH", 0, 1, "5")]
    for data in (b"bad", b"none"):
        with pytest.raises(RuntimeError):
            convert(data)


def test_more_of_the_query_language(spark):
    bodies = {"a": "red green blue", "b": "green red", "c": "red x green", "d": "redder greens", "e": "blue y z red", "f": "red p q green"}
    rows = [(i, t, pos) for i, body in bodies.items() for pos, t in enumerate(body.split())]
    posted = spark.createDataFrame(rows, "segment_id string, term string, position int").groupBy("term", "segment_id").agg(F.array_sort(F.collect_list("position")).alias("positions")).withColumn("tf", F.size("positions"))
    lens = spark.createDataFrame([(i, len(b.split())) for i, b in bodies.items()], "segment_id string, doc_len long")
    index = query.Index(posted, lens, (6, 2.5), lens.select("segment_id", F.lit("d").alias("doc_id")))
    ids = lambda q: "".join(sorted(r["segment_id"] for r in query.search(spark, index, q, 10).collect()))
    assert ids("[blue TO green]") == "abcef" and ids("{blue TO greens}") == "abcf" and ids("[redder TO *]") == "cde"
    assert ids("IN [redder y]") == "de" and ids("*") == "abcdef" and ids("segment_id:[a TO b]") == "ab" and ids("segment_id:IN [c e]") == "ce"
    assert ids("gree*") == "abcdf" and ids('"red gree"*') == "a" and ids("+gree* -redder") == "abcf"
    assert ids('"red green"') == "a" and ids('"red green"~1') == "ac" and ids('"red green"~2') == "abcf"
    # The slop is one for all words together.
    assert ids('"red green blue"~0') == "a" and ids('"blue y red"~1') == "e" and ids('"red q green"~1') == "f" and ids('"p red green"~1') == ""
    for bad in ("[a b]", "[a TO b", "IN [a", "a?b", "w*rd"):
        with pytest.raises(EngineError):
            query.parse(bad)


def test_vector_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d1", [1.0, 0.0]), ("b", "d1", [0.0, 1.0]), ("c", "d2", [1.0, 1.0])], "segment_id string, doc_id string, embedding array<float>")
    index = vectors.VectorIndex.empty(spark, 2).upsert(rows)
    index = index.upsert(rows.where("segment_id = 'a'").withColumn("embedding", F.array(F.lit(0.0), F.lit(-1.0)).cast("array<float>")))
    assert index.count() == 3 and index.dimensions() == 2
    assert [r["segment_id"] for r in index.search([1.0, 0.0], 3).orderBy("vector_rank").collect()] == ["c", "a", "b"]
    assert index.delete(rows.where("segment_id = 'c'")).count() == 2 and index.delete_by_doc(rows.where("doc_id = 'd1'").select("doc_id")).count() == 1
    for wrong in (lambda: index.search([1.0], 1), lambda: index.upsert(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))):
        with pytest.raises(EngineError):
            wrong()
    mark = index.flush(f"file://{tmp_path}/v")
    assert vectors.VectorIndex.open(spark, f"file://{tmp_path}/v", 2, mark).count() == 3
    with pytest.raises(EngineError):
        vectors.VectorIndex.open(spark, f"file://{tmp_path}/v", 2, "other")


def test_nearest_rank(spark):
    values = [3, 1, 2, 2, 9, 4, 7]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 5.0), ("none", None)], "key string, v double")
    got = {r["key"]: tuple(r)[1:] for r in nearest_rank(df, "key", "v", (0.5, 0.95)).collect()}
    assert got == {"k": (7, 3.0, 9.0), "one": (1, 5.0, 5.0)}
