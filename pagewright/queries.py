"""The engine's operators as queries over the driver's tables, each with the same query in SQL.

A document's lines are its blocks, a conversation is a document whose turns are its blocks, and
``vec_id`` is the ``doc_id`` of a vector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import context, enrich, fulltext, fusion, graph, parse, taxonomy, vectors

#: The words and the vector that single-query searches look for.
WORDS = "the license version que mente"
VECTOR_ID = 7
TOP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], F.col("text"), "\n")


def segments(spark, sf_dir):
    """Every line of every document as a segment with its byte span."""
    return _segments(spark, sf_dir).withColumnRenamed("block_idx", "seg_index")


def span_round_trip(spark, sf_dir):
    """Segments whose span doesn't slice back to their body, by length: none."""
    rows = _segments(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    same = tx.slice_bytes(F.col("text"), F.col("span_start"), F.col("span_end")) == F.col("body")
    return rows.groupBy(same.alias("same")).agg(F.count("*").alias("n"), F.sum(tx.span_length(F.col("span_start"), F.col("span_end"))).alias("bytes"))


def reading_chain(spark, sf_dir):
    """Edges between neighbouring turns of every conversation."""
    order = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").alias("block_idx"))
    return graph.chain(order, ["conv_id"])


def plain_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_line(F.col("text")).alias("title"))


def content_identity(spark, sf_dir):
    """Documents by content: the id that equal contents share, and how many there are."""
    rows = table(spark, sf_dir, "documents").select(tx.content_id("doc", F.coalesce("text", F.lit(""))).alias("content_id"), "doc_id")
    return rows.groupBy("content_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def term_frequencies(spark, sf_dir):
    """Per term: documents that hold it and its occurrences."""
    counts = fulltext.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def corpus_statistics(spark, sf_dir):
    stats = fulltext.corpus_stats(fulltext.lengths(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return stats.select("n_segments", F.round("avg_len", 6).alias("avg_len"))


def _bm25(spark, sf_dir, wanted):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lens = fulltext.lengths(docs, "doc_id", "text")
    return fulltext.bm25(fulltext.term_counts(docs, "doc_id", "text"), lens, fulltext.corpus_stats(lens), wanted, "doc_id")


def bm25_top(spark, sf_dir):
    """The best documents for one query."""
    query = spark.createDataFrame([(1, WORDS)], "query_id long, text string")
    best = fulltext.top_one(_bm25(spark, sf_dir, fulltext.query_terms(query, "query_id", "text")), TOP, "bm25_score", "doc_id", "bm25_rank")
    return best.select("doc_id", F.round("bm25_score", 6).alias("bm25_score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


def bm25_batch(spark, sf_dir):
    """The ten best documents for every item of the benchmark."""
    scores = _bm25(spark, sf_dir, fulltext.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    rounded = scores.withColumn("bm25_score", F.round("bm25_score", 6))
    best = fulltext.top(rounded, 10, "bm25_score", "doc_id", "bm25_rank")
    return best.select(F.col("query_id").alias("item_id"), "doc_id", "bm25_score", F.col("bm25_rank").cast("long").alias("bm25_rank"))


def knn(spark, sf_dir):
    """The nearest vectors of one query vector."""
    rows = table(spark, sf_dir, "embeddings")
    query = [float(x) for x in rows.where(F.col("vec_id") == VECTOR_ID).first()["embedding"]]
    best = vectors.nearest(rows, query, TOP, "vec_id")
    return best.select("vec_id", F.round("vector_score", 6).alias("vector_score"), F.col("vector_rank").cast("long").alias("vector_rank"))


def knn_batch(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = vectors.nearest_of_all(rows, queries, 5, "vec_id")
    return best.select("query_id", "vec_id", F.round("vector_score", 6).alias("vector_score"), F.col("vector_rank").cast("long").alias("vector_rank"))


def hybrid(spark, sf_dir):
    """Words and vector fused by reciprocal ranks."""
    words = bm25_top(spark, sf_dir)
    near = knn(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    fused = fusion.fuse(words, near, "doc_id", limit=TOP)
    ranks = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bm25_rank", "vector_rank"))
    return fused.select("doc_id", *ranks, F.round("fused_score", 9).alias("fused_score"), F.col("fused_rank").cast("long").alias("fused_rank"))


def _turns(spark, sf_dir):
    """Turns of conversations with the byte spans they have in the whole text, divided by blank lines."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("block_idx")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), "role", F.coalesce("text", F.lit("")).alias("body"))
    start = F.coalesce(F.sum(F.octet_length("body") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("span_start", start).withColumn("span_end", F.col("span_start") + F.octet_length("body"))


def block_resolution(spark, sf_dir):
    """For every 100-byte stretch of every conversation, the turn that shares most bytes with it."""
    blocks = _turns(spark, sf_dir)
    size = blocks.groupBy("doc_id").agg(F.max("span_end").alias("size"))
    stretch = size.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(100).cast("long"))).alias("span_start"), "size")
    hits = stretch.select("doc_id", "span_start", F.least(F.col("span_start") + 100, F.col("size")).alias("span_end"), (F.col("doc_id") * 1_000_000 + F.col("span_start")).alias("hit"))
    return context.resolve_blocks(hits, blocks, "hit")


def context_windows(spark, sf_dir):
    """For the second turn of every conversation, the turns around it within 5 blocks and 600 bytes."""
    order = _turns(spark, sf_dir).select("doc_id", F.col("block_idx").alias("position"), "body")
    hits = order.where("position = 1").select(F.col("doc_id").alias("hit"), "doc_id", "position")
    return context.window(hits, order, "hit", max_blocks=5, max_chars=600).select("hit", "position", "body", "is_hit")


def enrichment(spark, sf_dir):
    """Title, summary and tags of every document."""
    found = enrich.enrich(table(spark, sf_dir, "documents"), "text")
    return found.select("doc_id", "title", F.octet_length("summary").cast("long").alias("summary_bytes"), F.array_join("tags", "|").alias("tags"), "content_hash")


def outline(spark, sf_dir):
    """The first lines of each conversation's turns."""
    rows = table(spark, sf_dir, "conversations")
    first = F.coalesce(F.try_element_at(tx.lines(F.coalesce("text", F.lit(""))), F.lit(1)), F.lit(""))
    return rows.select("conv_id", "turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), first).alias("line"))


def fidelity(spark, sf_dir):
    """Turns of each conversation by role."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"))
    return graph.fidelity(rows, ("user", "assistant", "system"))


def graph_violations(spark, sf_dir):
    """Rules that the graphs of conversations break, after one edge of each is turned around."""
    blocks = _turns(spark, sf_dir).withColumnRenamed("body", "canonical_text")
    docs = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "canonical_text"))), lambda x: x["canonical_text"]), "\n\n").alias("canonical_text"))
    order = graph.reading_order(blocks, ["doc_id"])
    edges = graph.chain(order, ["doc_id"])
    turned = F.col("from_idx") == 0
    edges = edges.select("doc_id", F.when(turned, F.col("to_idx")).otherwise(F.col("from_idx")).alias("from_idx"), F.when(turned, F.col("from_idx")).otherwise(F.col("to_idx")).alias("to_idx"), "relation")
    return graph.violations(docs, blocks, order, edges)


def taxonomy_closure(spark, sf_dir):
    """Part types as a hierarchy of their words: ancestors of every type, with depth."""
    types = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    up = types.select(F.concat(F.lit("brand:"), "p_brand").alias("ancestor"), F.concat(F.lit("type:"), "p_type").alias("descendant"))
    top = types.select(F.lit("root").alias("ancestor"), F.concat(F.lit("brand:"), "p_brand").alias("descendant"))
    return taxonomy.closure(up.unionByName(top)).withColumn("depth", F.col("depth").cast("long"))


def geography_closure(spark, sf_dir):
    """World, regions, nations and suppliers as one hierarchy."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    edges = r.select(F.lit("world").alias("ancestor"), F.concat(F.lit("r"), "r_regionkey").alias("descendant"))
    edges = edges.unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("ancestor"), F.concat(F.lit("n"), "n_nationkey").alias("descendant")))
    edges = edges.unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("ancestor"), F.concat(F.lit("s"), "s_suppkey").alias("descendant")))
    return taxonomy.closure(edges).withColumn("depth", F.col("depth").cast("long"))


def result_identity(spark, sf_dir):
    """Ids of results: query and segment, digested."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", tx.derived_id("res", F.col("text"), F.col("item_id"), digits=16).alias("result_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        segments, span_round_trip, reading_chain, plain_titles, content_identity, term_frequencies, corpus_statistics, bm25_top, bm25_batch, knn, knn_batch, hybrid,
        block_resolution, context_windows, enrichment, outline, fidelity, graph_violations, taxonomy_closure, geography_closure, result_identity,
    )
}

_SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LEAD = f"regexp_replace(part, '^{_SPACE}+', '')"


def _trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_PARTS = "parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
_SPANS = f"""{_PARTS},
    placed AS (SELECT doc_id, pos, part, coalesce(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM parts),
    spans AS (SELECT doc_id, pos, CAST(begins + strlen(part) - strlen({_LEAD}) AS BIGINT) AS span_start, {_trimmed("part")} AS body FROM placed),
    segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seg_index, span_start, CAST(span_start + strlen(body) AS BIGINT) AS span_end, body FROM spans WHERE body <> '')"""
_TOKENS = r"""toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40)) AS t FROM documents),
    tf AS (SELECT lower(t) AS term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
    lens AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40)) AS doc_len FROM documents WHERE text IS NOT NULL),
    stats AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_SCORED = f"""{_TOKENS},
    scored AS (SELECT q.query_id, tf.doc_id, round(sum(q.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25_score
               FROM wanted q JOIN tf USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY ALL)"""
_WORDS = f"wanted AS (SELECT 1 AS query_id, unnest(string_split('{WORDS}', ' ')) AS term, 1 AS times)"
_BEST = f"best AS (SELECT doc_id, bm25_score, row_number() OVER (ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM scored QUALIFY bm25_rank <= {TOP})"
_COSINE = "CASE WHEN sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) END"
_VECS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_NEAR = f"near AS (SELECT a.vec_id, round({_COSINE}, 6) AS vector_score, row_number() OVER (ORDER BY {_COSINE} DESC, a.vec_id) AS vector_rank FROM vecs a, vecs b WHERE b.vec_id = {VECTOR_ID} QUALIFY vector_rank <= {TOP})"
_TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS block_idx, role, coalesce(text, '') AS body,
        CAST(coalesce(sum(strlen(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM conversations),
    blocks AS (SELECT *, span_start + strlen(body) AS span_end FROM turns)"""
_LINES = "CASE WHEN ends_with(replace({0}, chr(13) || chr(10), chr(10)), chr(10)) OR {0} = '' THEN list_slice(string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)), 1, -2) ELSE string_split(replace({0}, chr(13) || chr(10), chr(10)), chr(10)) END"
_FIRST = "list_filter(list_transform(" + _LINES.format("text") + ", lambda x: " + _trimmed("x") + "), lambda x: x <> '')[1]"
_CLOSURE = """, paths AS (SELECT DISTINCT ancestor, descendant, CAST(1 AS BIGINT) AS depth FROM edges
        UNION SELECT p.ancestor, e.descendant, p.depth + 1 FROM paths p JOIN edges e ON p.descendant = e.ancestor)
    SELECT ancestor, descendant, min(depth) AS depth FROM paths GROUP BY ALL"""

ORACLE_SQL: dict[str, str] = {
    "segments": f"WITH {_SPANS} SELECT doc_id, seg_index, span_start, span_end, body FROM segs",
    "span_round_trip": f"WITH {_SPANS} SELECT true AS same, count(*) AS n, CAST(sum(span_end - span_start) AS BIGINT) AS bytes FROM segs",
    "reading_chain": "SELECT conv_id, turn AS from_idx, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS to_idx, 'READS_BEFORE' AS relation FROM conversations QUALIFY to_idx IS NOT NULL",
    "plain_titles": f"SELECT doc_id, {_FIRST} AS title FROM documents",
    "content_identity": "SELECT 'doc_' || sha256(coalesce(text, '')) AS content_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL",
    "term_frequencies": f"WITH {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM tf GROUP BY term",
    "corpus_statistics": f"WITH {_TOKENS} SELECT n AS n_segments, round(avg_len, 6) AS avg_len FROM stats",
    "bm25_top": f"WITH {_WORDS}, {_SCORED}, {_BEST} SELECT doc_id, bm25_score, bm25_rank FROM best",
    "bm25_batch": rf"WITH words AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)) AS t FROM benchmark), wanted AS (SELECT item_id AS query_id, lower(t) AS term, count(*) AS times FROM words GROUP BY ALL), {_SCORED} SELECT query_id AS item_id, doc_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM scored QUALIFY bm25_rank <= 10",
    "knn": f"WITH {_VECS}, {_NEAR} SELECT vec_id, vector_score, vector_rank FROM near",
    "knn_batch": f"WITH {_VECS} SELECT b.vec_id AS query_id, a.vec_id, round({_COSINE}, 6) AS vector_score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COSINE} DESC, a.vec_id) AS vector_rank FROM vecs a, vecs b WHERE b.vec_id % 20 = 0 QUALIFY vector_rank <= 5",
    "hybrid": f"WITH {_WORDS}, {_SCORED}, {_BEST}, {_VECS}, {_NEAR}, fused AS (SELECT coalesce(best.doc_id, near.vec_id) AS doc_id, bm25_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS s FROM best FULL JOIN near ON best.doc_id = near.vec_id) SELECT doc_id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, round(s, 9) AS fused_score, row_number() OVER (ORDER BY s DESC, doc_id) AS fused_rank FROM fused QUALIFY fused_rank <= {TOP}",
    "block_resolution": f"""WITH {_TURNS}, sizes AS (SELECT doc_id, max(span_end) AS size FROM blocks GROUP BY doc_id),
        hits AS (SELECT doc_id, size, unnest(range(0, greatest(size - 1, 0) + 1, 100)) AS s FROM sizes),
        o AS (SELECT h.doc_id * 1000000 + h.s AS hit, h.doc_id, b.block_idx, least(s + 100, size, b.span_end) - greatest(s, b.span_start) AS shared FROM hits h LEFT JOIN blocks b ON h.doc_id = b.doc_id AND b.span_start < least(s + 100, size) AND s < b.span_end)
        SELECT hit, doc_id, coalesce(block_idx, 0) AS block_idx FROM o QUALIFY row_number() OVER (PARTITION BY hit ORDER BY shared DESC, block_idx) = 1""",
    "context_windows": f"""WITH {_TURNS}, a AS (SELECT h.doc_id AS hit, b.block_idx AS position, b.body, b.block_idx = h.block_idx AS is_hit, abs(b.block_idx - h.block_idx) AS far, b.block_idx < h.block_idx AS before FROM blocks h JOIN blocks b USING (doc_id) WHERE h.block_idx = 1),
        v AS (SELECT *, row_number() OVER w AS n, sum(strlen(body)) OVER w AS total FROM a WINDOW w AS (PARTITION BY hit ORDER BY CASE WHEN before THEN 2 * far - 1 ELSE 2 * far END)),
        f AS (SELECT *, min(CASE WHEN n > 1 AND (total > 600 OR n > 5 OR total - strlen(body) >= 600) THEN n END) OVER (PARTITION BY hit) AS stop FROM v)
        SELECT hit, position, body, is_hit FROM f WHERE stop IS NULL OR n < stop""",
    "enrichment": f"""WITH l AS (SELECT doc_id, text, {_FIRST} AS first, list_transform({_LINES.format("text")}, lambda x: {_trimmed("x")}) AS lines FROM documents),
        h AS (SELECT *, {_trimmed("regexp_replace(first, '^#+', '')")} AS head, list_filter(list_transform(list_filter(lines, lambda x: starts_with(x, '#')), lambda x: lower({_trimmed("regexp_replace(x, '^#+', '')")})), lambda x: x <> '') AS tags FROM l)
        SELECT doc_id, CASE WHEN starts_with(first, '#') AND head <> '' THEN head ELSE first END AS title, CAST(strlen(CASE WHEN text <> '' THEN substr(text, 1, 500) END) AS BIGINT) AS summary_bytes, coalesce(array_to_string(list_transform(range(1, len(tags) + 1), lambda i: CASE WHEN list_position(tags, tags[i]) = i THEN tags[i] END), '|'), '') AS tags, sha256(text) AS content_hash FROM h""",
    "outline": f"SELECT conv_id, turn, '[' || turn || '] ' || coalesce(({_LINES.format('coalesce(text, chr(0))')})[1], '') AS line FROM conversations".replace("chr(0)", "''"),
    "fidelity": "SELECT conv_id AS doc_id, count(*) AS n_blocks, count(DISTINCT role) AS n_kinds, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_user, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_assistant, CAST(count(*) FILTER (role = 'system') AS BIGINT) AS n_system FROM conversations GROUP BY conv_id",
    "graph_violations": "SELECT conv_id AS doc_id, 'READING_CYCLE' AS problem FROM conversations GROUP BY conv_id HAVING count(*) > 1 AND min(turn) = 0",
    "taxonomy_closure": "WITH RECURSIVE edges AS (SELECT DISTINCT 'brand:' || p_brand AS ancestor, 'type:' || p_type AS descendant FROM part UNION SELECT DISTINCT 'root', 'brand:' || p_brand FROM part)" + _CLOSURE,
    "geography_closure": "WITH RECURSIVE edges AS (SELECT 'world' AS ancestor, 'r' || r_regionkey AS descendant FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)" + _CLOSURE,
    "result_identity": "SELECT item_id, 'res_' || substr(sha256(text || ':' || item_id), 1, 16) AS result_id FROM benchmark",
}
