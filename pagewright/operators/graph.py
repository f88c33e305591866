"""Block graphs: edges, reading order, segments, validation and fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as tx

READS_BEFORE, CAPTION_OF, FOOTNOTE_OF, REFERS_TO = RELATIONS = ("READS_BEFORE", "CAPTION_OF", "FOOTNOTE_OF", "REFERS_TO")


def reading_order(blocks: DataFrame, keys: list[str], idx: str = "block_idx") -> DataFrame:
    """(keys, position, block_idx): blocks are read as they stand."""
    return blocks.select(*keys, F.col(idx).alias("position"), F.col(idx).alias("block_idx"))


def chain(order: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, from_idx, to_idx, relation): an edge between neighbours of the reading order."""
    w = Window.partitionBy(*keys).orderBy("position")
    return order.select(*keys, F.col("block_idx").alias("from_idx"), F.lead("block_idx").over(w).alias("to_idx"), F.lit(READS_BEFORE).alias("relation")).where("to_idx IS NOT NULL")


def segments(order: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(segment_id, doc_id, seg_index, span_start, span_end, body): non-blank blocks in reading order, numbered without holes."""
    body = tx.trim(F.col("canonical_text"))
    ordered = order.join(blocks, [key, "block_idx"]).where(body != "")
    w = Window.partitionBy(key).orderBy("position")
    numbered = ordered.select(key, (F.row_number().over(w) - 1).cast("bigint").alias("seg_index"), "span_start", "span_end", body.alias("body"))
    return numbered.select(tx.derived_id("seg", F.col(key), F.col("seg_index")).alias("segment_id"), key, "seg_index", "span_start", "span_end", "body")


def exploded(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Block rows of documents whose blocks stand in an array, in order; the array's order is the reading order."""
    return docs.select(key, F.posexplode("blocks").alias("pos", "b")).select(key, F.col("pos").cast("bigint").alias("block_idx"), "b.kind", "b.span_start", "b.span_end", F.col("b.text").alias("canonical_text"))


def segments_of(docs: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Segments straight from the block arrays of documents, with ``more`` of their columns: no shuffle, since an array is in reading order."""
    trimmed = F.transform("blocks", lambda b: F.struct(b["span_start"].alias("span_start"), b["span_end"].alias("span_end"), tx.trim(b["text"]).alias("body")))
    rows = docs.select(key, *more, F.posexplode(F.filter(trimmed, lambda b: b["body"] != "")).alias("pos", "b"))
    index = F.col("pos").cast("bigint")
    return rows.select(tx.derived_id("seg", F.col(key), index).alias("segment_id"), key, index.alias("seg_index"), "b.span_start", "b.span_end", "b.body", *more)


def order_of(docs: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, position, block_idx) straight from the block arrays of documents, with ``more`` of their columns."""
    return docs.select(key, *more, F.posexplode("blocks").alias("pos", "b")).select(key, *more, F.col("pos").cast("bigint").alias("position"), F.col("pos").cast("bigint").alias("block_idx"))


def edges_of(docs: DataFrame, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, from_idx, to_idx, relation): each block reads before the next of its array; with ``more`` columns of the documents."""
    at = docs.where(F.size("blocks") > 1).select(key, *more, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.size("blocks") - 2).cast("bigint"))).alias("from_idx"))
    return at.select(key, *more, "from_idx", (F.col("from_idx") + 1).alias("to_idx"), F.lit(READS_BEFORE).alias("relation"))


def problem_of(size: int, spans: list[tuple[int, int]], order: list[int] | None = None, edges: list[tuple[int, int, str]] | None = None) -> str | None:
    """The first thing wrong with a graph over a text of ``size`` bytes, or None."""
    n = len(spans)
    for k, (a, z) in enumerate(spans):
        if not 0 <= a <= z <= size:
            return f"block {k}: span [{a}, {z}) is outside the text of {size} bytes"
    if order is not None:
        if any(not 0 <= k < n for k in order):
            return "reading order names a block that isn't there"
        if len(set(order)) != len(order):
            return "reading order names a block twice"
        if len(order) != n:
            return "reading order leaves blocks out"
    for a, z, _ in edges or []:
        if not (0 <= a < n and 0 <= z < n):
            return f"edge {a} -> {z} names a block that isn't there"
    after: dict[int, list[int]] = {}
    indegree = [0] * n
    for a, z, relation in edges or []:
        if relation == READS_BEFORE:
            after.setdefault(a, []).append(z)
            indegree[z] += 1
    ready = [k for k in range(n) if not indegree[k]]
    done = 0
    while ready:
        done += 1
        for z in after.get(ready.pop(), []):
            indegree[z] -= 1
            if not indegree[z]:
                ready.append(z)
    return None if done == n else "reading edges form a cycle"


def violations(docs: DataFrame, blocks: DataFrame, order: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, problem): graphs that break a rule, as set operations over the tables.

    docs has ``key`` and canonical_text. Checked are spans outside the text, reading orders with
    unknown, repeated or missing blocks, edges to unknown blocks, and reading edges against the
    reading order (which any cycle has).
    """
    size = docs.select(key, F.octet_length("canonical_text").alias("size"))
    spans = blocks.join(size, key).where((F.col("span_start") < 0) | (F.col("span_start") > F.col("span_end")) | (F.col("span_end") > F.col("size"))).select(key, F.lit("SPAN_OUT_OF_BOUNDS").alias("problem"))
    there = blocks.select(key, "block_idx")
    unknown = order.join(there, [key, "block_idx"], "left_anti").select(key, F.lit("ORDER_OUT_OF_BOUNDS").alias("problem"))
    twice = order.groupBy(key, "block_idx").count().where("count > 1").select(key, F.lit("ORDER_DUPLICATE").alias("problem"))
    missing = there.join(order, [key, "block_idx"], "left_anti").select(key, F.lit("ORDER_INCOMPLETE").alias("problem"))
    ends = edges.select(key, F.explode(F.array("from_idx", "to_idx")).alias("block_idx")).join(there, [key, "block_idx"], "left_anti").select(key, F.lit("EDGE_OUT_OF_BOUNDS").alias("problem"))
    at = order.select(key, F.col("block_idx").alias("b"), "position")
    source = at.select(key, F.col("b").alias("from_idx"), F.col("position").alias("p1"))
    target = at.select(key, F.col("b").alias("to_idx"), F.col("position").alias("p2"))
    back = edges.where(F.col("relation") == READS_BEFORE).join(source, [key, "from_idx"]).join(target, [key, "to_idx"]).where("p1 >= p2").select(key, F.lit("READING_CYCLE").alias("problem"))
    out = spans
    for part in (unknown, twice, missing, ends, back):
        out = out.unionByName(part)
    return out.distinct()


def fidelity(blocks: DataFrame, kinds: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Per document: blocks, kinds among them, and a count for each kind."""
    return blocks.groupBy(key).agg(F.count("*").alias("n_blocks"), F.countDistinct("kind").alias("n_kinds"), *(F.sum((F.col("kind") == k).cast("bigint")).alias(f"n_{k.lower()}") for k in kinds))
