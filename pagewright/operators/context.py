"""From hits to blocks and the blocks around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_blocks(hits: DataFrame, blocks: DataFrame, hit: str, doc: str = "doc_id") -> DataFrame:
    """(hit, doc, block_idx): the block that shares most bytes with the hit's span; the first on ties, block 0 if none.

    An interval join within the document: equal documents first, then overlapping spans.
    """
    h, b = hits.select(hit, doc, "span_start", "span_end").alias("h"), blocks.select(doc, "block_idx", "span_start", "span_end").alias("b")
    overlap = F.least("h.span_end", "b.span_end") - F.greatest("h.span_start", "b.span_start")
    joined = h.join(b, (F.col(f"h.{doc}") == F.col(f"b.{doc}")) & (F.col("h.span_start") < F.col("b.span_end")) & (F.col("b.span_start") < F.col("h.span_end")), "left")
    best = F.max_by("block_idx", F.struct("overlap", -F.col("block_idx")))
    return joined.select(f"h.{hit}", f"h.{doc}", F.col("b.block_idx"), overlap.alias("overlap")).groupBy(hit, doc).agg(F.coalesce(best, F.lit(0)).cast("bigint").alias("block_idx"))


def window(hits: DataFrame, order: DataFrame, hit: str, doc: str = "doc_id", *, max_blocks: int = 12, max_chars: int = 8000) -> DataFrame:
    """(hit, doc, position, body, is_hit): the hit and the blocks around it, in reading order.

    hits has (hit, doc, position); order has (doc, position, body). The hit is always there. From it
    the window grows one block before, one behind, and so on; past an end of the document only on
    the other side. It ends before the first block that would exceed ``max_blocks`` blocks or
    ``max_chars`` bytes, or once the bytes are used up.
    """
    around = hits.select(hit, doc, F.col("position").alias("at")).join(order.select(doc, "position", "body"), doc)
    far = F.abs(F.col("position") - F.col("at"))
    # Only blocks within reach can get in, whichever side they are on.
    around = around.where(far < max_blocks)
    visit = F.when(F.col("position") < F.col("at"), 2 * far - 1).otherwise(2 * far)
    w = Window.partitionBy(hit, doc).orderBy("visit")
    step = around.withColumn("visit", visit).withColumn("size", F.octet_length("body"))
    step = step.withColumn("n", F.row_number().over(w)).withColumn("total", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fails = (F.col("n") > 1) & ((F.col("total") > max_chars) | (F.col("n") > max_blocks) | (F.col("total") - F.col("size") >= max_chars))
    first_fail = F.min(F.when(fails, F.col("n"))).over(Window.partitionBy(hit, doc))
    kept = step.withColumn("stop", first_fail).where(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    return kept.select(hit, doc, "position", "body", (F.col("position") == F.col("at")).alias("is_hit"))


def as_array(windows: DataFrame, hit: str, doc: str = "doc_id") -> DataFrame:
    """(hit, doc, context_window): the window's blocks in one array, in reading order."""
    return windows.groupBy(hit, doc).agg(F.array_sort(F.collect_list(F.struct("position", "body", "is_hit"))).alias("context_window"))
