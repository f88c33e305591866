"""Reciprocal rank fusion of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(bm25: DataFrame, vector: DataFrame, key: str = "segment_id", query: str | None = None, limit: int | None = None) -> DataFrame:
    """Hits of either source with fused_score and fused_rank; ties go to the smaller key.

    bm25 has bm25_rank, vector has vector_rank; an absent rank adds nothing.
    """
    on = [query, key] if query else [key]
    both = bm25.join(vector, on, "full_outer")
    score = F.coalesce(1 / (F.lit(K) + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(K) + F.col("vector_rank")), F.lit(0.0))
    w = (Window.partitionBy(query) if query else Window).orderBy(F.desc("fused_score"), key)
    scored = both.withColumn("fused_score", score)
    if not query and limit is not None:
        scored = scored.orderBy(F.desc("fused_score"), key).limit(limit)
    ranked = scored.withColumn("fused_rank", F.row_number().over(w))
    return ranked.where(F.col("fused_rank") <= limit) if limit is not None else ranked
