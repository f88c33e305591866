"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, drop


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m")), "least")
    far = both.where("v > u")
    return far.join(least, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), "m"), "least")
    moved = edges.join(least, F.col("u") == F.col("u2")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("u2").alias("u"), F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the least node it reaches.

    Alternates the large-star and small-star steps of Kiveris et al. until the links are stars;
    each is an aggregation, cut from its lineage, and a join with it. Both sides of the joins are
    table scans, so that Spark can split what one node with very many links brings to a task.
    Self links and repeated links are allowed; no links give no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        for step in (_large_star, _small_star):
            after, least = step(now)
            after = cut(after, "stars")
            drop(now, least)
            now = after
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
    out = cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    drop(now)
    return out
