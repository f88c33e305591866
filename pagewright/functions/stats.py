"""Statistics over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(key, n, p<percent> for each share): the value at the rounded place share x (n - 1) of each group's sorted values.

    Equal values are counted before they are ranked, so a group is as many rows as it has values.
    Nulls don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("c").over(w)})
    at = {p: F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) for p in shares}
    return ranked.groupBy(key, "n").agg(*(F.min(F.when(F.col("upto") > a, F.col(value))).alias(f"p{round(100 * p)}") for p, a in at.items()))
