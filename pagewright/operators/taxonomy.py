"""Concept graphs: closure and import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError
from pagewright.functions import text as tx
from pagewright.lineage import cut

BROADER, NARROWER, RELATED = "BROADER", "NARROWER", "RELATED"


def closure(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut, *, check_cycles: bool = True) -> DataFrame:
    """(ancestor, descendant, depth): all pairs that a path of ``edges`` (ancestor, descendant) connects, with the shortest depth.

    Breadth first: round k writes the pairs at distance k only, and ``cut`` ends its lineage; what
    earlier rounds wrote is read, never written again.
    """
    step = cut(edges.select("ancestor", "descendant").where("ancestor <> descendant").distinct())
    if check_cycles and not edges.where("ancestor = descendant").isEmpty():
        raise EngineError("E_TAXONOMY_CYCLE", "a concept is its own ancestor")
    found = step.select("ancestor", "descendant", F.lit(1).alias("depth"))
    frontier, depth = found, 1
    while True:
        depth += 1
        next_ = frontier.select("ancestor", F.col("descendant").alias("via")).join(step.select(F.col("ancestor").alias("via"), "descendant"), "via").select("ancestor", "descendant").distinct()
        if check_cycles and not next_.where("ancestor = descendant").isEmpty():
            raise EngineError("E_TAXONOMY_CYCLE", "a concept is its own ancestor")
        frontier = cut(next_.where("ancestor <> descendant").join(found, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


IMPORT_SCHEMA = "scheme_uri string, pref_label string, alt_labels array<string>, definition string, broader array<string>, narrower array<string>, related array<string>"


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(IMPORT_SCHEMA).json(path)


def concept_id(scheme, label):
    return tx.derived_id("con", scheme, label)


def concepts_of(rows: DataFrame) -> DataFrame:
    """(concept_id, scheme_uri, pref_label, alt_labels, definition), one row each."""
    return rows.select(concept_id(F.col("scheme_uri"), F.col("pref_label")).alias("concept_id"), "scheme_uri", "pref_label", F.coalesce("alt_labels", F.array().cast("array<string>")).alias("alt_labels"), "definition").dropDuplicates(["concept_id"])


def relations_of(rows: DataFrame) -> DataFrame:
    """(from_id, to_id, relation), each once; targets are named by label within the scheme."""
    own = concept_id(F.col("scheme_uri"), F.col("pref_label")).alias("from_id")
    out = None
    for column, relation in (("broader", BROADER), ("narrower", NARROWER), ("related", RELATED)):
        part = rows.select(own, "scheme_uri", F.explode(column).alias("label")).select("from_id", concept_id(F.col("scheme_uri"), F.col("label")).alias("to_id"), F.lit(relation).alias("relation"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def hierarchy(relations: DataFrame) -> DataFrame:
    """(ancestor, descendant) edges of broader and narrower relations."""
    up = relations.where(F.col("relation") == BROADER).select(F.col("to_id").alias("ancestor"), F.col("from_id").alias("descendant"))
    down = relations.where(F.col("relation") == NARROWER).select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("descendant"))
    return up.unionByName(down).distinct()
