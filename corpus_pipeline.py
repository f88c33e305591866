"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. Its
result is written as Parquet and read again before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, packing, quality, simhash, suffix_dedup
from pagewright.llm.common import cut, scratch, small, table

NO_ID = -(2**63)
#: A row of documents by its id and a hash of its text.
KEY = ["did", "tie"]


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, did, tie): the whole row as one column, so that its columns may have any names."""
    return docs.select(F.struct("*").alias("row"), _did(), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))


def _rows(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (left_semi) or aren't (left_anti) among (did, tie) of ``decided``."""
    keys = small(cut(decided.select(*KEY).distinct(), "decided"))
    return _keyed(docs).join(keys, KEY, how).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's posterior accept.

    Null texts are judged as empty ones, rows without a label like any other; repeated rows share a
    verdict. Columns beyond those of documents stay. An empty table gives no rows.
    """
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return _rows(docs, judged.where(~F.col("keep")).select(_did(), "tie"), "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    A null id counts as smaller than all others. Texts without words, null texts among them, are one
    group. Of rows that are equal in id and text one stays. An empty table gives no rows.
    """
    found = cut(simhash.near_copies(docs, shingle=5, similarity=0.8, distance=7), "groups")
    first = found.groupBy("group").agg(F.min(F.struct(_did(), F.col("tie"))).alias("first"), F.count("*").alias("n")).select("first.did", "first.tie", "n")
    first = cut(first, "first")
    kept = _keyed(docs).join(small(first), KEY)
    again = cut(found.groupBy(_did(), "tie").count().where("count > 1").select(*KEY), "again")
    if again.isEmpty():
        return kept.select("row.*")
    # Rows that are equal in id and text are one document; only these are brought together to be numbered.
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    once = kept.join(small(again), KEY, "left_semi").withColumn("number", number).where("number = 1").select("row")
    return kept.join(small(again), KEY, "left_anti").select("row").unionByName(once).select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that start earlier in the corpus.

    All documents stay, also those of which nothing is left; n_chars is that of what is left. A null
    text becomes an empty one. Repeated rows stay repeated. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffix_dedup.deduplicate(docs, length=100, carry=tuple(rest) or ("doc_id",))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")} | {c: F.col(f"carried.`{c}`") for c in rest}
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark or an edited copy of one.

    Null texts hold none and stay; an empty benchmark leaves all. An empty table gives no rows.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _rows(docs, found.select(_did(), "tie"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset; a null or empty text is one piece of one token."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, tokenizer_path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The alignment and the index are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents. What a stage writes for itself is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
