"""Times the headline queries at $BENCH_SF_DIR and prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pagewright.engine_queries import _texts  # noqa: E402
from pagewright.operators import fulltext, fusion, parse, query, vectors  # noqa: E402
from pagewright.plans import ports  # noqa: E402
from pagewright.plans.engine import Engine  # noqa: E402
from pagewright.queries import TOP, WORDS, geography_closure, table  # noqa: E402
from pagewright.sources import files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    shared = tempfile.mkdtemp(prefix="pagewright-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    index = f"file://{shared}/index"

    def build(index: str = f"file://{shared}/timed") -> None:
        fulltext.postings(docs, "doc_id", "text").select("term", F.col("doc_id").alias("segment_id"), "tf", "positions").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{index}/postings")
        fulltext.lengths(docs, "doc_id", "text").select(F.col("doc_id").alias("segment_id"), "doc_len").write.mode("overwrite").parquet(f"{index}/lengths")

    build(index)
    postings, lens = (spark.read.parquet(f"{index}/{n}") for n in ("postings", "lengths"))
    stats = fulltext.corpus_stats(lens).cache()
    n, avg = stats.first()
    opened = query.Index(postings, lens, (n, avg), lens.select("segment_id"))
    embeddings = table(spark, SF_DIR, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding")
    vector = [float(x) for x in embeddings.first()["embedding"]]
    many = table(spark, SF_DIR, "benchmark").where("item_id < 100")

    # The engine itself: every line of every document is a segment.
    engine = Engine(spark, f"{index}/kb", embedder=ports.hashed(64))
    engine.init()
    engine.take(files.documents(_texts(spark, SF_DIR)))
    engine.reindex()
    engine.reindex_vector()

    queries = {
        "segments_build": lambda: run(parse.paragraphs(docs, ["doc_id"], F.col("text"), "\n")),
        "index_build": build,
        "bm25_top10": lambda: query.search(spark, opened, WORDS, 10).collect(),
        "bm25_batch100": lambda: run(fulltext.top(fulltext.bm25(postings, lens, stats, fulltext.query_terms(many, "item_id", "text")), 10, "bm25_score")),
        "knn_top10": lambda: vectors.nearest(embeddings, vector, 10).collect(),
        "knn_batch": lambda: run(vectors.nearest_of_all(embeddings, embeddings.where("segment_id % 20 = 0").withColumnRenamed("segment_id", "query_id"), 10)),
        "hybrid_top": lambda: fusion.fuse(query.search(spark, opened, WORDS, TOP), vectors.nearest(embeddings, vector, TOP), limit=TOP).collect(),
        "search_words": lambda: engine.search(WORDS, "bm25"),
        "search_hybrid_context": lambda: engine.search(WORDS, "hybrid", expand=True),
        "full_reindex": engine.reindex,
        "closure_rebuild": lambda: geography_closure(spark, SF_DIR).count(),
    }
    took = {}
    for name, job in queries.items():
        seconds = []
        for _ in range(ROUNDS + 1):
            began = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - began)
        took[name] = round(median(seconds[1:]), 3)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
