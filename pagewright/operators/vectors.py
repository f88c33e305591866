"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.arrow import arrow_map
from pagewright.errors import EngineError, invalid
from pagewright.functions import vectors as vx
from pagewright.operators import fulltext

#: Queries in a block; a block of vectors has four times as many.
BLOCK = 512


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "segment_id", vector: str = "embedding") -> DataFrame:
    """(key, vector_score, vector_rank) of the ``k`` vectors of the query's dimension nearest to it."""
    q = F.array(*(F.lit(float(x)) for x in query))
    own = vectors.where(F.size(vector) == len(query))
    scored = own.select(key, vx.cosine(F.col(vector), q).alias("vector_score"))
    return fulltext.top_one(scored, k, "vector_score", key, "vector_rank")


def _packed(rows: DataFrame, key: str, vector: str, prefix: str, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows as columns <prefix>_ids and <prefix>_vectors, one row each, packed within partitions."""
    kind = rows.schema[key].dataType.simpleString()

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            ids: list = []
            values: list = []
            for b in batches:
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if v:
                        ids.append(i)
                        values.append(np.asarray(v, np.float64).tobytes())
                    if len(ids) == size:
                        yield {f"{prefix}_ids": [ids], f"{prefix}_vectors": [values]}
                        ids, values = [], []
            if ids:
                yield {f"{prefix}_ids": [ids], f"{prefix}_vectors": [values]}

        return run

    return arrow_map(rows.select(key, vector), make, f"{prefix}_ids array<{kind}>, {prefix}_vectors array<binary>")


def by_dimension(values: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices, matrix and lengths of the vectors of each dimension."""
    sizes = np.array([len(v) // 8 for v in values])
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        m = np.frombuffer(b"".join(values[i] for i in at), np.float64).reshape(len(at), d)
        out[d] = at, m, np.sqrt((m * m).sum(1))
    return out


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "segment_id", query_key: str = "query_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, key, vector_score, vector_rank): the ``k`` nearest vectors of every query.

    Queries and vectors are packed into blocks on the executors, and every block of queries meets
    every block of vectors in a matrix product, of which the best ``k`` for each query are kept, so
    that k rows per query and block of vectors are ranked. Nothing goes through the driver.
    """
    own = _packed(vectors, key, vector, "own", 4 * block)
    asked = _packed(queries, query_key, vector, "asked", block)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for ids, values, asking, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out: tuple[list, list, list] = [], [], []
                    there = by_dimension(values)
                    for d, (rows, m, norms) in by_dimension(wanted).items():
                        if d not in there:
                            continue
                        at, x, lengths = there[d]
                        scale = norms[:, None] * lengths
                        score = np.divide(m @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0)
                        for i, s in zip(rows.tolist(), score, strict=True):
                            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else s.min()
                            near = np.flatnonzero(s >= least)
                            best = sorted((-float(s[j]), ids[at[j]]) for j in near)[:k]
                            out[0].extend([asking[i]] * len(best))
                            out[1].extend(x for _, x in best)
                            out[2].extend(-x for x, _ in best)
                    yield {query_key: out[0], key: out[1], "vector_score": out[2]}

        return run

    kinds = (f.dataType.simpleString() for f in (queries.schema[query_key], vectors.schema[key]))
    met = own.crossJoin(asked).select("own_ids", "own_vectors", "asked_ids", "asked_vectors")
    found = arrow_map(met, make, "{} {}, {} {}, vector_score double".format(query_key, next(kinds), key, next(kinds)))
    return fulltext.top(found, k, "vector_score", key, "vector_rank", query_key)


def checked(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """The vectors, or E_INVALID_INPUT if one has other dimensions."""
    if not vectors.where(F.size(vector) != dims).isEmpty():
        raise invalid(f"a vector doesn't have {dims} dimensions")
    return vectors


def checksum(vectors: DataFrame, key: str = "segment_id", vector: str = "embedding") -> str:
    """A digest of all rows that doesn't depend on their order."""
    r = vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, vector).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def read_jsonl(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(segment_id, doc_id, embedding) of line-wise JSON; malformed lines and other dimensions are left out."""
    rows = spark.read.schema("segment_id string, doc_id string, embedding array<float>").option("mode", "DROPMALFORMED").json(path)
    return rows.where((F.size("embedding") == dims) & F.col("segment_id").isNotNull())


class VectorIndex:
    """Vectors by segment: what was upserted last counts, until it is deleted. A value: every change gives a new index."""

    def __init__(self, rows: DataFrame, dimensions: int):
        self.rows, self.dims = rows, dimensions

    @classmethod
    def empty(cls, spark: SparkSession, dimensions: int) -> VectorIndex:
        return cls(spark.createDataFrame([], "segment_id string, doc_id string, embedding array<float>"), dimensions)

    def upsert(self, rows: DataFrame) -> VectorIndex:
        """Add rows (segment_id, doc_id, embedding) or put them in place of what their segments have."""
        new = checked(rows, self.dims).select("segment_id", "doc_id", "embedding")
        return VectorIndex(self.rows.join(new.select("segment_id"), "segment_id", "left_anti").select(new.columns).unionByName(new), self.dims)

    def delete(self, segments: DataFrame) -> VectorIndex:
        return VectorIndex(self.rows.join(segments.select("segment_id"), "segment_id", "left_anti").select(self.rows.columns), self.dims)

    def delete_by_doc(self, docs: DataFrame) -> VectorIndex:
        return VectorIndex(self.rows.join(docs.select("doc_id"), "doc_id", "left_anti").select(self.rows.columns), self.dims)

    def search(self, query: list[float], k: int) -> DataFrame:
        if len(query) != self.dims:
            raise invalid(f"the query doesn't have {self.dims} dimensions")
        return nearest(self.rows, query, k)

    def count(self) -> int:
        return self.rows.count()

    def dimensions(self) -> int:
        return self.dims

    def flush(self, path: str) -> str:
        """Write the vectors, and return the checksum that open() asks for."""
        self.rows.write.mode("overwrite").parquet(path)
        return checksum(self.rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimensions: int, expected: str) -> VectorIndex:
        rows = spark.read.parquet(path)
        if checksum(rows) != expected:
            raise EngineError("E_STORE_CORRUPT", f"the vectors under {path} differ from their checksum")
        return cls(rows, dimensions)
