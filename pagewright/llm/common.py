"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text that go to a Python worker at once.
BATCH_BYTES = "4m"
BATCH_ROWS = "4000"
#: Rows of a written table up to which it is broadcast.
SMALL = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables that cut() wrote, while a scratch() is open.
_written: list[str] | None = None


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that very long rows don't pile up in a worker, and let workers find this package."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, environment.get("PYTHONPATH", ""))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a new local one, if all executors are this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends there: a lost executor costs a read of the files, not a new run of what came
    before. So nothing needs the shuffle files behind it any more, and Spark is told to remove them
    as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _written is not None:
        _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has no more than ``limit`` of them."""
    return F.broadcast(df) if df.count() <= limit else df


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() returned and that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes, at its end, the tables that cut() wrote inside it, but for those appended to what it yields."""
    global _written
    before, _written, kept = _written, [], []
    try:
        yield kept
    finally:
        paths, _written = _written, before
        for path in paths:
            if any(path == x.cut_path for x in kept):
                if _written is not None:
                    _written.append(path)
            else:
                _remove(spark, path)


_kept: dict = {}
_asked = False


def kept(key, make: Callable):
    """What ``make`` returns, kept over a worker's tasks until one starts that doesn't ask for it."""
    global _asked
    _asked = True
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def keep(key) -> None:
    """Lets tasks that don't use what is kept under ``key`` leave it to later tasks of their operator."""
    global _asked
    _asked = key in _kept


def started(make: Callable):
    """What ``make`` returns; frees what earlier tasks kept, unless ``make`` asks for it."""
    global _asked
    _asked = False
    out = make()
    if not _asked:
        _kept.clear()
    return out


def released() -> None:
    """Gives freed memory back to the system, so that one task's peak isn't the next one's base in the same worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns.

    ``make`` runs once per task and returns a function from batches to dicts whose keys are
    the columns of ``schema``.
    """
    fields = T._parse_datatype_string(schema)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagewright.llm import common  # the worker's own, not a copy sent along

        for columns in common.started(make)(batches):
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type, from_pandas=False) for f in target for x in (columns[f.name],)]
            arrays = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(f.type) for x, f in zip(arrays, target, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)
        common.released()

    return df.mapInArrow(run, fields)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Columns (doc_id, tie, text) of any table and those of ``more``; others are left out, so that no name can clash.

    ``tie`` is a hash of the text that tells rows of one id apart.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"), *(c.alias(n) for n, c in more.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
