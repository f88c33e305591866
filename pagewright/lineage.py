"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one, if all executors are this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def written_once(spark: SparkSession) -> Iterator[None]:
    """What is written inside needs the shuffle files behind it no more: Spark removes them as soon as a table is written."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def fetched(df: DataFrame) -> list[Row]:
    """The rows of a small result; the shuffle files behind it go at once."""
    with written_once(df.sparkSession):
        return df.select("*").collect()  # whether shuffle files are removed is settled when a DataFrame is made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, so that a lost executor costs only that read."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with written_once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def parts(table: DataFrame, n: int) -> Iterator[DataFrame]:
    """A table that cut() returned in up to ``n`` parts of whole files, of about the same size each; drop() removes a part's files."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    found = sorted((str(f.getPath()), f.getLen()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.getPath().getName().startswith("part-"))
    total, upto, own = max(1, sum(size for _, size in found)), 0, []
    for k, (path, size) in enumerate(found):
        own.append(path)
        before, upto = upto, upto + size
        if k == len(found) - 1 or upto * n // total > before * n // total:
            part = spark.read.schema(table.schema).parquet(*own)
            part.cut_path, own = own, []
            yield part


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() returned, or parts() of them, that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in [table.cut_path] if isinstance(table.cut_path, str) else table.cut_path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
