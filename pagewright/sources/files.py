"""Documents as files in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError
from pagewright.functions import text as tx
from pagewright.operators import parse

SUFFIXES = ("txt", "md", "markdown", "pdf", "json")


def exists(spark: SparkSession, path: str) -> bool:
    return Store(spark).exists(path)


def files(spark: SparkSession, paths: list[str], *, max_files: int | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, content) of the files under directories, or of single files; with ``max_files`` the first of them by path.

    Spark's reader passes over files without bytes in directories; one that is named itself is read.
    """
    store = Store(spark)
    for path in paths:
        if not store.exists(path):
            raise EngineError("E_IO", f"no such file or directory: {path}")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if all(store.is_dir(p) for p in paths):
        read = read.option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}")
    rows = read.load(paths).select("path", "content")
    empty = [(p, bytearray()) for p in paths if store.is_empty_file(p)]
    if empty:
        rows = rows.unionByName(spark.createDataFrame(empty, "path string, content binary"))
    return rows.orderBy("path").limit(max_files) if max_files is not None else rows


def documents(found: DataFrame, parser: str = "auto") -> DataFrame:
    """Parsed files with their identity: doc_id, source_uri, source_hash, parser, and what the parser gives."""
    routed = found.withColumn("parser", parse.parser_of(F.col("path"), parser))
    known = routed.select("path", "parser", F.sha2("content", 256).alias("source_hash"), tx.content_id("doc", F.col("content")).alias("doc_id"), "content")
    return parse.parsed(known).drop("content").withColumnRenamed("path", "source_uri")


class Store:
    """Small files of the control plane, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def is_empty_file(self, path: str) -> bool:
        p, fs = self._path(path)
        status = fs.getFileStatus(p)
        return status.isFile() and status.getLen() == 0

    def make_dir(self, path: str) -> None:
        p, fs = self._path(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the path, then rename, so that readers see the old or the new text."""
        p, fs = self._path(path + ".new")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(p), context.makeQualified(self._path(path)[0]), options)

    def create_new(self, path: str, text: str) -> bool:
        """Create a file that isn't there yet; False if it is."""
        p, fs = self._path(path)
        try:
            stream = fs.create(p, False)
        except Exception:  # py4j wraps FileAlreadyExistsException
            if fs.exists(p):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def remove(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)
