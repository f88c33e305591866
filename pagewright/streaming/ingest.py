"""Continuous ingestion of files that arrive in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagewright.lineage import cut
from pagewright.plans.engine import Engine
from pagewright.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, directory: str, checkpoint: str, *, parser: str = "auto", suffixes: tuple[str, ...] = files.SUFFIXES, once: bool = False) -> StreamingQuery:
    """Ingest every file that appears under ``directory``.

    Each micro-batch is the batch ingest; contents have identities, so a batch that is run again
    after a failure changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        engine.take(cut(files.documents(batch.select("path", "content"), parser)))

    read = engine.spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}")
    write = read.load(directory).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write).start()
