"""Arrow functions over partitions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` with functions that yield dicts of columns; ``make`` runs once per task."""
    environment = df.sparkSession.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, environment.get("PYTHONPATH", ""))))
    fields = T._parse_datatype_string(schema)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make()(batches):
            arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in target]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, target, strict=True)], schema=target)

    return df.mapInArrow(run, fields)
