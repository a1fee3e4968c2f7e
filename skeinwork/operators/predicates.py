"""Opaque predicates: the way out for conditions that no Column can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def keep(df: DataFrame, predicate: Callable[[dict], bool]) -> DataFrame:
    """The rows for which a Python function of the row (a dict) holds, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(predicate(row)) for row in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def join_where(left: DataFrame, right: DataFrame, on: list[str], predicate: Callable[[dict], bool]) -> DataFrame:
    """Pairs that agree on some columns and for which a Python function of the joined row holds; the columns keep the pairs few."""
    return keep(left.join(right, on), predicate)
