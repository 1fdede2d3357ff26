"""Sums over all rows that every task makes from whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about ``CHUNK_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def dense_sums(rows: DataFrame, width: int, fill: Callable[[pa.Table, np.ndarray], None]) -> np.ndarray:
    """The sum of the ``width`` numbers that ``fill(table, out)`` adds to ``out`` for each part of the rows.

    A task keeps one array and passes on what is not zero; a keyed aggregation merges the tasks, so no task receives more than its share of keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for table in chunks(batches):
            fill(table, out)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], names=["at", "value"])

    merged = rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[merged.column("at").to_numpy()] = merged.column("value").to_numpy()
    return out
