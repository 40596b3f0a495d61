"""Sums of equally long arrays that tasks make, one each, over any number of tasks.

Every task cuts its array into slices, and the slices are dealt by their number:
whoever adds up a slice gets one short row from each task and keeps one, so the
adders' work is spread as widely as the array is long, and the driver gets each
slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import width

SLICE = 1 << 13


def slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The array as rows (part, total)."""
    for k in range(0, len(total), SLICE):
        own = total[k : k + SLICE]
        yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([own], pa.list_(pa.from_numpy_dtype(own.dtype)))], ["part", "total"])


def schema(kind: str) -> str:
    return f"part int, total array<{kind}>"


def _add(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, total in zip(batch.column("part").to_pylist(), batch.column("total"), strict=True):
                own = total.values.to_numpy()
                if part in sums:
                    sums[part] += own
                else:
                    sums[part] = own.astype(kind)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.list_(pa.from_numpy_dtype(kind)))], ["part", "total"])

    return run


def summed(rows: DataFrame, length: int, kind: type, name: str) -> np.ndarray | None:
    """Sum of the arrays of ``length`` numbers whose slices ``rows`` holds; null without any."""
    n = min(width(rows.sparkSession), -(-length // SLICE))
    found = rows.repartition(n, "part").mapInArrow(_add(kind), schema(name)).toPandas().sort_values("part")
    return np.concatenate([np.asarray(x, kind) for x in found["total"]]) if len(found) else None
