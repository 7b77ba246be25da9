"""Sums of arrays over all tasks, as a tree with two levels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def summed(rows: DataFrame, shape: tuple[int, ...], dtype: type, partials: Callable) -> dict[int, np.ndarray]:
    """The sums, by key, of the arrays that ``partials(batches)`` yields as (key, array) in all tasks.

    Arrays have a fixed shape and keys are few, so what reaches a task or the driver depends on the number of tasks (its
    square root) and not on the rows.
    """
    size = math.prod(shape)

    def each(batches):
        part = TaskContext.get().partitionId()
        for key, made in partials(batches):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "key": pa.array([key], pa.int32()), "data": [_packed(np.asarray(made, dtype))]})

    def merged(table: pa.Table) -> dict[int, np.ndarray]:
        totals = {}
        for key, data in zip(table.column("key").to_pylist(), table.column("data").to_pylist()):
            raw = pa.decompress(data, decompressed_size=size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True)
            totals[key] = totals.get(key, 0) + np.frombuffer(raw, dtype)
        return totals

    def merge(group, table):
        totals = merged(table)
        return pa.table({"key": pa.array(list(totals), pa.int32()), "data": pa.array([_packed(t) for t in totals.values()], pa.binary())})

    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    made = rows.mapInArrow(each, "part long, key int, data binary")
    added = made.groupBy("key", F.pmod("part", F.lit(fan))).applyInArrow(merge, "key int, data binary").toArrow()
    return {key: total.reshape(shape) for key, total in merged(added).items()}
