"""Shared helpers for vector columns: which rows count, rows of an Arrow column as a matrix, sums over tasks.

A vector takes part if it is not null, has entries, and each of them is neither null, NaN nor infinite. Vectors of
one table should have one length; where they do not, the most frequent one counts (of equally frequent ones the
longest), and vectors of other lengths take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import blob, unblob


def complete(vector: Column, below: float = math.inf) -> Column:
    """Whether all entries are there, and smaller than the bound on either side."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(below))), F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors; 0 without vectors."""
    most = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def summed(rows: DataFrame, shape: tuple[int, ...], dtype: type, partials: Callable) -> dict[int, np.ndarray]:
    """The sums, by key, of the arrays that ``partials(batches)`` yields as (key, array) in all tasks.

    They are added as a tree with two levels. Arrays have a fixed shape and keys are few, so what reaches a task or the
    driver depends on the number of tasks (its square root) and not on the rows.
    """
    size = math.prod(shape)

    def each(batches):
        part = TaskContext.get().partitionId()
        for key, made in partials(batches):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "key": pa.array([key], pa.int32()), "data": [blob(np.asarray(made, dtype))]})

    def merged(table: pa.Table) -> dict[int, np.ndarray]:
        totals = {}
        for key, data in zip(table.column("key").to_pylist(), table.column("data").to_pylist()):
            totals[key] = totals.get(key, 0) + (unblob(data, size, dtype) if data else np.zeros(size, dtype))
        return totals

    def merge(group, table):
        totals = merged(table)
        return pa.table({"key": pa.array(list(totals), pa.int32()), "data": pa.array([blob(t) for t in totals.values()], pa.binary())})

    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    made = rows.mapInArrow(each, "part long, key int, data binary")
    added = made.groupBy("key", F.pmod("part", F.lit(fan))).applyInArrow(merge, "key int, data binary").toArrow()
    return {key: total.reshape(shape) for key, total in merged(added).items()}
