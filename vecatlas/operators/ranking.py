"""Positions, running totals and per-key ranks over a whole table without a one-task window.

The rows are range-partitioned and sorted, written once, and each partition's total (one row per
partition) is turned into an offset. A key that holds a third of the rows just spans partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.session import materialize, small_table

# monotonically_increasing_id keeps the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def _sorted_stage(df: DataFrame, order: list[str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_id", F.monotonically_increasing_id())
    stage = materialize(tagged, "ranked")
    return stage.withColumn("_part", F.shiftright("_id", _ROW_BITS))


def _with_offsets(stage: DataFrame, total: Column) -> tuple[DataFrame, int | float]:
    """Add ``_offset``, the total of all earlier partitions; the driver sees one row per partition."""
    spark = stage.sparkSession
    totals = stage.groupBy("_part").agg(total.alias("t")).collect()
    parts, offsets, running = [], [], 0
    for row in sorted(totals, key=lambda row: row["_part"]):
        parts.append(row["_part"])
        offsets.append(running)
        running += row["t"]
    # One row per partition of the stage, whatever the size of the data.
    table = F.broadcast(small_table(spark, {"_part": parts, "_offset": offsets}, "_part long, _offset long"))
    return stage.join(table, "_part"), running


def row_index(df: DataFrame, order: list[str], name: str = "row_index") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, 2, ... in the given total order; also returns the row count."""
    placed, count = _with_offsets(_sorted_stage(df, order), F.count(F.lit(1)))
    position = F.col("_offset") + F.col("_id").bitwiseAND(F.lit(_ROW_MASK))
    return placed.withColumn(name, position).drop("_part", "_offset", "_id"), int(count)


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the total of ``value`` (a whole number) over all earlier rows in the given order."""
    placed, _ = _with_offsets(_sorted_stage(df, order), F.coalesce(F.sum(value), F.lit(0)))
    earlier = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return placed.withColumn(name, F.col("_offset") + inside).drop("_part", "_offset", "_id")


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1 within each key, also for keys too large for one task.

    The lookup of each key's first position is an equi join with one row per key on the right;
    adaptive execution splits the left side of a hot key.
    """
    indexed, _ = row_index(df, [*keys, *order], "_pos")
    first = indexed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return (
        indexed.join(first, keys)
        .withColumn(name, F.col("_pos") - F.col("_first") + 1)
        .drop("_pos", "_first")
    )
