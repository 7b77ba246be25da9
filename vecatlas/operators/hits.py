"""Search results: path lookup, existence filter, display columns, order and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions import display


# Hits up to this number are broadcast, so that the tables they look up are scanned without a shuffle.
MAX_BROADCAST_HITS = 200_000


def _side(hits: DataFrame, bound: int | None) -> DataFrame:
    return F.broadcast(hits) if bound is not None and bound <= MAX_BROADCAST_HITS else hits


def with_paths(hits: DataFrame, catalog: DataFrame, bound: int | None = None) -> DataFrame:
    """Look up each hit's path; ``bound`` is a proven limit on the number of hits."""
    return catalog.select("slot", "path").join(_side(hits, bound), "slot").select(
        "query_id", "rank", "slot", "path", "score"
    )


def existing_hits(hits: DataFrame, listing: DataFrame, bound: int | None = None) -> DataFrame:
    """Drop hits whose file is gone, after the top-k; listed paths are distinct."""
    return listing.select("path").join(_side(hits, bound), "path").select(*hits.columns)


def with_result_columns(hits: DataFrame, listing: DataFrame, bound: int | None = None) -> DataFrame:
    """Drop hits whose file is gone (so a query may show fewer than k rows) and add what is shown."""
    found = listing.select("path", "size", "modified").join(_side(hits, bound), "path")
    shown = found.select(
        *hits.columns,
        "size",
        "modified",
        display.size_text(F.col("size")).alias("size_text"),
        display.modified_text(F.col("modified")).alias("modified_text"),
        display.score_text(F.col("score")).alias("score_text"),
    )
    return with_row_ids(shown)


def with_row_ids(hits: DataFrame) -> DataFrame:
    """``row_id`` is unique in a result: each repetition of a path gets one more '#'."""
    again = Window.partitionBy("query_id", "_id").orderBy("rank")
    marks = F.repeat(F.lit("#"), F.row_number().over(again) - 1)
    return (
        hits.withColumn("_id", display.path_id(F.col("path")))
        .withColumn("row_id", F.concat("_id", marks))
        .drop("_id")
    )


def sorted_by(hits: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Add ``position`` within each query's result, which has at most k rows."""
    def direction(c: Column) -> Column:
        return c.desc() if descending else c.asc()

    # Equal sizes or scores keep the order of the result in both directions; other columns fall
    # back on the row id, which turns round with them.
    second = F.col("rank").asc() if column in ("size", "score") else direction(F.col("row_id"))
    order = Window.partitionBy("query_id").orderBy(direction(F.col(column)), second)
    return hits.withColumn("position", F.row_number().over(order))


def resized(hits: DataFrame, k: int) -> DataFrame:
    """A smaller result from a kept one, without searching again."""
    return hits.filter(F.col("rank") <= k)
