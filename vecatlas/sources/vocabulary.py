"""Vocabulary files: one token per line, line number = id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions.text import strip
from vecatlas.operators.ranking import row_index


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, id``; blank lines count, and a repeated token keeps its last line number."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered, _ = row_index(lines, ["file", "block", "line"], "id")
    return vocabulary_of(numbered.select(strip(F.col("value")).alias("token"), "id"))


def vocabulary_of(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("token").agg(F.max("id").alias("id"))


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count_distinct("token").alias("vocab_size"))
