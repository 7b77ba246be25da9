"""Searches from queries to displayed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.encode import EncoderFactory, encode, encode_queries
from vecatlas.operators.hits import existing_hits, with_paths, with_result_columns
from vecatlas.operators.images import CLIP_MEAN, CLIP_STD, image_tensors
from vecatlas.operators.topk import rank_hits, topk_windows, topk_with_bound
from vecatlas.sources.commitlog import CommitLog
from vecatlas.sources.files import read_images


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
    listing: DataFrame | None = None, display: bool = False, catalog: DataFrame | None = None,
) -> DataFrame:
    """Top-k hits with their paths: ``query_id, rank, slot, path, score``.

    Paths are looked up in ``catalog(slot, path)`` if it is given (``CommitLog.catalog``, which reads no embedding).
    With a ``listing``, hits whose file is gone are dropped after the top-k, so a query may get fewer;
    ``display`` adds the formatted result columns.
    """
    hits, bound = topk_with_bound(vectors, queries, k, metric)
    hits = with_paths(hits, vectors if catalog is None else catalog, bound)
    if listing is None:
        return hits
    return with_result_columns(hits, listing, bound) if display else existing_hits(hits, listing, bound)


def text_search(
    vectors: DataFrame, queries: DataFrame, vocabulary: DataFrame, factory: EncoderFactory, k: int = 10,
    metric: str = "cosine", context_length: int = 52, legacy: bool = False,
) -> DataFrame:
    """Search by ``queries(query_id, text)``."""
    encoded = encode_queries(queries, vocabulary, factory, context_length, legacy)
    return search(vectors, encoded, k, metric)


def window_search(
    windows: DataFrame, queries: DataFrame, vocabulary: DataFrame, factory: EncoderFactory, k: int = 10,
    metric: str = "cosine", context_length: int = 52, legacy: bool = False,
) -> DataFrame:
    """Search texts by windows on both sides: the distance of a query and a text is that of their nearest windows.

    ``windows`` has ``slot, path, embedding`` with a row per window of a text; long queries are cut into windows too, so
    that all of a query counts. A text among a query's k nearest is among the k nearest of one of its windows.
    """
    encoded = encode_queries(queries, vocabulary, factory, context_length, legacy, windows=True)
    parts = encoded.select(F.struct("query_id", "window").alias("query_id"), "embedding")
    hits = topk_windows(windows, parts, k, metric)
    whole = hits.groupBy(F.col("query_id.query_id").alias("query_id"), "slot").agg(F.min("distance").alias("distance"))
    return with_paths(rank_hits(whole, k, metric), windows.select("slot", "path").distinct())


def example_search(
    spark: SparkSession, vectors: DataFrame, folders: list[str], factory: EncoderFactory, k: int = 10,
    metric: str = "cosine", size: int = 224, mean: tuple[float, ...] = CLIP_MEAN,
    std: tuple[float, ...] = CLIP_STD, normalization: bool = True,
) -> DataFrame:
    """Search by the images below ``folders``; the path of the example is the query id."""
    images = read_images(spark, folders).withColumnRenamed("path", "query_id")
    tensors = image_tensors(images, size, mean, std)
    queries = encode(tensors, "tensor", (3, size, size), "float32", factory, normalization)
    return search(vectors, queries.select("query_id", "embedding"), k, metric)


def log_search(log: CommitLog, queries: DataFrame, k: int = 10, metric: str = "cosine", listing: DataFrame | None = None, display: bool = False) -> DataFrame:
    """Search what a commit log holds now."""
    return search(log.vectors(), queries, k, metric, listing, display, log.catalog())


def neighbours(vectors: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Search by every catalogued item at once."""
    queries = vectors.select(F.col("slot").alias("query_id"), "embedding")
    return search(vectors, queries, k, metric)
