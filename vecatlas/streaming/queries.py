"""A stream of queries against the current vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecatlas.plans.search import search


def start_search(
    queries: DataFrame, vectors: Callable[[], DataFrame], out: str, checkpoint: str, k: int = 10,
    metric: str = "cosine", available_now: bool = True,
) -> StreamingQuery:
    """Answer each batch of ``queries(query_id, embedding)`` below ``out/batch=<id>``.

    ``vectors`` is called per batch and so sees the latest commit; a replayed batch overwrites its
    own folder.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        hits = search(vectors(), batch, k, metric)
        hits.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()
