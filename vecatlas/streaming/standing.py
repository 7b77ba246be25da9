"""Standing queries: top-k results that are kept up to date by the changes of the vectors.

A change of slots (new vectors, replaced ones, deletes) touches a result in two ways. Changed vectors are scored against
all queries, which needs the changed vectors only. A query that loses hits, and whose list is not filled again by
changed vectors at least as near as its last hit was, searches anew; unless its list was short, since then it held all
vectors. So the unchanged vectors are read for those queries alone, and not at all where there are none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecatlas.functions import vectors as V
from vecatlas.operators.topk import rank_hits, topk_search
from vecatlas.session import materialize
from vecatlas.sources.commitlog import CommitLog, changed_slots
from vecatlas.sources.storage import Storage

_KEPT = ("query_id", "slot", "distance")


def refreshed(
    results: DataFrame, queries: DataFrame, changes: DataFrame, vectors: Callable[[], DataFrame], k: int = 10, metric: str = "cosine"
) -> DataFrame:
    """The results after ``changes(slot, embedding)``, where a null embedding is a delete: ``query_id, rank, slot, distance, score``.

    ``results`` are the exact results for ``queries(query_id, embedding)`` before, ``vectors()`` the vectors after the changes.
    """
    V.check_metric(metric)
    changes = materialize(changes.select(F.col("slot").cast("long").alias("slot"), "embedding"), "changes")
    last = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("had"), F.max(F.struct("distance", "slot")).alias("last"))
    kept = results.select(*_KEPT).join(changes.select("slot"), "slot", "left_anti").select(*_KEPT)
    near = topk_search(changes, queries, k, metric).select(*_KEPT)
    merged = materialize(rank_hits(kept.unionByName(near), k, metric), "merged")
    # What a full list did not hold lies behind its last hit: up to there the merged list is sure to be complete.
    before = F.struct(F.col("distance"), F.col("slot")) <= F.col("last")
    sure = merged.join(last, "query_id").groupBy("query_id").agg(F.count(F.when(before, 1)).alias("sure"))
    open_ = last.filter(F.col("had") >= k).join(sure, "query_id", "left").filter(F.coalesce("sure", F.lit(0)) < k).select("query_id")
    open_ = materialize(queries.join(open_, "query_id", "left_semi").select("query_id", "embedding"), "open")
    if open_.isEmpty():
        return merged
    again = topk_search(vectors(), open_, k, metric)
    return merged.join(open_.select("query_id"), "query_id", "left_anti").select(*again.columns).unionByName(again)


class StandingQueries:
    """The kept results of ``queries(query_id, embedding)`` over a log's vectors, a folder per refresh.

    A refresh is named by the last commit it has seen; a replayed one finds its folder and reads what was before it.
    """

    def __init__(self, log: CommitLog, queries: DataFrame, path: str, k: int = 10, metric: str = "cosine") -> None:
        self.log, self.queries, self.path, self.k, self.metric = log, queries, path.rstrip("/"), k, metric
        self._storage = Storage(log.spark)

    def _seen(self) -> list[int]:
        names = (int(name.removeprefix("seen=")) for name in self._storage.names(self.path))
        return sorted(n for n in names if self._storage.exists(f"{self.path}/seen={n}/_SUCCESS"))

    def results(self) -> DataFrame:
        return self.log.spark.read.parquet(f"{self.path}/seen={self._seen()[-1]}")

    def refresh(self) -> DataFrame:
        """Bring the results up to the log's last commit."""
        through = self.log.last()
        seen = [n for n in self._seen() if n < through]
        if not seen or not self.log.holds(seen[-1]):
            made = topk_search(self.log.vectors(), self.queries, self.k, self.metric)
        else:
            before = self.log.spark.read.parquet(f"{self.path}/seen={seen[-1]}")
            made = refreshed(before, self.queries, changed_slots(self.log, seen[-1]), self.log.vectors, self.k, self.metric)
        made.write.mode("overwrite").parquet(f"{self.path}/seen={through}")
        for old in seen[:-1]:
            self._storage.delete(f"{self.path}/seen={old}")
        return self.results()


def start_standing(
    standing: StandingQueries, feed: DataFrame, checkpoint: str, apply: Callable[[DataFrame, str], None], available_now: bool = True
) -> StreamingQuery:
    """Commit each batch of a change feed with ``apply(batch, commit_id)`` and refresh the results."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        apply(batch, f"stream-{batch_id}")
        standing.refresh()

    writer = feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return writer.trigger(**trigger).start()
