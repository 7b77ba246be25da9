"""Continuous ingest: a change feed of ``path, size, op, seq`` becomes commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecatlas.operators.catalog import allocate
from vecatlas.operators.encode import split_errors
from vecatlas.operators.ranking import row_index
from vecatlas.plans.sync import Encode, unfilled_slots
from vecatlas.session import materialize
from vecatlas.sources.commitlog import CommitLog, deletes, failed, pads, puts, told


def apply_changes(
    log: CommitLog, changes: DataFrame, commit_id: str, encode_work: Encode | None = None
) -> None:
    """Commit one batch; the last change of each path wins, also over changes of earlier batches.

    Changes that could not be encoded before are tried again with every batch, until they succeed or a newer change of
    the path replaces them; until then the path keeps its old state. The batch reads what the log knows of its own
    paths, and free slots as intervals, but not the catalog. The log is read as it was before this commit, so applying a
    batch again writes the same rows.
    """
    place = log.ordinal(commit_id)
    given = changes.select("path", "op", "size", F.col("seq").alias("source_seq"))
    if encode_work is not None:
        again = log.errors(place).filter("source_seq is not null")
        given = given.unionByName(again.select("path", F.lit("put").alias("op"), "size", "source_seq"))
    last = given.groupBy("path").agg(F.max_by(F.struct("op", "size", "source_seq"), "source_seq").alias("c"))
    batch = last.select("path", "c.*").persist()
    known = log.paths(place, batch).select("path", "slot", "told")
    newer = F.col("told").isNull() | (F.col("source_seq") > F.col("told"))
    placed = batch.join(known, "path", "left").filter(newer).drop("told").persist()
    gone = placed.filter("op = 'delete' and slot is not null")
    wanted = placed.filter("op = 'put'").drop("op")
    files, count = row_index(wanted.filter("slot is null").drop("slot"), ["path"], "_at")
    free, end = log.free(place, count, gone)
    work = wanted.filter("slot is not null").unionByName(allocate(files, count, free, end))
    rows = deletes(gone).unionByName(told(placed.filter("op = 'delete' and slot is null")))
    if encode_work is None:
        rows = rows.unionByName(puts(work))
    else:
        encoded = encode_work(work.select("slot", "path", "size")).join(work.select("path", "source_seq"), "path")
        done, errors = split_errors(materialize(encoded, "encoded"))
        rows = rows.unionByName(puts(done)).unionByName(failed(errors)).unionByName(pads(unfilled_slots(end, done, errors)))
    log.append(rows, commit_id)
    for kept in (placed, batch):
        kept.unpersist()


def start_ingest(
    log: CommitLog, feed: DataFrame, checkpoint: str, encode_work: Encode | None = None,
    available_now: bool = True, compact_every: int | None = 20,
) -> StreamingQuery:
    """Changes may arrive in any order: of each path the one with the highest ``seq`` decides.

    ``compact_every`` folds the log into a new base after so many batches (None: never).
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        apply_changes(log, batch, f"stream-{batch_id}", encode_work)
        if compact_every and (batch_id + 1) % compact_every == 0:
            log.compact()

    writer = feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return writer.trigger(**trigger).start()
