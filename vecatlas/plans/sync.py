"""Bring the catalog and its vectors in line with a file listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.catalog import (
    assign_slots,
    diff,
    missing_files,
    remove_directories,
    slot_count,
    tombstone,
)
from vecatlas.operators.encode import EncoderFactory, encode, split_errors
from vecatlas.operators.images import CLIP_MEAN, CLIP_STD, image_tensors
from vecatlas.operators.paths import under_roots, unregister_roots
from vecatlas.session import materialize, small_table
from vecatlas.sources.commitlog import CommitLog, deletes, failed, pads, puts
from vecatlas.sources.files import list_files, read_images

# Work rows ``slot, path, size`` -> the same rows with ``embedding``.
Encode = Callable[[DataFrame], DataFrame]


@dataclass
class SyncResult:
    gone: DataFrame
    work: DataFrame
    errors: DataFrame | None


def sync(
    log: CommitLog, listing: DataFrame, roots: DataFrame, commit_id: str, encode_work: Encode | None = None
) -> SyncResult:
    """Tombstone what is gone, then encode and upsert what is new or changed, as one commit.

    Only files below ``roots(root)`` can be found missing. The listing is complete before anything is
    written, so a failed scan deletes nothing. Without ``encode_work`` only the catalog is kept.
    """
    listed = materialize(listing.groupBy("path").agg(F.max("size").alias("size")), "listing")
    state = log.catalog(log.ordinal(commit_id))
    changes = materialize(diff(state, listed), "diff")
    gone = under_roots(changes.filter("status = 'missing'"), roots).select("slot", "path", "size")
    changed = changes.filter("status = 'changed'").select("slot", "path", "size")
    new = changes.filter("status = 'new'").select("path", "size")
    work = changed.unionByName(assign_slots(new, tombstone(state, gone)).select("slot", "path", "size"))
    if encode_work is None:
        log.append(deletes(gone).unionByName(puts(work)), commit_id)
        return SyncResult(gone, work, None)
    encoded = materialize(encode_work(work), "encoded")
    done, errors = split_errors(encoded)
    rows = deletes(gone).unionByName(puts(done)).unionByName(failed(errors))
    log.append(rows.unionByName(pads(unfilled_slots(slot_count(state), done, errors))), commit_id)
    return SyncResult(gone, work, errors)


def unfilled_slots(end: int, done: DataFrame, errors: DataFrame) -> DataFrame:
    """New slots, from ``end`` on, that stay empty below the last one filled: later syncs take them like tombstones."""
    return errors.filter((F.col("slot") >= end) & (F.col("slot") < slot_count(done)))


def image_encoder(
    spark: SparkSession, roots: list[str], factory: EncoderFactory, size: int = 224,
    mean: tuple[float, ...] = CLIP_MEAN, std: tuple[float, ...] = CLIP_STD, normalization: bool = True,
) -> Encode:
    """Encode work rows from the image files themselves."""

    def run(work: DataFrame) -> DataFrame:
        # Only vectors meet the work list: pixels and tensors never leave the task that read them.
        images = read_images(spark, roots, drop_invalid=False, only=work)
        tensors = image_tensors(images, size, mean, std)
        embedded = encode(tensors, "tensor", (3, size, size), "float32", factory, normalization)
        return work.join(embedded.select("path", "embedding"), "path", "left")

    return run


def sync_files(
    log: CommitLog, roots: list[str], factory: EncoderFactory, commit_id: str, size: int = 224,
    normalization: bool = True, mean: tuple[float, ...] = CLIP_MEAN, std: tuple[float, ...] = CLIP_STD,
) -> SyncResult:
    """Sync with the image files below ``roots``; ``mean`` and ``std`` are those of the model."""
    spark = log.spark
    root_rows = small_table(spark, {"root": roots}, "root string")
    run = image_encoder(spark, roots, factory, size, mean, std, normalization)
    return sync(log, list_files(spark, roots), root_rows, commit_id, run)


def rebuild(
    log: CommitLog, listing: DataFrame, roots: DataFrame, commit_id: str, encode_work: Encode | None = None
) -> SyncResult:
    """Sync from nothing; replaying the commit gives the same catalog."""
    log.reset(commit_id)
    return sync(log, listing, roots, commit_id, encode_work)


def unregister(
    log: CommitLog, registered: DataFrame, removed: DataFrame, listing: DataFrame, commit_id: str
) -> DataFrame:
    """Drop roots, tombstone everything below them and everything that is gone; returns the roots left.

    A file that another registered root still covers returns at the next sync.
    """
    state = log.catalog(log.ordinal(commit_id))
    left = unregister_roots(registered, removed)
    dropped = remove_directories(state, removed)
    gone = missing_files(state, listing, left).join(dropped.select("slot"), "slot", "left_anti")
    log.append(deletes(dropped.unionByName(gone)), commit_id)
    return left
