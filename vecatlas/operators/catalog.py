"""Catalog maintenance: diff a snapshot with a listing, allocate slots, tombstone.

A catalog has ``slot, path, size, live`` (a tombstone has no path), a listing has ``path, size``.
Only the file size tells whether a file changed: an edit of the same size is not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.operators.paths import under_roots
from vecatlas.operators.ranking import row_index


def live_rows(catalog: DataFrame) -> DataFrame:
    return catalog.filter("live")


def changed_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    now = listing.select("path", F.col("size").alias("_now"))
    return (
        live_rows(catalog).join(now, "path").filter("size <> _now")
        .select("slot", "path", F.col("_now").alias("size"))
    )


def new_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    return listing.select("path", "size").join(live_rows(catalog).select("path"), "path", "left_anti")


def missing_files(
    catalog: DataFrame, listing: DataFrame, scanned: DataFrame | None = None
) -> DataFrame:
    """Live rows without a listed file; with ``scanned(root)``, only rows the listing could show."""
    live = live_rows(catalog).select("slot", "path", "size")
    if scanned is not None:
        live = under_roots(live, scanned)
    return live.join(listing.select("path"), "path", "left_anti")


def existing_only(df: DataFrame, listing: DataFrame) -> DataFrame:
    return df.join(listing.select("path"), "path", "left_semi")


def diff(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """All three comparisons in one join: ``slot, path, size, status`` of the rows that differ."""
    old = live_rows(catalog).select("slot", "path", F.col("size").alias("_old"))
    both = old.join(listing.select("path", F.col("size").alias("_now")), "path", "full_outer")
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_now").isNull(), "missing")
        .when(F.col("_old") != F.col("_now"), "changed")
    )
    return both.select(
        "slot", "path", F.coalesce("_now", "_old").alias("size"), status.alias("status")
    ).filter("status is not null")


def tombstone(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """Free the slots in ``gone(slot)``; the last known size stays."""
    marked = catalog.join(gone.select("slot").withColumn("_gone", F.lit(True)), "slot", "left")
    live = F.col("live") & F.col("_gone").isNull()
    return marked.select("slot", F.when(live, F.col("path")).alias("path"), "size", live.alias("live"))


def remove_directories(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """The live rows under ``roots(root)``."""
    return under_roots(live_rows(catalog).select("slot", "path", "size"), roots)


def slot_count(catalog: DataFrame) -> int:
    """The length of the slot sequence."""
    return catalog.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]


def assign_slots(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """Give each new file a slot.

    Files are listed by path. Free slots are taken in ascending order by files popped from the end
    of the list; the files left over follow after the last slot, in list order.
    """
    files, count = row_index(new, ["path"], "_at")
    return allocate(files, count, catalog.filter("not live").select("slot"), slot_count(catalog))


def allocate(files: DataFrame, count: int, free: DataFrame | None, end: int) -> DataFrame:
    """Slots for ``count`` files, numbered by ``_at``, out of the lowest ``free(slot)`` and from ``end`` on."""
    columns = [c for c in files.columns if c != "_at"]
    fresh = F.lit(end) + F.col("_at")
    if free is None:
        return files.select(fresh.alias("slot"), *columns)
    places, _ = row_index(free, ["slot"], "_turn")
    turns = files.withColumn("_turn", F.lit(count - 1) - F.col("_at"))
    reused = turns.join(places, "_turn", "left")
    return reused.withColumn("slot", F.coalesce("slot", fresh)).select("slot", *columns)


def work_list(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Changed files at their slots and new files at allocated slots."""
    return changed_files(catalog, listing).unionByName(
        assign_slots(new_files(catalog, listing), catalog).select("slot", "path", "size")
    )


def densify(catalog: DataFrame) -> DataFrame:
    """Fill holes in the slot sequence with tombstones of size 0."""
    slots = catalog.sparkSession.range(slot_count(catalog)).withColumnRenamed("id", "slot")
    return slots.join(catalog, "slot", "left").select(
        "slot", "path", F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("live", F.lit(False)).alias("live"),
    )


def live_count(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count_if("live").alias("live_count"))


def result_count(catalog: DataFrame, k: int) -> DataFrame:
    return live_count(catalog).select(F.least(F.lit(k).cast("long"), "live_count").alias("result_count"))
