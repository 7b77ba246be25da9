"""Digests of directories, so that a diff compares the files of differing directories only.

A directory's digest is the number of its files and sums of hashes of their paths and sizes: it needs no order, is summed
in the tasks that read the files, and sums of subdirectories give the digest of a tree. Two listings agree on a
tree if its digests are equal (124 bits of hash sums: for practical purposes only then).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors
from vecatlas.operators.catalog import diff, live_rows

_SUMS = ["files", "s1", "s2", "s3", "s4"]


def _directory(path):
    """The directory of a path; empty for a bare name."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def directory_digests(files: DataFrame) -> DataFrame:
    """``dir, files, s1 .. s4`` of the files directly in each directory, of ``files(path, size)``."""
    parts = []
    for n in range(2):
        h = F.xxhash64(F.lit(n), "path", "size")
        parts += [h.bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(h, 33)]
    hashed = files.select(_directory(F.col("path")).alias("dir"), *(p.alias(f"s{i + 1}") for i, p in enumerate(parts)))
    return hashed.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), *(F.sum(s).alias(s) for s in _SUMS[1:]))


def tree_digests(digests: DataFrame) -> DataFrame:
    """Digests of whole trees, summed upwards: a row for each directory and each of its ancestors."""
    above = F.array_union(ancestors(F.concat("dir", F.lit("/x"))), F.array("dir"))
    up = digests.select(F.explode(above).alias("dir"), *_SUMS)
    return up.groupBy("dir").agg(*(F.sum(s).alias(s) for s in _SUMS))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """``dir`` of the digests that are not the same on both sides."""
    both = old.select(*_SUMS, "dir", F.lit(1).alias("side")).unionByName(new.select(*_SUMS, "dir", F.lit(-1).alias("side")))
    net = both.groupBy("dir").agg(*(F.sum(F.col(s) * F.col("side")).alias(s) for s in _SUMS))
    return net.filter(" or ".join(f"{s} <> 0" for s in _SUMS)).select("dir")


def outermost_unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """``dir`` of the largest trees that are the same on both sides, from the digests of their directories."""
    trees = tree_digests(old)
    changed = differing(trees, tree_digests(new))
    same = trees.join(changed, "dir", "left_anti").select("dir", _directory(F.col("dir")).alias("parent"))
    inner = same.filter("dir <> ''").join(same.select(F.col("dir").alias("parent")), "parent", "left_anti")
    return inner.select("dir").unionByName(same.filter("dir = ''").select("dir"))


def diff_by_digest(catalog: DataFrame, listing: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``diff`` of a catalog and a listing, where only paths of differing directories are joined.

    ``kept`` are the catalog's digests, if they were kept since the last sync.
    """
    old = directory_digests(live_rows(catalog)) if kept is None else kept
    changed = differing(old, directory_digests(listing))
    within = lambda rows: rows.withColumn("dir", _directory(F.col("path"))).join(changed, "dir", "left_semi").drop("dir")
    return diff(within(live_rows(catalog)), within(listing))
