"""Directory containment as equi joins on ancestor directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.functions.paths import ancestors, directory_key


def _keys(roots: DataFrame, case_insensitive: bool) -> DataFrame:
    key = directory_key(F.col("root"))
    return roots.select((F.lower(key) if case_insensitive else key).alias("_dir")).distinct()


def outermost(roots: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Roots that lie in no other root, as ``_dir``; any path is under at most one of them."""
    keys = _keys(roots, case_insensitive)
    above = keys.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("_above"))
    inner = above.join(keys.select(F.col("_dir").alias("_above")), "_above", "left_semi")
    return keys.join(inner.select("_dir").distinct(), "_dir", "left_anti")


def under_roots(df: DataFrame, roots: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``path`` lies below one of ``roots(root)``, each once.

    Each path is paired with its own ancestors only. When the roots are few the join is broadcast by
    its size; otherwise adaptive execution splits a directory that holds very many paths.
    """
    path = F.lower("path") if case_insensitive else F.col("path")
    with_dirs = df.withColumn("_dir", F.explode(ancestors(path)))
    return with_dirs.join(outermost(roots, case_insensitive), "_dir", "left_semi").drop("_dir")


def register_roots(registered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Judge ``candidates(root, ordinal)`` in order against ``registered(root)`` and each other.

    ``status`` is 'duplicate' for a root that is registered already, 'covered' for one below a
    registered root, else 'added'. A parent of a registered root is added.
    """
    key = directory_key(F.col("root"))
    old = registered.select(key.alias("_dir")).distinct()
    asked = candidates.select("root", "ordinal", key.alias("_dir"))
    first = asked.groupBy("_dir").agg(F.min("ordinal").alias("_first"))
    known = old.withColumn("_since", F.lit(None).cast("long")).unionByName(
        first.select("_dir", F.col("_first").cast("long").alias("_since"))
    )
    # The earliest moment at which an ancestor is known. A rejected candidate counts too: whatever
    # rejected it also covers everything below it.
    covers = known.groupBy("_dir").agg(
        F.min(F.coalesce("_since", F.lit(-(2**62)))).alias("_since")
    )
    above = first.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("_above"))
    covered = (
        above.join(covers.withColumnRenamed("_dir", "_above"), "_above")
        .groupBy("_dir")
        .agg(F.min("_since").alias("_covered"))
    )
    judged = (
        asked.join(first, "_dir")
        .join(covered, "_dir", "left")
        .join(old.withColumn("_old", F.lit(True)), "_dir", "left")
    )
    was_added = F.col("_old").isNull() & ~F.coalesce(F.col("_covered") < F.col("_first"), F.lit(False))
    repeats = was_added & (F.col("ordinal") > F.col("_first"))
    status = (
        F.when(F.col("_old") | repeats, "duplicate")
        .when(F.col("_covered") < F.col("ordinal"), "covered")
        .otherwise("added")
    )
    return judged.select("root", "ordinal", status.alias("status"))


def unregister_roots(registered: DataFrame, removed: DataFrame) -> DataFrame:
    key = directory_key(F.col("root"))
    return registered.withColumn("_dir", key).join(
        removed.select(key.alias("_dir")).distinct(), "_dir", "left_anti"
    ).drop("_dir")
