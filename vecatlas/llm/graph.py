"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(v, root): for every end of a link (a, b: longs) the smallest vertex that it is connected to.

    Each round a vertex and its parent hear the smallest grandparent among the vertex's neighbours, and paths are
    halved; all steps are joins and minima with partial aggregation. Rounds grow with the logarithm of a
    component's diameter. Each round's labels are written, so a lost executor repeats one round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("f")), "labels")
    while True:
        up = labels.select(F.col("v").alias("f"), F.col("f").alias("g"))
        known = materialize(labels.join(up, "f").select("v", "f", "g"), "parents")
        heard = both.join(known.select(F.col("v").alias("b"), "g"), "b").groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m"))
        told = known.join(heard, "v").select("v", "f", F.least("f", "g", "m").alias("x"))
        offers = told.select("v", F.col("f").alias("old"), "x").unionByName(
            told.select(F.col("f").alias("v"), F.lit(None).cast("long").alias("old"), "x"))
        new = materialize(offers.groupBy("v").agg(F.max("old").alias("old"), F.min("x").alias("f")), "labels")
        labels = new.select("v", "f")
        if not new.where("f <> old").limit(1).count():
            return labels.select("v", F.col("f").alias("root"))
