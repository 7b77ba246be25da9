"""Export manifest: collision-free target names for copies into one flat directory.

A source asks for its own file name; if that is taken it gets 'stem (n)' with the first free n >= 2.
Earlier sources go first. The names that one request can fall back on are its children: 'a (2).png'
is a child of 'a.png'. A request and its overflow interact only through children that are taken
already or asked for by name, so everything else is a rank within the requested name. Names are
settled level by level, parents first, with ranks and running totals that span tasks: one name may be
asked for by any share of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.functions.paths import base_name, stem, suffix
from vecatlas.operators.ranking import prefix_sum, rank_within
from vecatlas.session import empty_table, materialize

# ' (n)' as the rule writes it: n >= 2 without leading zeros.
_COPY = r"^(.+) \(([2-9]|[1-9][0-9]{1,17})\)$"
_COPIES = r"^.+?((?: \((?:[2-9]|[1-9][0-9]{1,17})\))*)$"
_NEVER = 2**62


def _with_parent(names: DataFrame) -> DataFrame:
    """Add ``parent`` and ``n`` of a copy name and its ``depth``, the number of trailing ' (n)'."""
    base, ext = stem(F.col("name")), suffix(F.col("name"))
    trail = F.regexp_extract(base, _COPIES, 1)
    depth = F.length(trail) - F.length(F.replace(trail, F.lit("("), F.lit("")))
    is_copy = depth > 0
    return names.select(
        "*",
        depth.alias("depth"),
        F.when(is_copy, F.concat(F.regexp_extract(base, _COPY, 1), ext)).alias("parent"),
        F.when(is_copy, F.regexp_extract(base, _COPY, 2).cast("long")).alias("n"),
    )


def export_manifest(sources: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``src_path, ordinal, target_name`` for ``sources(src_path, ordinal)``.

    ``taken(name)`` lists what the directory holds already.
    """
    spark = sources.sparkSession
    asked = sources.select("src_path", F.col("ordinal").cast("long").alias("ordinal"),
                           base_name(F.col("src_path")).alias("name"))
    first = asked.groupBy("name").agg(F.min("ordinal").alias("since"))
    if taken is None:
        taken = empty_table(spark, "name string")
    held = taken.select("name").distinct().withColumn("since", F.lit(-1).cast("long"))
    # One row per name that is taken or asked for: from when on it would be in use.
    nodes = first.unionByName(held).groupBy("name").agg(F.min("since").alias("since"))
    nodes = materialize(_with_parent(nodes), "nodes")
    asked = materialize(asked.join(nodes.select("name", "depth"), "name"), "asked")
    (deepest,) = asked.agg(F.coalesce(F.max("depth"), F.lit(0))).first()

    # Names that overflow from a parent reaches, and when.
    reached = empty_table(spark, "name string, at long")
    manifest = empty_table(spark, "src_path string, ordinal long, target_name string")
    for depth in range(deepest + 1):
        here = asked.filter(F.col("depth") == depth)
        uses = nodes.select("name", "since").join(reached, "name", "left")
        judged = here.join(uses, "name")
        wins = (F.col("ordinal") == F.col("since")) & (
            F.col("at").isNull() | (F.col("at") > F.col("since"))
        )
        judged = judged.withColumn("_wins", wins)
        kept = judged.filter("_wins").select("src_path", "ordinal", F.col("name").alias("target_name"))
        spilled = rank_within(
            judged.filter("not _wins").select("src_path", "ordinal", "name"), ["name"], ["ordinal"], "i"
        )
        spilled = materialize(spilled, "spilled")
        marks = _settle(nodes, spilled)
        if marks is None:
            numbered = spilled.withColumn("n", F.col("i") + 1)
            reached = empty_table(spark, "name string, at long")
        else:
            numbered = _number(spilled, marks)
            reached = marks.filter("not skipped and at is not null").select(F.col("child").alias("name"), "at")
        copies = numbered.select(
            "src_path", "ordinal",
            F.concat(stem(F.col("name")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"),
                     suffix(F.col("name"))).alias("target_name"),
        )
        manifest = manifest.unionByName(kept).unionByName(copies)
    return manifest


def _settle(nodes: DataFrame, spilled: DataFrame) -> DataFrame | None:
    """Which marked children the overflow of their parent skips: ``parent, child, n, i, at, skipped``.

    Overflow takes children in ascending n. Child n is reached by overflow number i = n - 1 - (skipped
    children below n), at that source's place ``at``, and is skipped if it is in use by then. The
    skips below n depend on each other only upwards, so repeating the step settles at least one more
    child of every parent each time; it ends when nothing moves.
    """
    overflowing = spilled.select(F.col("name").alias("parent")).distinct()
    marks = nodes.filter("n is not null").select(
        "parent", F.col("name").alias("child"), "n", F.col("since").alias("in_use")
    ).join(overflowing, "parent", "left_semi")
    # Names held from the beginning are skipped if they are reached, and where they are not, nothing used lies
    # above them; so they may count as skipped at once, and a run of them takes one pass.
    marks = materialize(marks.withColumn("skipped", F.col("in_use") < 0), "marks")
    if marks.isEmpty():
        return None
    places = spilled.select(F.col("name").alias("parent"), "i", F.col("ordinal").alias("at"))
    while True:
        ones = marks.select(
            "parent", "child", "n", "in_use", "skipped", F.col("skipped").cast("long").alias("_one")
        )
        counted = prefix_sum(ones, ["parent", "n"], "_one", "_below")
        start = counted.groupBy("parent").agg(F.min("_below").alias("_start"))
        located = counted.join(start, "parent").withColumn(
            "i", F.col("n") - 1 - (F.col("_below") - F.col("_start"))
        )
        step = located.join(places, ["parent", "i"], "left").select(
            "parent", "child", "n", "in_use", "i", "at", F.col("skipped").alias("_before"),
            F.coalesce(F.col("in_use") < F.col("at"), F.lit(False)).alias("skipped"),
        )
        marks = materialize(step, "marks")
        if marks.filter("skipped <> _before").isEmpty():
            return marks.drop("_before")


def _number(spilled: DataFrame, marks: DataFrame) -> DataFrame:
    """n of each overflowing source: its number plus one plus the skipped children it had to pass."""
    passed = marks.filter("skipped").select(
        F.col("parent").alias("name"), "i", F.lit(1).cast("long").alias("_skip"),
        F.col("n").alias("ordinal"), F.lit(None).cast("string").alias("src_path"),
    )
    events = spilled.select("name", "i", F.lit(0).cast("long").alias("_skip"), "ordinal", "src_path")
    mixed = events.unionByName(passed).withColumn("_late", -F.col("_skip"))
    counted = prefix_sum(mixed, ["name", "i", "_late", "ordinal"], "_skip", "_below")
    start = counted.groupBy("name").agg(F.min("_below").alias("_start"))
    return (
        counted.join(start, "name")
        .filter("src_path is not null")
        .withColumn("n", F.col("i") + 1 + F.col("_below") - F.col("_start"))
    )
