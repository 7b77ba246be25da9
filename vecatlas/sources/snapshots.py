"""Catalog interchange as JSON lines, one splittable row per slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.operators.ranking import prefix_sum
from vecatlas.session import materialize

CATALOG_SCHEMA = "slot long, path string, size long, live boolean"


def write_catalog_json(catalog: DataFrame, path: str) -> None:
    catalog.select("slot", "path", "size", "live").write.json(path)


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """A malformed row fails the read: an empty catalog would have everything encoded again."""
    return spark.read.schema(CATALOG_SCHEMA).option("mode", "FAILFAST").json(path)


# Fixed value: the path of an empty slot.
NO_FILE = "NOTEXISTS"
_ROW = r"^[\s,]*\[?\s*(\[.*)$"


def write_catalog_array(catalog: DataFrame, path: str) -> None:
    """A dense catalog as one JSON array of ``[path, size]`` in the order of slots, on one line.

    The parts below ``path``, joined by name, are the document.
    """
    ends = catalog.agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    pair = F.to_json(F.struct(F.coalesce(F.when(F.col("live"), F.col("path")), F.lit(NO_FILE)).alias("p")))
    row = F.concat(F.lit("["), F.regexp_extract(pair, r'^\{"p":(.*)\}$', 1), F.lit(", "), F.coalesce("size", F.lit(0)).cast("string"))
    lead, close = F.when(F.col("slot") == F.col("first"), "[").otherwise(", "), F.when(F.col("slot") == F.col("last"), "]").otherwise("")
    rows = catalog.crossJoin(F.broadcast(ends)).select("slot", F.concat(lead, row, close).alias("value"))  # one row on the right
    # The line separator closes each row, and the last one's closes the array.
    rows.repartitionByRange("slot").sortWithinPartitions("slot").select("value").write.option("lineSep", "]").text(path)


def read_catalog_array(spark: SparkSession, path: str) -> DataFrame:
    """``slot, path, size, live`` of a JSON array of ``[path, size]``: a row's place is its slot.

    The document may be one line of any length. It is cut at closing brackets in many tasks; whether such a bracket stands in
    a string follows from the quotes before it, counted by running totals over all pieces. A blank document, and one
    of an empty array, has no rows; any other that is not such an array raises.
    """
    pieces = spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"))
    place = ["file", "start", "at"]
    bare = F.regexp_replace("piece", r"\\.", "")
    pieces = pieces.withColumn("quotes", (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).cast("long"))
    pieces = prefix_sum(pieces, place, "quotes", "before")
    closes = ((F.col("before") + F.col("quotes")) % 2 == 0).cast("long")
    pieces = materialize(prefix_sum(pieces.withColumn("closes", closes), place, "closes", "slot"), "pieces")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, "piece"))), lambda p: p["piece"]), "]")
    rows = pieces.groupBy("slot").agg(joined.alias("text"))
    rows = rows.withColumn("length", F.length("text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    count = rows.filter(F.col("text").contains("[")).count()
    lead = F.when(F.col("slot") == 0, F.col("text").rlike(r"^\[\s*\[")).otherwise(F.col("text").rlike(r"^,\s*\["))
    pair = F.from_json(F.concat(F.regexp_extract("text", _ROW, 1), F.lit("]")), "array<string>")
    rows = rows.select("slot", "text", "length", lead.alias("lead"), pair.alias("pair"))
    size = F.try_element_at("pair", F.lit(2)).cast("string").try_cast("long")
    sound = F.col("lead") & (F.size("pair") == 2) & F.try_element_at("pair", F.lit(1)).isNotNull() & size.isNotNull()
    # After the last row the bracket that closes the array leaves an empty piece; only blanks may follow.
    after = F.when(F.col("slot") == count, F.col("text") == "").otherwise((F.col("text") == "") & (F.col("length") > 0))
    wrong = rows.filter(~F.when(F.col("slot") < count, F.coalesce(sound, F.lit(False))).otherwise(after))
    if wrong.isEmpty() and (not count or rows.filter(F.col("slot") == count).count()):
        found = rows.filter(F.col("slot") < count)
    elif count == 1 and rows.filter("text = '['").count() and spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"^\s*\[\s*\]\s*$")).count():
        found = rows.limit(0)
    else:
        raise ValueError("the catalog is not an array of [path, size]")
    name = F.try_element_at("pair", F.lit(1))
    live = name != NO_FILE
    return found.select(
        "slot", F.when(live, name).alias("path"), size.alias("size"), live.alias("live"))
