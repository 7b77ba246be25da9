"""File listings and decoded images."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions.paths import is_image_path
from vecatlas.operators.paths import under_roots
from vecatlas.session import empty_table
from vecatlas.sources.storage import Storage

# Files that are opened by name; more are found by scanning their roots.
MAX_NAMED_FILES = 10_000
_LISTING = "path string, size long, modified timestamp"


def _existing(spark: SparkSession, roots: list[str]) -> list[str]:
    return [root for root in roots if Storage(spark).exists(root)]


def _plain_path(path):
    """Local files are known by their plain path, files elsewhere by their URI."""
    return F.regexp_replace(path, "^file:/+", "/")


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All accepted image files below ``roots``, each once; a root that does not exist is empty.

    Only names and sizes are read: ``content`` is pruned from the scan. Spark does not list empty files, nor names
    that start with '.' or '_'. The driver holds the files' status; for very many files ``list_inventory`` is the way.
    """
    present = _existing(spark, roots)
    if not present:
        return empty_table(spark, _LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(present)
    plain = _plain_path(F.col("path"))
    return (
        found.filter(is_image_path(F.col("path")))
        .select(plain.alias("path"), F.col("length").alias("size"),
                F.col("modificationTime").alias("modified"))
        .dropDuplicates(["path"])
    )


def list_inventory(inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """The listing of ``roots(root)`` out of an inventory ``path, size, modified`` as object stores write it.

    No folder is walked and no file status passes the driver, so this is the way for very many files. An inventory may
    name a file several times (its versions): the last one counts, and one of null size is a deleted file.
    """
    accepted = inventory.filter(is_image_path(F.col("path"))).select(
        _plain_path(F.col("path")).alias("path"), F.struct(F.col("modified"), F.col("size")).alias("version"))
    last = under_roots(accepted, roots).groupBy("path").agg(F.max("version").alias("version"))
    return last.select("path", "version.size", "version.modified").filter("size is not null").select("path", "size", "modified")


def _escaped(path: str) -> str:
    """A path that is not meant as a glob pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_images(
    spark: SparkSession, roots: list[str], drop_invalid: bool = True, only: DataFrame | None = None
) -> DataFrame:
    """``path, image`` of the files below ``roots``; invalid files are dropped or have height -1.

    ``only(path)`` names the files that are wanted. Up to a bound these alone are opened; a longer list
    means that much of the tree is wanted, and the whole tree is scanned. Either way a file that has vanished
    has no row.
    """
    schema = "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    present = _existing(spark, roots)
    if only is not None:
        wanted = [r["path"] for r in only.select("path").limit(MAX_NAMED_FILES + 1).collect()]
        if len(wanted) <= MAX_NAMED_FILES:
            present = [_escaped(path) for path in _existing(spark, wanted)]
    if not present:
        return empty_table(spark, schema)
    images = (
        spark.read.format("image")
        .option("dropInvalid", drop_invalid)
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .load(present)
    )
    # The reader gives the name as an encoded URI; a plus sign in it is meant as such.
    decoded = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    named = images.select(_plain_path(decoded).alias("path"), "image").filter(is_image_path(F.col("path")))
    return named.withColumn("image", F.col("image").withField("origin", F.col("path")))
