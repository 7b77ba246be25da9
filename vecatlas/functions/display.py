"""Formatted result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecatlas.functions.paths import normalize_path

_MEBIBYTE = 1 << 20


def size_hundredths(size: Column) -> Column:
    """Size in hundredths of a MB, half-even on exact ties, in whole-number arithmetic."""
    scaled = size.cast("decimal(25,0)") * F.lit(100)
    whole = F.floor(scaled / F.lit(_MEBIBYTE)).cast("bigint")
    rest = (scaled - whole * F.lit(_MEBIBYTE).cast("decimal(10,0)")).cast("bigint")
    half = F.lit(_MEBIBYTE // 2)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def size_text(size: Column) -> Column:
    hundredths = size_hundredths(size)
    whole = F.floor(hundredths / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("MB"))


def modified_text(modified: Column) -> Column:
    return F.date_format(modified, "yyyy-MM-dd HH:mm:ss")


def score_text(score: Column) -> Column:
    rounded = F.bround(score.cast("decimal(30,12)"), 2).cast("decimal(20,2)")
    return F.concat(rounded.cast("string"), F.lit("%"))


def path_id(path: Column) -> Column:
    """The first 16 hex digits of the md5 of the normalised path."""
    return F.substring(F.md5(normalize_path(path)), 1, 16)
