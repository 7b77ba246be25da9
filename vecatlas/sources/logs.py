"""Error log: parsing and retention."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: lines are kept for this many days.
KEPT_DAYS = 7


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def line_date(line: Column) -> Column:
    """The ISO date that is the first space-separated field, else NULL."""
    field = F.element_at(F.split(line, " "), 1)
    return F.when(field.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(field, "yyyy-MM-dd"))


def retain(log: DataFrame, now: datetime.date, legacy: bool = False) -> DataFrame:
    """Keep lines younger than the limit and drop lines without a date.

    ``legacy`` measures the age with the opposite sign, so that no past line ever ages out.
    """
    date = line_date(F.col("line"))
    age = F.datediff(date, F.lit(now)) if legacy else F.datediff(F.lit(now), date)
    return log.filter(date.isNotNull() & (age < KEPT_DAYS))


def parse(log: DataFrame) -> DataFrame:
    """``ts, message`` of lines of the form ``asctime -  message``."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) -  (.*)$"
    stamp = F.regexp_extract("line", pattern, 1)
    return log.select(
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        F.regexp_extract("line", pattern, 2).alias("message"),
    ).filter("ts is not null")
