"""Calendar rules on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.texts import DAY_PATTERN

# Microseconds in a second and in a minute.
SECOND = 1_000_000
MINUTE = 60 * SECOND


def day(text: Column) -> Column:
    """First yyyy-mm-dd inside a text as a date; null where none can be read."""
    return F.regexp_substr(text, F.lit(DAY_PATTERN)).try_cast("date")


def month(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def iso_week(value: Column) -> Column:
    """Number of the ISO week; the period key where data span a single month."""
    return F.weekofyear(value).cast("int")


def quarter_label(value: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(value).cast("string"))


def day_name(value: Column) -> Column:
    return F.date_format(value, "EEEE")


def weekend_label(value: Column) -> Column:
    return F.when(F.weekday(value) >= 5, F.lit("weekend")).when(
        value.isNotNull(), F.lit("weekday")
    )


def days_between(begin: Column, end: Column) -> Column:
    return F.datediff(end, begin)


def minutes_between(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(6e7)


def micros_of(value: Column) -> Column:
    """Microseconds since the epoch: the exact time of an order or a visit."""
    return F.unix_micros(value.cast("timestamp"))


def micros_of_day(value: Column, date: Column) -> Column:
    return micros_of(value) - micros_of(date)


def days(spark: SparkSession, first: str, last: str, name: str = "date_id") -> DataFrame:
    """One row per calendar day, both ends included."""
    bounds = spark.range(1).select(
        F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b")
    )
    return bounds.select(F.explode(F.sequence("a", "b")).alias(name))
