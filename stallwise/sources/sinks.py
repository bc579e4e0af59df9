"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.shaping import first_per_key
from stallwise.session import checkpointed


def write_by_month(df: DataFrame, folder: str, key: str = "month_id") -> None:
    """One parquet folder per month, overwritten as a whole.

    Rows are rebalanced on the month: small months share a task, and a month
    with most of the rows is split by size instead of being written by one task.
    """
    laid = df.hint("rebalance", F.col(key))
    laid.write.mode("overwrite").partitionBy(key).parquet(folder)


def load_days(df: DataFrame, folder: str, key: str = "dt") -> None:
    """Write the days of ``df`` into a kept table; all other days of the table stay.

    A day that is loaded again is replaced as a whole, so a repeated or restarted load does not
    double it. Days are swapped in when the job commits: a load that fails leaves the old ones.
    """
    laid = df.hint("rebalance", F.col(key))
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def add_late(df: DataFrame, folder: str, keys: Sequence[str], key: str = "dt") -> None:
    """Add rows that came late to days already loaded, and whole days that are new.

    Rows with the keys of a stored row replace it. Only the days of ``df`` are read and written.
    Of several late rows with the same keys one is kept, the first by all its columns.
    """
    spark = df.sparkSession
    late = checkpointed(df)
    days = late.select(key).distinct()
    kept = spark.read.schema(late.schema).parquet(folder) if _exists(spark, folder) else late.limit(0)
    named = [*keys, key]
    new = late.distinct() if set(late.columns) == set(named) else first_per_key(late, named, [])
    old = kept.join(days, key, "left_semi").join(new.select(*named), named, "left_anti")
    # Written apart first: the days are read from the folder they go to.
    load_days(checkpointed(old.select(*late.columns).unionByName(new.select(*late.columns))), folder, key)


def _exists(spark: SparkSession, folder: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def write_table(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """A result folder in any Spark format; CSV keeps its header."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(folder)
