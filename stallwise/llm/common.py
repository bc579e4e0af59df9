"""Reading, staging and distributed numbering shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.session import discard, prepare, scratch

# Rows per Arrow batch: whole texts travel in them, so batches stay short.
BATCH_ROWS = "1000"
LAST_ID = 2**63 - 1


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The files outlive a lost executor and cut the lineage; unlike a checkpoint they
    keep column pruning and pushed filters. They go with the session.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a staged table early; all that was made of it must be staged itself."""
    discard(df.sparkSession, df.staged_path)


def cells_for(rows: int, groups: int, per_cell: int = 50_000) -> int:
    """Into how many cells each of ``groups`` groups is cut for :func:`numbered`."""
    return max(1, -(-rows // (groups * per_cell)))


def numbered(df: DataFrame, groups: list[str], cell: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within ``groups``, by ``cell`` and then ``order``.

    Cells are counted first; a row's number is its place in its cell plus the rows of the
    cells before. No task sorts a whole group: a cell is as much as one task gets.
    """
    cut = df.withColumn("_cell", cell)
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*groups, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*groups, "_cell").orderBy(*order)
    return (
        cut.join(starts, [*groups, "_cell"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_cell", "_start")
    )
