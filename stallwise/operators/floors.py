"""Floor grids. A layout has one row per cell: floor, row, col, contract_code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.texts import lines
from stallwise.functions.nullsafe import strict_sum
from stallwise.operators.joins import lookup
from stallwise.operators.productivity import stall_metrics
from stallwise.operators.shaping import first_per_key, latest_per_key, split_cells


def layout_of(
    spark: SparkSession, floor: str, matrix: Sequence[Sequence[str | None]]
) -> DataFrame:
    """Layout rows of a floor plan given as a matrix; a corridor cell is null."""
    plan = spark.createDataFrame([(floor, [list(r) for r in matrix])], "floor string, m array<array<string>>")
    rows = plan.select("floor", F.posexplode("m").alias("r", "cells"))
    cells = rows.select("floor", (F.col("r") + 1).alias("row"), F.posexplode("cells").alias("c", "contract_code"))
    return cells.select("floor", "row", (F.col("c") + 1).alias("col"), "contract_code")


def booth_grid(layout: DataFrame, contracts: DataFrame) -> DataFrame:
    """Layout with the booth of every cell's lease (the first one, if several)."""
    codes = contracts.groupBy("contract_code").agg(F.min("booth_code").alias("booth_code"))
    return lookup(layout, codes, "contract_code")


def heat_grid(
    layout: DataFrame,
    stalls: DataFrame,
    labels: Sequence[str] = ("series_name",),
    value: str = "saleperareainterval",
    on: str = "booth_code",
) -> DataFrame:
    """Value, label text and booth grade of every cell.

    On booths the latest lease counts, on leases the first stall row. A cell
    without a stall has value 0 and empty texts.
    """
    if on == "booth_code":
        cells = latest_per_key(stalls, ["booth_code"], "contract_code")
    else:
        cells = first_per_key(stalls, [on], ["begin_date"])
    wanted = cells.select(
        on,
        F.col(value).alias("value"),
        lines(*[F.col(c) for c in labels]).alias("label"),
        F.col("booth_grade").alias("grade"),
    )
    return lookup(layout.select("floor", "row", "col", on), wanted, on).na.fill(
        {"value": 0, "label": "", "grade": ""}
    )


def footfall_by_booth(
    shop_visitors: DataFrame, shop_booths: DataFrame, contracts: DataFrame
) -> DataFrame:
    """Visitors per shop with the shop's booths and the booths' leases."""
    booths = shop_booths.select("shop_id", "booth_code", "shop_name")
    leases = contracts.select("booth_code", "contract_code")
    with_booth = shop_visitors.join(
        booths, shop_visitors["store_id"] == booths["shop_id"], "left"
    ).drop("shop_id")
    return with_booth.join(leases, "booth_code", "left")


def footfall_grid(
    layout: DataFrame,
    footfall: DataFrame,
    value: str = "month_daily_uv",
    on: str = "booth_code",
    labels: Sequence[str] = ("shop_name",),
    label_table: DataFrame | None = None,
    label_on: str = "booth_code",
) -> DataFrame:
    """Visitors and label of every cell; labels from the footfall or another table."""
    values = first_per_key(footfall.select(on, value), [on], [value]).withColumnRenamed(
        value, "value"
    )
    source = footfall if label_table is None else label_table
    key = on if label_table is None else label_on
    texts = first_per_key(source.select(key, *labels), [key], list(labels)).select(
        key, lines(*[F.col(c).cast("string") for c in labels]).alias("label")
    )
    cells = lookup(lookup(layout, values, on), texts, key)
    return cells.select("floor", "row", "col", on, "value", "label").na.fill(
        {"value": 0, "label": ""}
    )


def booth_dictionary(rows: DataFrame) -> DataFrame:
    """Distinct booth codes and names, "a/b" cells split in step."""
    return split_cells(
        rows.select("booth_code", "booth_name").distinct(), ["booth_code", "booth_name"]
    ).distinct()


def _of_split_booths(months: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Stall rows once for every booth code that their booth name stands for."""
    names = dictionary.select("booth_name", "booth_code")
    rows = split_cells(months, ["booth_code"]).drop("booth_code")
    return rows.join(names, "booth_name", "left")


def stalls_by_split_booth(months: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sale per area of every booth code, shared booths split into their parts.

    A stall counts fully for every code its booth name stands for; a missing value
    makes the sum missing. The stalls are summed before they meet the dictionary.
    """
    keys = ["booth_name", "booth_grade", "contract_code", "begin_date"]
    summed = (
        split_cells(months, ["booth_code"])
        .groupBy(*keys)
        .agg(strict_sum(F.col("saleperarea")).alias("saleperarea"))
    )
    names = dictionary.select("booth_name", "booth_code")
    return (
        summed.join(names, "booth_name", "left")
        .groupBy("booth_code", "booth_grade", "contract_code", "begin_date")
        .agg(strict_sum(F.col("saleperarea")).alias("saleperarea"))
    )


def split_booth_metrics(
    months: DataFrame, dictionary: DataFrame, start_month: str, as_of: str
) -> DataFrame:
    """``productivity.stall_metrics`` with shared booths split into their parts."""
    return stall_metrics(_of_split_booths(months, dictionary), start_month, as_of)
