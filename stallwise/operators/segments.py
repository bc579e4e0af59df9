"""Shop segmentation: name audit, ratios, scaling and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.nullsafe import distinct_with_null, ratio
from stallwise.operators.joins import keep_matching
from stallwise.operators.quantiles import group_quantiles
from stallwise.operators.shaping import long
from stallwise.session import checkpointed

MEASURES = ["uv", "pv", "sale_sum", "sale_count"]
RATIOS = ["uv_over_sale_count", "pv_over_sale_count", "uv_over_sale_sum", "pv_over_sale_sum"]


def names_of_ambiguous_ids(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Names of the ids that have more than one name, each name once.

    Swap the arguments to list the ids of names that have more than one id.
    """
    number = rows.groupBy(key).agg(distinct_with_null(F.col(name)).alias("_n"))
    found = keep_matching(rows.select(key, name), number.filter("_n > 1"), [key])
    return found.groupBy(name).agg(F.min(key).alias(key)).select(key, name)


def shop_ratios(visits: DataFrame, orders: DataFrame, period) -> DataFrame:
    """Visitors, visits, sale and orders of a shop and period with four ratios.

    Shops need both visits and orders. What counts as visitor and visit is our
    own definition: distinct persons and rows.
    """
    traffic = visits.groupBy(
        F.col("store_id").alias("shop_id"), period(F.col("enter_date")).alias("period")
    ).agg(distinct_with_null(F.col("pid")).alias("uv"), F.count(F.lit(1)).alias("pv"))
    sale = orders.groupBy("shop_id", period(F.col("date_id")).alias("period")).agg(
        F.sum("act_amt").cast("double").alias("sale_sum"), F.count(F.lit(1)).alias("sale_count")
    )
    joined = traffic.join(sale, ["shop_id", "period"])
    return joined.withColumns(
        {
            f"{a}_over_{b}": ratio(F.col(a), F.col(b))
            for b in ("sale_count", "sale_sum")
            for a in ("uv", "pv")
        }
    )


def _scaled(rows: DataFrame, columns: Sequence[str], low, width) -> DataFrame:
    """(x - low) / width with the two statistics of every column read as one row."""
    rows = checkpointed(rows)
    found = rows.agg(
        *[f(F.col(c)).cast("double").alias(f"{n}_{c}") for c in columns
          for n, f in (("a", low), ("b", width))]
    ).first()

    def number(name: str) -> Column:
        return F.lit(found[name]).cast("double")

    return rows.withColumns(
        {c: ratio(F.col(c) - number(f"a_{c}"), number(f"b_{c}")) for c in columns}
    )


def min_max_scaled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes null."""
    return _scaled(rows, columns, F.min, lambda c: F.max(c) - F.min(c))


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by their standard deviation."""
    return _scaled(rows, columns, F.avg, F.stddev_samp)


def fences(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and the 1.5 IQR fences of several columns, one row per column and group."""
    values = long(rows, list(by), list(columns), "measure", "value")
    found = group_quantiles(values, "value", [0, 0.25, 0.5, 0.75, 1], [*by, "measure"])
    q = [F.col("quantiles")[i] for i in range(5)]
    spread = 1.5 * (q[3] - q[1])
    names = ["lowest", "q1", "median", "q3", "highest"]
    return found.select(
        *by, "measure", "n", *[x.alias(n) for x, n in zip(q, names)],
        (q[1] - spread).alias("lower_fence"), (q[3] + spread).alias("upper_fence"),
    )


def outliers(
    rows: DataFrame, columns: Sequence[str], keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Values beyond the fences of their column and group."""
    rows = checkpointed(rows.select(*keys, *by, *columns))
    values = long(rows, [*keys, *by], list(columns), "measure", "value")
    limits = fences(rows, columns, by).select(*by, "measure", "lower_fence", "upper_fence")
    return values.join(limits, [*by, "measure"]).filter(
        "value < lower_fence or value > upper_fence"
    )


def next_period_test(
    sampled: DataFrame, features: DataFrame, key: str = "shop_id", label: str = "cluster"
) -> DataFrame:
    """Sampled shops with their label and the features of another period."""
    return sampled.select(key, label).join(features.drop(label), key)
