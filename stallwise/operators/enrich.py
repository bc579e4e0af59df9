"""Orders with their lease: codes, categories, area, promotions, staff purchases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.nullsafe import blank, ratio, strict_sum
from stallwise.functions.texts import LEASE_BY_SHOP_TEXT, filled_code
from stallwise.operators.joins import lookup

ORDER_LEVELS = ["cont_cat1_name", "cont_cat2_name", "cont_cat3_name"]
LEASE_LEVELS = ["category_name_1", "category_name_2", "category_name_3"]


def repair_contract_code(
    orders: DataFrame, rules: Mapping[str, str] = LEASE_BY_SHOP_TEXT
) -> DataFrame:
    """Drop orders without a code column value; fill blank codes from the shop name."""
    code = filled_code(F.col("contract_code"), F.col("shop_name"), rules)
    return orders.filter("contract_code is not null").withColumn("contract_code", code)


def apply_category_dict(
    contracts: DataFrame, dictionary: DataFrame, overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Add ``category_2_edit``: dictionary, then overrides, then the name itself.

    ``overrides`` maps a regular expression on the name to the edited category;
    a later one wins.
    """
    edited = F.col("category_2_edit")
    name = F.col("category_name_2")
    for pattern, value in (overrides or {}).items():
        edited = F.when(name.rlike(pattern), F.lit(value)).otherwise(edited)
    entries = dictionary.select("category_name_2", "category_2_edit").distinct()
    joined = lookup(contracts, entries, "category_name_2")
    return joined.withColumn("category_2_edit", F.coalesce(edited, name)).select(
        *contracts.columns, "category_2_edit"
    )


def fill_categories(rows: DataFrame) -> DataFrame:
    """Fill blank categories of the lease from the order, then the reverse.

    Level 1 decides, all three levels are copied, and no row is lost.
    """
    from_order = blank(F.col(LEASE_LEVELS[0]))
    filled = rows.withColumns(
        {a: F.when(from_order, F.col(b)).otherwise(F.col(a))
         for a, b in zip(LEASE_LEVELS, ORDER_LEVELS)}
    )
    from_lease = blank(F.col(ORDER_LEVELS[0]))
    return filled.withColumns(
        {b: F.when(from_lease, F.col(a)).otherwise(F.col(b))
         for a, b in zip(LEASE_LEVELS, ORDER_LEVELS)}
    )


def with_contract(orders: DataFrame, contracts: DataFrame) -> DataFrame:
    """Orders, or sums of orders per lease, with lease columns and filled categories.

    ``avg_amt`` is the amount per square metre. Callers that only need sums
    should sum per lease code first (``per_lease``): that leaves one row per
    lease instead of one per order to be joined. Sums kept without the order's
    own categories have nothing to fill from.
    """
    joined = lookup(orders, contracts, "contract_code")
    if set(ORDER_LEVELS) <= set(orders.columns):
        joined = fill_categories(joined)
    return joined.withColumn("avg_amt", ratio(F.col("act_amt"), F.col("actual_area")))


def per_lease(
    orders: DataFrame, extra: Sequence[str | Column] = (), levels: Sequence[str] = ORDER_LEVELS
) -> DataFrame:
    """Sum amount and count of orders per lease code, order categories and extras.

    Pass ``levels=()`` where only the lease's edited category is asked for.

    The sums combine on the map side, so a lease with most of the orders is one
    row per task when it is shuffled.
    """
    return orders.groupBy("contract_code", *levels, *extra).agg(
        strict_sum(F.col("act_amt")).alias("act_amt"), F.count(F.lit(1)).alias("order_num")
    )


def promotion_days(promotions: DataFrame) -> DataFrame:
    """Every calendar day inside a promotion, once."""
    return (
        promotions.filter("begin_date <= end_date")
        .select(F.explode(F.sequence("begin_date", "end_date")).alias("date_id"))
        .distinct()
    )


def flag_promotion(orders: DataFrame, promotions: DataFrame, name: str = "onsale") -> DataFrame:
    """Add whether the order day lies in any promotion, both ends included."""
    days = promotion_days(promotions).withColumn("_hit", F.lit(True))
    flagged = orders.join(days, "date_id", "left")
    return flagged.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def flag_staff_purchase(orders: DataFrame, employees: DataFrame) -> DataFrame:
    """Add whether the buyer's phone number is an employee's."""
    phones = employees.select("mobile").distinct().withColumn("_hit", F.lit(True))
    joined = lookup(orders, phones, "mobile")
    return joined.withColumn("staff_purchase", F.col("_hit").isNotNull()).drop("_hit")


def trusted_sales(
    orders: DataFrame, dealers: DataFrame, begin: str = "2017-01-01", finish: str = "2017-12-31"
) -> DataFrame:
    """Orders of one year by dealers whose name is in the trusted table."""
    period = orders.filter(
        F.col("date_id").between(F.lit(begin).cast("date"), F.lit(finish).cast("date"))
    )
    names = dealers.select("partner_name").distinct()
    return period.join(names, "partner_name", "left_semi")
