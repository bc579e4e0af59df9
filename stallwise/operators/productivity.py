"""Sale per square metre by category, brand, stall, season, weekend and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import days_between, quarter_label, weekend_label
from stallwise.functions.nullsafe import (
    blank,
    bucket,
    ratio,
    strict_greatest,
    strict_least,
    strict_sum,
)
from stallwise.operators.enrich import flag_promotion, per_lease
from stallwise.operators.ordered import with_position
from stallwise.operators.quantiles import OCTILES, group_quantiles, with_group_median
from stallwise.operators.shaping import long, wide
from stallwise.session import checkpointed

QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
STALL_KEYS = [
    "month_id", "category_name_3", "floor_name", "booth_code", "booth_name", "booth_grade",
    "house_no", "shop_name", "shop_id", "brand_name", "series_name", "contract_code",
    "contract_duration", "begin_date", "finish_date",
]


def covering(contracts: DataFrame, begin: str, finish: str) -> DataFrame:
    """Leases that cover the whole period."""
    return contracts.filter(
        (F.col("begin_date") <= F.lit(begin).cast("date"))
        & (F.col("finish_date") >= F.lit(finish).cast("date"))
    )


def in_months(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.filter(F.col("month_id").between(first[:7], last[:7]))


def sale_by(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Amount per group, from order rows or from sums per lease."""
    return rows.groupBy(*by).agg(strict_sum(F.col("act_amt")).cast("double").alias("sale"))


def period_ratio(
    sales: DataFrame,
    contracts: DataFrame,
    begin: str,
    finish: str,
    by: Sequence[str],
    join_on: str,
) -> DataFrame:
    """Sale, covering area and their quotient per group, not yet ordered."""
    area = (
        covering(contracts, begin, finish)
        .groupBy(join_on)
        .agg(strict_sum(F.col("actual_area")).alias("area"))
    )
    sale = sale_by(in_months(sales, begin, finish), by)
    joined = sale.join(area, join_on, "left")
    return joined.withColumn("saleperarea", ratio(F.col("sale"), F.col("area")))


def sale_per_area_in_period(
    sales: DataFrame,
    contracts: DataFrame,
    begin: str,
    finish: str,
    by: Sequence[str] = ("category_2_edit",),
    join_on: str = "category_2_edit",
) -> DataFrame:
    """Sale per square metre in whole months, highest first, with its rank ``id``.

    Only leases that cover the period count for the area. ``sales`` are
    enriched orders or enriched sums per lease.
    """
    found = period_ratio(sales, contracts, begin, finish, by, join_on)
    order = [F.col("saleperarea").desc_nulls_last(), *by]
    return with_position(found, order).orderBy("id")


def overlap_share(begin: Column, finish: Column, first: str, last: str, inclusive=False) -> Column:
    """Part of the period covered by a lease, in days from start to end.

    The end day is not counted unless ``inclusive``, so a single shared day
    weighs nothing.
    """
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    extra = 1 if inclusive else 0
    shared = days_between(strict_greatest(a, begin), strict_least(b, finish)) + extra
    return strict_greatest(F.lit(0.0), shared / (days_between(a, b) + extra))


def quarter_area(contracts: DataFrame, year: int, inclusive: bool = False) -> DataFrame:
    """Leases with their area weighted by the covered part of every quarter."""
    ends = {"Q1": ("01-01", "03-31"), "Q2": ("04-01", "06-30"),
            "Q3": ("07-01", "09-30"), "Q4": ("10-01", "12-31")}
    begin, finish = F.col("begin_date"), F.col("finish_date")
    return contracts.withColumns(
        {
            f"{q}_area": F.col("actual_area")
            * overlap_share(begin, finish, f"{year}-{a}", f"{year}-{b}", inclusive)
            for q, (a, b) in ends.items()
        }
    )


def year_area(contracts: DataFrame, year: int, inclusive: bool = False) -> DataFrame:
    """Leases with their area weighted by the covered part of the year."""
    share = overlap_share(
        F.col("begin_date"), F.col("finish_date"), f"{year}-01-01", f"{year}-12-31", inclusive
    )
    return contracts.withColumn("area", F.col("actual_area") * share)


def seasonal_sale_per_area(
    sales: DataFrame, contracts: DataFrame, year: int, by: str = "category_2_edit"
) -> DataFrame:
    """Sale per square metre of every category in every quarter, long form."""
    area = (
        quarter_area(contracts, year)
        .groupBy(by)
        .agg(*[strict_sum(F.col(f"{q}_area")).alias(f"{q}_area") for q in QUARTERS])
    )
    total = sum(F.col(f"{q}_area") for q in QUARTERS)
    rows = in_months(sales, f"{year}-01", f"{year}-12").withColumn(
        "quarter", quarter_label(F.concat("month_id", F.lit("-01")).cast("date"))
    )
    sale = wide(sale_by(rows, [by, "quarter"]), [by], "quarter", "sale", QUARTERS)
    joined = sale.join(area.filter(total > 0), by, "left")
    parts = [ratio(F.col(q), F.col(f"{q}_area")).alias(f"sale_perarea_{q}") for q in QUARTERS]
    return long(
        joined.select(by, *parts), [by], [f"sale_perarea_{q}" for q in QUARTERS],
        "quarter", "saleperarea",
    )


def yearly_sale_per_area(
    sales: DataFrame,
    contracts: DataFrame,
    year: int,
    by: str = "category_2_edit",
    also_by: Sequence[str] = (),
) -> DataFrame:
    """Sale per square metre of every category (and extra group) in one year."""
    area = year_area(contracts, year).groupBy(by).agg(strict_sum(F.col("area")).alias("area_sum"))
    sale = sale_by(in_months(sales, f"{year}-01", f"{year}-12"), [by, *also_by])
    joined = sale.join(area.filter("area_sum > 0"), by, "left")
    return joined.withColumn("sale_perarea_year", ratio(F.col("sale"), F.col("area_sum")))


def weekend_split(
    sales: DataFrame, contracts: DataFrame, begin: str, finish: str, by: str = "category_2_edit"
) -> DataFrame:
    """Sale per square metre at weekends and on weekdays, weekdays mirrored below zero."""
    rows = sales.withColumn("ifweekend", weekend_label(F.col("date_id")))
    found = period_ratio(rows, contracts, begin, finish, [by, "ifweekend"], by)
    value = F.col("saleperarea")
    mirrored = F.when(F.col("ifweekend") == "weekend", value).otherwise(-value)
    return found.withColumn("saleperarea_mirror", mirrored)


def weekend_index(
    sales: DataFrame, contracts: DataFrame, begin: str, finish: str, by: str = "category_2_edit"
) -> DataFrame:
    """Weekend over weekday sale per square metre of every category."""
    split = weekend_split(sales, contracts, begin, finish, by)
    table = wide(split, [by], "ifweekend", "saleperarea", ["weekday", "weekend"])
    return table.withColumn("weekend_index", ratio(F.col("weekend"), F.col("weekday")))


def promotion_index(
    sales: DataFrame,
    contracts: DataFrame,
    promotions: DataFrame,
    year: int,
    by: str = "category_2_edit",
) -> DataFrame:
    """Sale per square metre inside over outside promotions of every category."""
    rows = flag_promotion(in_months(sales, f"{year}-01", f"{year}-12"), promotions)
    found = yearly_sale_per_area(rows, contracts, year, by, ["onsale"])
    label = F.when(F.col("onsale"), "on_sale").otherwise("off_sale")
    table = wide(
        found.withColumn("label", label), [by], "label", "sale_perarea_year",
        ["off_sale", "on_sale"],
    )
    return table.withColumn("onsale_index", ratio(F.col("on_sale"), F.col("off_sale")))


def category_index(per_area: DataFrame, value: str = "saleperarea") -> DataFrame:
    """Add the median over all categories and the category's quotient to it."""
    found = with_group_median(per_area, value, [], "saleperarea_median")
    return found.withColumn("cat2_index", ratio(F.col(value), F.col("saleperarea_median")))


def brand_totals(
    sales: DataFrame, category: str = "category_2_edit", brand: str = "series_name"
) -> DataFrame:
    """Sale per area, sale and number of orders per brand within a category.

    ``sales`` are enriched sums per lease.
    """
    return sales.groupBy(category, brand).agg(
        strict_sum(F.col("avg_amt")).alias("saleperarea"),
        strict_sum(F.col("act_amt")).cast("double").alias("sale"),
        F.sum("order_num").alias("record_num"),
    )


def brand_index(
    totals: DataFrame, category: str = "category_2_edit", value: str = "saleperarea"
) -> DataFrame:
    """Add the median within the category and the brand's quotient to it."""
    found = with_group_median(totals, value, [category], "saleperarea_median")
    return found.withColumn("brand_index", ratio(F.col(value), F.col("saleperarea_median")))


def brands_of(totals: DataFrame, categories: Sequence[str], category: str) -> DataFrame:
    """Brand totals of some categories, category ascending and best brand first."""
    return totals.filter(F.col(category).isin(list(categories))).orderBy(
        F.col(category), F.col("saleperarea").desc_nulls_last()
    )


def totals_by(sales: DataFrame, level: str) -> DataFrame:
    """Sale and number of orders per category level or floor, highest sale first."""
    return (
        sales.groupBy(level)
        .agg(
            strict_sum(F.col("act_amt")).cast("double").alias("sale"),
            F.count(F.lit(1)).alias("record_num"),
        )
        .orderBy(F.col("sale").desc_nulls_last())
    )


def month_by_category(sales: DataFrame, level: str, labels: Sequence[str]) -> DataFrame:
    """Sale per month (rows) and category (columns) at any level."""
    return wide(sale_by(sales, ["month_id", level]), ["month_id"], level, "sale", labels)


def stall_months(orders: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sale per area, sale and number of orders per stall and month.

    The orders are summed per lease code and these sums meet the leases once. A code
    with several leases counts in full for each of their stalls.
    """
    shop = ["month_id", "house_no", "shop_name", "shop_id"]
    own = per_lease(orders, shop, levels=["cont_cat3_name"])
    filled = F.when(blank(F.col("category_name_1")), F.col("cont_cat3_name")).otherwise(
        F.col("category_name_3")
    )
    found = (
        own.join(contracts, "contract_code", "left")
        .withColumn("category_name_3", filled)
        .groupBy(*STALL_KEYS, "actual_area")
        .agg(strict_sum(F.col("act_amt")).alias("act_amt"), F.sum("order_num").alias("order_num"))
    )
    return found.select(
        *STALL_KEYS,
        ratio(F.col("act_amt"), F.col("actual_area")).alias("saleperarea"),
        F.col("act_amt").cast("double").alias("sale"),
        "order_num",
    )


def stall_metrics(months: DataFrame, start_month: str, as_of: str) -> DataFrame:
    """Sale per area (and per leased day) of every stall since a month, with octiles.

    Series, category and brand are the most frequent ones over the stall's
    monthly rows; the lowest wins a tie. They come from fixed lists, so the
    counts kept per stall are few. The leased days end at ``as_of``.
    """
    found = (
        months.filter(F.col("month_id") >= start_month)
        .groupBy("booth_code", "booth_grade", "contract_code", "begin_date", "finish_date")
        .agg(
            strict_sum(F.col("saleperarea")).alias("saleperarea"),
            F.mode("series_name", True).alias("series_name"),
            F.mode("category_name_3", True).alias("category_name_3"),
            F.mode("brand_name", True).alias("brand_name"),
        )
        .filter("saleperarea is not null")
    )
    until = strict_least(F.lit(as_of).cast("date"), F.col("finish_date"))
    found = found.withColumn("time_span", days_between(F.col("begin_date"), until))
    found = found.withColumn(
        "saleperareaperduration", ratio(F.col("saleperarea"), F.col("time_span"))
    )
    # One row per stall; the breaks of both values and the result read this written table.
    found = checkpointed(found)
    values = ["saleperarea", "saleperareaperduration"]
    points = group_quantiles(long(found, [], values, "measure", "value"), "value", OCTILES, ["measure"])
    breaks = {r["measure"]: list(r["quantiles"]) for r in points.collect()}
    for value in values:
        number = bucket(F.col(value), breaks[value]) if value in breaks else F.lit(None).cast("int")
        found = found.withColumn(f"{value}interval", number)
    return found


def brand_peers(stalls: DataFrame, value: str = "saleperareaperduration") -> DataFrame:
    """Every stall against the other stalls of its brand that started the same day.

    One row per stall that has such peers: their number and mean, and the best
    and worst value of the whole group. The pairs themselves are not listed.
    """
    keys = ["brand_name", "begin_date"]
    groups = (
        stalls.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count(value).alias("_k"),
            F.sum(value).alias("_s"),
            F.min(value).alias("group_lowest"),
            F.max(value).alias("group_highest"),
        )
        .filter("_n > 1")
    )
    own = F.coalesce(F.col(value), F.lit(0.0))
    others = F.col("_k") - F.col(value).isNotNull().cast("int")
    return stalls.join(groups, keys).select(
        *keys,
        "contract_code",
        "booth_code",
        value,
        (F.col("_n") - 1).alias("peers"),
        ratio(F.col("_s") - own, others).alias("peer_mean"),
        "group_lowest",
        "group_highest",
    )


def common_brands(contracts: DataFrame, mall_a: str, mall_b: str) -> DataFrame:
    """Brands leased in both of two malls."""
    of = {m: contracts.filter(F.col("mall_name") == m).select("brand_name") for m in (mall_a, mall_b)}
    return of[mall_a].intersect(of[mall_b])


def top_categories(sales: DataFrame, level: str, n: int = 3) -> DataFrame:
    """The ``n`` categories with the highest sale."""
    return (
        sale_by(sales, [level]).orderBy(F.col("sale").desc_nulls_last(), F.col(level)).limit(n)
    )
