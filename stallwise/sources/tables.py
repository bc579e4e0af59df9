"""Scans of the domain tables. Every filter is a plain predicate, so it reaches the files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.dates import day, days_between, month
from stallwise.functions.texts import DAY_PATTERN, dealer_code

# Order states that do not count as a sale.
VOID_STATES = ["1", "7", "19", "Z", "X"]
# Fixed value: a promotion has to be shorter than this many days.
PROMOTION_DAYS = 15

ORDER_COLUMNS = [
    "ordr_id", "date_id", "ordr_date", "prod_name", "mall_name", "shop_id", "shop_name",
    "contract_code", "house_no", "booth_id", "booth_desc", "cnt_cat1_num", "cnt_cat2_num",
    "cnt_cat3_num", "is_coupon", "partner_name", "cont_cat1_name", "cont_cat2_name",
    "cont_cat3_name", "cont_main_brand_name", "act_amt",
]
CONTRACT_COLUMNS = [
    "contract_code", "brand_name", "series_name", "booth_code", "booth_grade", "booth_name",
    "category_name_1", "category_name_2", "category_name_3", "floor_name", "rentable_area",
    "actual_area", "zx_price", "month_amount", "contract_duration", "begin_date", "finish_date",
]


def read(
    spark: SparkSession, source: str, schema: str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """A file folder (any Spark format) or, with ``fmt="table"``, a catalog table."""
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(source)


def given_or(given: DataFrame | None, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The supplied table, or the one the reader returns."""
    return given if given is not None else fetch()


def valid_order(rule: str = "status") -> Column:
    """Which orders count: by ``status``, or by the older ``trade`` rule."""
    if rule == "status":
        return (F.col("act_amt") > 0) & ~F.col("ordr_status").isin(VOID_STATES)
    if rule == "trade":
        oms = F.col("type") == "OMS"
        return (oms & (F.col("ordr_status") == "Y")) | (~oms & (F.col("trade_amt") > 0))
    raise ValueError(f"unknown rule {rule!r}")


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def mall_sales(
    orders: DataFrame,
    mall: str = "",
    begin: str | None = None,
    finish: str | None = None,
    columns: Sequence[str] = ORDER_COLUMNS,
) -> DataFrame:
    """Valid orders of the malls whose name contains ``mall``, with their month.

    ``begin`` and ``finish`` are inclusive days. Where the table is stored by
    ``month_id`` the same range also prunes its folders.
    """
    rows = orders.filter(F.col("mall_name").contains(mall)).filter(valid_order("status"))
    for bound, keep in ((begin, "__ge__"), (finish, "__le__")):
        if bound is not None:
            rows = rows.filter(getattr(F.col("date_id"), keep)(F.lit(bound).cast("date")))
            if "month_id" in orders.columns:
                rows = rows.filter(getattr(F.col("month_id"), keep)(bound[:7]))
    stored = "month_id" in orders.columns
    key = F.col("month_id") if stored else month(F.col("date_id"))
    return rows.select(*_present(orders, columns), key.alias("month_id"))


def promotions(calendar: DataFrame, max_days: int = PROMOTION_DAYS) -> DataFrame:
    """Distinct promotions with a readable start and fewer than ``max_days`` days."""
    readable = calendar.filter(F.col("prom_begin_time").rlike(DAY_PATTERN))
    dated = readable.select(
        day(F.col("prom_begin_time")).alias("begin_date"), day(F.col("date")).alias("end_date")
    )
    return dated.filter(
        days_between(F.col("begin_date"), F.col("end_date")) < max_days
    ).distinct()


def mall_contracts(contracts: DataFrame, mall: str = "") -> DataFrame:
    """Leases of the malls whose name contains ``mall``, with their length in days."""
    rows = contracts.filter(F.col("mall_name").contains(mall)).withColumn(
        "contract_duration", days_between(F.col("begin_date"), F.col("finish_date"))
    )
    return rows.select(*_present(rows, [*CONTRACT_COLUMNS, "category_2_edit"]))


def dealer_survey(survey: DataFrame) -> DataFrame:
    """The dealer survey of the warehouse under the names used here."""
    return survey.select(
        F.col("sell_amount_mall").alias("mall_sale_estimated"),
        F.col("sell_amount_total").alias("total_sale_estimated"),
        F.col("business_name").alias("partner_name"),
        F.col("business_num").alias("partner_code"),
        F.col("link_name").alias("contact_name"),
    )


def dealer_sheet(sheet: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The dealer survey of an exported sheet.

    ``names`` maps number, name, contact, mall_sale and total_sale to the
    sheet's own headings; the dealer code is completed with its prefix.
    """
    return sheet.select(
        F.col(names["mall_sale"]).alias("mall_sale_estimated"),
        F.col(names["total_sale"]).alias("total_sale_estimated"),
        F.col(names["name"]).alias("partner_name"),
        dealer_code(F.col(names["number"])).alias("partner_code"),
        F.col(names["contact"]).alias("contact_name"),
    )


def visits_of_days(visits: DataFrame, first: str, last: str) -> DataFrame:
    """The visit log between two days (``dt`` as yyyymmdd), both included."""
    return visits.filter(F.col("dt").between(first, last))


def visits_of_month(spark: SparkSession, folder: str, month_id: str) -> DataFrame:
    """One month of the visit log written by ``sinks.write_by_month``."""
    return spark.read.parquet(folder).filter(F.col("month_id") == month_id)


def kept_days(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """The days ``first`` to ``last`` of the table that ``sinks.load_days`` keeps; other days are not read."""
    return spark.read.parquet(folder).withColumn("dt", F.col("dt").cast("string")).filter(F.col("dt").between(first, last))


def staff(profiles: DataFrame) -> DataFrame:
    """Distinct profiles that are valid and belong to staff."""
    return (
        profiles.filter((F.col("is_valid") == 1) & (F.col("is_staff") == 1))
        .select(F.col("rs_profile_id").alias("profile_id"))
        .distinct()
    )


def employees(table: DataFrame) -> DataFrame:
    """Phone numbers of employees."""
    return table.filter(F.col("isemp") == "Y").select("mobile").distinct()


def of_mall(table: DataFrame, mall: str) -> DataFrame:
    """Side tables (shop and booth, brand entry, dealer aliases) of some malls."""
    return table.filter(F.col("mall_name").contains(mall))


def first_rows(table: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first ``n`` rows in a given order."""
    return table.orderBy(*order).limit(n)
