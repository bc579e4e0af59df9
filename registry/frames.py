"""Mall tables derived from the delivered tables.

Every frame has the same definition in ``registry.oracle`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.joins import join_shuffled
from stallwise.sources.tables import read

# Column types of the delivered tables; nothing is inferred on read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string,
        l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read(spark, f"{sf}/{name}.parquet", SCHEMAS[name])


MALL_COLUMNS = {
    "shop_name": "s_name",
    "mall_name": "r_name",
    "mall_city_name": "n_name",
    "partner_name": "concat('Dealer ', cast(s_suppkey - if(s_suppkey % 4 = 1, 1, 0) as string))",
}


def with_mall(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows with a supplier's columns beside the region and the nation it is in."""
    nation = rows.join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    return nation.join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))


def malls(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier with the mall (region) and city (nation) it is in."""
    rows = with_mall(spark, sf, table(spark, sf, "supplier"))
    return rows.select("s_suppkey", *[F.expr(of).alias(name) for name, of in MALL_COLUMNS.items()])


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as mall orders."""
    # What is asked of a line is a few yes or no: these pack better in a shuffle than what they are made of.
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey AS s_suppkey", "l_linenumber", "l_extendedprice", "l_quantity >= 49 AS no_booth",
        "l_quantity < 5 AS no_house", "l_tax = 0 AS untaxed", "l_returnflag = 'R' AS returned", "l_linestatus = 'F' AS finished",
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    # The dealers are met one small table after the other while the lines are still narrow: a join of
    # these tables among themselves passes for a large one, and every line would be shuffled for it.
    # Names and numbers made of a key are made last, so that they are not shuffled.
    facts = join_shuffled(lines, orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    placed = with_mall(spark, sf, facts.join(table(spark, sf, "supplier"), "s_suppkey"))
    joined = join_shuffled(placed, part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"])
    mall = {name: f"{of} AS {name}" for name, of in MALL_COLUMNS.items()}
    return joined.selectExpr(
        "cast(l_orderkey as string) AS ordr_id",
        "cast(o_orderdate as date) AS date_id",
        "cast(o_orderdate as timestamp) AS ordr_date",
        "date_format(o_orderdate, 'yyyy-MM') AS month_id",
        mall["mall_name"],
        mall["mall_city_name"],
        "p_name AS prod_name",
        "cast(s_suppkey as string) AS shop_id",
        mall["shop_name"],
        "if(no_booth, null, concat('B', cast(l_partkey div 2 as string))) AS booth_id",
        "if(no_house, null, concat('H', cast(l_partkey div 2 as string))) AS house_no",
        "lpad(cast(s_suppkey as string), 10, '0') AS partner_code",
        mall["partner_name"],
        "cast(o_custkey as string) AS cust_name",
        "cast(o_custkey as string) AS mobile",
        "lpad(cast(l_partkey as string), 10, '0') AS contract_code",
        "cast(l_extendedprice as decimal(18,2)) AS act_amt",
        "cast(if(returned, 0, l_extendedprice) as decimal(18,2)) AS trade_amt",
        "if(untaxed, null, cast(l_extendedprice as decimal(18,2))) AS cont_unit_price",
        "if(finished, 'OMS', 'POS') AS type",
        """CASE WHEN o_orderstatus = 'F' THEN '3' WHEN o_orderstatus = 'P' THEN '15'
                WHEN returned THEN 'X' ELSE 'Y' END AS ordr_status""",
        "p_type AS cont_cat1_name",
        "concat(p_type, '-', cast(p_size % 4 as string)) AS cont_cat2_name",
        "p_name AS cont_cat3_name",
        "p_brand AS cont_main_brand_name",
        "l_linenumber",
        "l_partkey",
    )


def dirty_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The orders with blank lease codes and blank or missing categories."""
    gap = "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 5 THEN ' ' ELSE {} END"
    levels = ["cont_cat1_name", "cont_cat2_name", "cont_cat3_name"]
    return sales(spark, sf).withColumns(
        {
            "contract_code": F.expr("if(l_linenumber = 7, '', contract_code)"),
            **{c: F.expr(gap.format(c)) for c in levels},
        }
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as leases; some have no category, one category lacks an area."""
    part = table(spark, sf, "part").join(
        table(spark, sf, "region"), F.expr("p_partkey % 5 = r_regionkey")
    )
    gap = "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 13 = 6 THEN ' ' ELSE {} END"
    return part.selectExpr(
        "lpad(cast(p_partkey as string), 10, '0') AS contract_code",
        "r_name AS mall_name",
        "p_brand AS brand_name",
        "p_name AS series_name",
        "concat('B', cast(p_partkey div 2 as string)) AS booth_code",
        "substr('ABCD', cast(p_size % 4 + 1 as int), 1) AS booth_grade",
        """concat('N', cast(p_partkey div 2 as string),
                  if(p_partkey % 9 = 0, concat('/N', cast(p_partkey div 2 + 1 as string)), '')) AS booth_name""",
        gap.format("p_type") + " AS category_name_1",
        gap.format("concat(p_type, '-', cast(p_size % 4 as string))") + " AS category_name_2",
        gap.format("p_name") + " AS category_name_3",
        "concat(cast(p_partkey % 7 + 1 as string), 'F') AS floor_name",
        "cast(p_size as double) * 1.5 AS rentable_area",
        "if(p_type = 'ECONOMY' and p_size = 50, null, p_size * cast(1.7321 as double)) AS actual_area",
        "p_retailprice AS zx_price",
        "p_retailprice * 30 AS month_amount",
        "date_add(date'1995-01-01', cast(p_partkey * 37 % 1500 as int)) AS begin_date",
        """date_add(date'1995-01-01', cast(p_partkey * 37 % 1500 + 365 + p_partkey * 53 % 1500 as int))
           AS finish_date""",
    )


OVERRIDES = {"^ECONOMY-3$": "ECONOMY special"}


def category_dict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "concat(p_type, '-', cast(p_size % 4 as string)) AS category_name_2",
        "if(p_size % 4 <= 1, concat(p_type, ' basic'), null) AS category_2_edit",
    )


def promotion_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as promotions, start as a text with a time; one cannot be read."""
    begin = "date_add(date'1996-01-01', cast(n_nationkey * 60 as int))"
    return table(spark, sf, "nation").selectExpr(
        f"if(n_nationkey = 24, 'soon', concat(cast({begin} as string), ' 09:00:00')) AS prom_begin_time",
        f"cast(date_add({begin}, cast(n_nationkey % 20 as int)) as string) AS date",
    )


def employees(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) AS mobile", "if(c_mktsegment = 'MACHINERY', 'Y', 'N') AS isemp"
    )


def dealer_survey(spark: SparkSession, sf: str, sums: DataFrame | None = None) -> DataFrame:
    """Suppliers as surveyed dealers; the estimate is a multiple of the recorded total.

    ``sums`` are the amounts per dealer and name (``sum_act_amt``) where they are known.
    """
    if sums is None:
        sums = sales(spark, sf).groupBy("partner_code", "partner_name").agg(F.sum("act_amt").alias("sum_act_amt"))
    recorded = sums.select("partner_code", "partner_name", F.col("sum_act_amt").cast("double").alias("recorded"))
    key = "cast(partner_code as bigint)"
    return recorded.selectExpr(
        f"lpad(cast({key} + {key} % 3 * 1000000 as string), 10, '0') AS business_num",
        f"if({key} % 2 = 0, partner_name, 'none') AS business_name",
        f"if({key} % 5 = 0, partner_name, null) AS link_name",
        f"recorded / 10000 * (5 + {key} % 16) / 10 AS sell_amount_mall",
        f"recorded / 10000 * (5 + {key} % 16) / 5 AS sell_amount_total",
    )


def patchy_survey(spark: SparkSession, sf: str) -> DataFrame:
    """The survey with missing, repeated and blank codes and blank names."""
    n = "cast(business_num as bigint)"
    return dealer_survey(spark, sf).selectExpr(
        f"""CASE WHEN {n} % 7 = 0 THEN NULL WHEN {n} % 7 = 1 THEN lpad(cast({n} - 1 as string), 10, '0')
            WHEN {n} % 7 = 2 THEN ' ' ELSE business_num END AS business_num""",
        f"if({n} % 11 = 0, ' ', business_name) AS business_name",
        "link_name",
        "sell_amount_mall",
        "sell_amount_total",
    )


def shared_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """The leases, of which every seventh code has a second stall of its own area."""
    rows = contracts(spark, sf)
    second = rows.filter("cast(contract_code as bigint) % 7 = 0").selectExpr(
        "* EXCEPT (booth_code, actual_area)",
        "concat('X', booth_code) AS booth_code",
        "actual_area * 2 AS actual_area",
    )
    return rows.unionByName(second)


def event_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Events as orders with a time, for the dealer features."""
    return table(spark, sf, "events").selectExpr(
        "cast(event_id as string) AS ordr_id",
        "lpad(cast(user_id div 15 as string), 10, '0') AS partner_code",
        "cast(ts as date) AS date_id",
        "cast(ts as timestamp) AS ordr_date",
        "cast(value as decimal(18,2)) AS act_amt",
        "if(value < 2, null, concat('B', cast(user_id % 30 as string))) AS booth_id",
        "cast(user_id as string) AS cust_name",
        "if(value > 200, null, event_type) AS cont_cat3_name",
        "if(value < 5, null, concat('H', cast(user_id as string))) AS house_no",
        "if(value > 100, null, cast(value as decimal(18,2))) AS cont_unit_price",
        """CASE event_type WHEN 'click' THEN '3' WHEN 'view' THEN '15' WHEN 'purchase' THEN 'Y'
           WHEN 'error' THEN '7' ELSE 'N' END AS ordr_status""",
    )


def track(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the visit log; views and clicks are stays."""
    return table(spark, sf, "events").selectExpr(
        "cast(event_id as string) AS id",
        "cast(user_id as string) AS profile_id",
        "cast(user_id as string) AS pid",
        "user_id div 5 AS store_id",
        "concat('Shop ', cast((user_id + if(user_id % 3 = 0, 1, 0)) div 5 as string)) AS store_name",
        "if(event_type in ('view', 'click'), 0, 1) AS event_type",
        "cast(ts as timestamp) AS enter_time",
        "cast(ts as timestamp) + make_dt_interval(0, 0, 0, cast(cast(value as decimal(18,2)) * 60 as decimal(18,6))) AS exit_time",
        "date_format(ts, 'yyyyMMdd') AS dt",
    )


def staff_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "cast(user_id as string) AS rs_profile_id",
        "1 AS is_valid",
        "if(user_id % 7 = 0, 1, 0) AS is_staff",
    )


def shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as orders of the shops that are visited."""
    return table(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "cast(event_id as string) AS ordr_id",
        "cast(user_id div 5 as string) AS shop_id",
        "cast(ts as date) AS date_id",
        "cast(ts as timestamp) AS ordr_date",
        "cast(value as decimal(18,2)) AS act_amt",
        "concat('P', cast(user_id % 5 as string)) AS prod_name",
        "concat('C', cast(user_id % 3 as string)) AS cont_cat3_name",
        "concat('M', cast(user_id % 2 as string)) AS cont_main_brand_name",
    )


def shop_booths(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").join(
        table(spark, sf, "region"), F.expr("p_partkey % 5 = r_regionkey")
    )
    return part.selectExpr(
        "concat('B', cast(p_partkey div 2 as string)) AS booth_code",
        "cast(p_partkey div 66 as string) AS shop_id",
        "p_name AS shop_name",
        "r_name AS mall_name",
    )


def layout(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "concat(cast(p_partkey % 7 + 1 as string), 'F') AS floor",
        "cast(p_partkey div 7 % 15 + 1 as int) AS row",
        "cast(p_partkey div 105 + 1 as int) AS col",
        "if(p_size = 1, null, lpad(cast(p_partkey as string), 10, '0')) AS contract_code",
    )
