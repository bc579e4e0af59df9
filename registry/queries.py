"""One Spark query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import frames
from stallwise.functions import dates, nullsafe, texts
from stallwise.operators import (
    dealers,
    enrich,
    ensembles,
    floors,
    footfall,
    learning,
    productivity,
    segments,
    shaping,
)
from stallwise.operators.joins import keep_matching
from stallwise.plans import jobs
from stallwise.session import bounded_tasks, checkpointed, dropped, prepare, releasing, scratch, shared_folder
from stallwise.sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BEGIN, FINISH, YEAR = "1998-03-01", "1998-03-31", 1998


# Sums of many doubles are rounded to fewer places: their last digits depend on
# the order of addition.
PLACES = {
    "category_backfill": 3, "brand_index": 3, "best_brands": 3, "booth_many_to_many": 3,
    "stall_metrics": 4, "split_booth_metrics": 4, "floor_heat_by_lease": 4, "brand_peers": 4,
}


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Whole numbers as bigint, amounts and ratios as rounded doubles."""
    scale = 10.0**places
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c * scale) / scale + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tidy(fn(bounded_tasks(prepare(spark)), sf), PLACES.get(fn.__name__, 6))

    QUERIES[fn.__name__] = run
    return fn


# ---- shared steps ------------------------------------------------------------


def leases(spark, sf):
    """All leases with their edited category."""
    found = tables.mall_contracts(frames.contracts(spark, sf))
    return enrich.apply_category_dict(found, frames.category_dict(spark, sf), frames.OVERRIDES)


def summed(spark, sf, *extra, levels=()):
    """Sums per lease with the lease's columns, and the leases."""
    rows = tables.mall_sales(frames.sales(spark, sf))
    area = leases(spark, sf)
    return enrich.with_contract(enrich.per_lease(rows, extra, levels), area), area


def stall_months_of(spark, sf):
    return productivity.stall_months(
        tables.mall_sales(frames.sales(spark, sf)), leases(spark, sf)
    )


def split_booth_months(spark, sf, *columns):
    """Columns of the stall months with their booth code, written once: rows and dictionary both read them."""
    rows = stall_months_of(spark, sf).withColumn("booth_code", F.regexp_replace("booth_name", "N", "B"))
    return checkpointed(rows.select("booth_name", "booth_code", "booth_grade", "contract_code", "begin_date", "saleperarea", *columns))


def stalls_of(spark, sf):
    return productivity.stall_metrics(stall_months_of(spark, sf), "1998-01", "1999-06-30")


def calendar(spark, sf):
    return tables.promotions(frames.promotion_calendar(spark, sf))


def visits_of(spark, sf):
    """Stays without staff."""
    visits = footfall.stays(footfall.prepare_visits(frames.track(spark, sf)))
    return footfall.without_staff(visits, tables.staff(frames.staff_profiles(spark, sf)))


def orders_of(spark, sf):
    return footfall.prepare_orders(frames.shop_orders(spark, sf))


def labelled(spark, sf):
    """Dealers with the survey's labels; one pass over the orders gives totals and survey."""
    sums = checkpointed(dealers.dealer_sums(frames.sales(spark, sf)))
    survey = tables.dealer_survey(frames.dealer_survey(spark, sf, sums))
    return dealers.survey_labels(dealers.totals_of_sums(sums), survey)


# ---- scans -------------------------------------------------------------------


@query
def valid_orders(spark, sf):
    rows = tables.mall_sales(frames.sales(spark, sf), "ASIA", "1998-01-01", "1998-12-31")
    return rows.select("ordr_id", "date_id", "month_id", "shop_id", "contract_code", "act_amt")


@query
def valid_orders_trade_rule(spark, sf):
    rows = frames.sales(spark, sf).filter(tables.valid_order("trade"))
    rows = shaping.of_years(rows, [1996, 1997, 1998])
    return rows.groupBy("month_id", "type").agg(
        F.sum("act_amt").alias("sale"), F.count(F.lit(1)).alias("record_num")
    )


@query
def promo_calendar(spark, sf):
    return calendar(spark, sf)


@query
def contract_duration(spark, sf):
    return tables.mall_contracts(frames.contracts(spark, sf), "ASIA")


@query
def survey_rename(spark, sf):
    survey = frames.dealer_survey(spark, sf)
    names = {
        "mall_sale": "sell_amount_mall", "total_sale": "sell_amount_total",
        "name": "business_name", "number": "business_num", "contact": "link_name",
    }
    return (
        tables.dealer_survey(survey)
        .withColumn("origin", F.lit("warehouse"))
        .unionByName(tables.dealer_sheet(survey, names).withColumn("origin", F.lit("sheet")))
    )


@query
def day_scan(spark, sf):
    rows = tables.visits_of_days(frames.track(spark, sf), "20240105", "20240118")
    found = rows.groupBy(F.to_date("enter_time").alias("date_id")).agg(
        F.count(F.lit(1)).alias("visits")
    )
    return dates.days(spark, "2024-01-01", "2024-01-31").join(found, "date_id", "left")


@query
def side_tables(spark, sf):
    return tables.of_mall(frames.shop_booths(spark, sf), "ASIA")


@query
def first_rows(spark, sf):
    rows = frames.track(spark, sf).select("id", "store_id", "enter_time")
    return tables.first_rows(rows, 600, [F.col("enter_time"), F.col("id")])


@query
def employee_phones(spark, sf):
    return tables.employees(frames.employees(spark, sf))


@query
def write_read_back(spark, sf):
    """Write by month, read one month back."""
    rows = frames.sales(spark, sf).select("ordr_id", "shop_id", "act_amt", "month_id")
    folder = f"{shared_folder(spark)}/sales-by-month-{uuid.uuid4().hex}"
    sinks.write_by_month(tables.given_or(rows, lambda: frames.sales(spark, sf)), folder)
    return tables.visits_of_month(spark, folder, "1998-03")


@query
def daily_loads(spark, sf):
    """Days loaded in part, one of them again in full, and late rows for old and new days."""
    rows = frames.track(spark, sf).select("id", F.col("store_id").cast("string").alias("store_id"), "profile_id", "dt")
    even = F.col("id").cast("bigint") % 2 == 0
    folder = scratch(spark, "visits-by-day")
    sinks.load_days(rows.filter(even & (F.col("dt") <= "20240110")), folder)
    sinks.load_days(rows.filter("dt = '20240105'"), folder)
    sinks.add_late(rows.filter(~even & F.col("dt").between("20240108", "20240112")), folder, ["id"])
    return tables.kept_days(spark, folder, "20240104", "20240111")


# ---- enrichment and row rules ------------------------------------------------


@query
def category_backfill(spark, sf):
    rows = enrich.with_contract(
        enrich.per_lease(frames.dirty_sales(spark, sf)),
        tables.mall_contracts(frames.contracts(spark, sf)),
    )
    return rows.groupBy(*enrich.LEASE_LEVELS, *enrich.ORDER_LEVELS).agg(
        F.sum("order_num").alias("record_num"),
        F.sum("act_amt").alias("sale"),
        nullsafe.strict_sum(F.col("avg_amt")).alias("saleperarea"),
    )


@query
def enriched_orders(spark, sf):
    """The row-level join, one row per order."""
    rows = enrich.with_contract(
        frames.dirty_sales(spark, sf), tables.mall_contracts(frames.contracts(spark, sf))
    )
    return rows.select(
        "ordr_id", "contract_code", "booth_code", "category_name_2", "cont_cat2_name", "avg_amt"
    )


REPAIR_RULES = {"#00000000": "0000000001", "#00000001": "0000000002", "#0000000": "0000000003"}


@query
def contract_repair_rules(spark, sf):
    fixed = enrich.repair_contract_code(frames.dirty_sales(spark, sf), REPAIR_RULES)
    return fixed.groupBy("contract_code").agg(F.count(F.lit(1)).alias("record_num"))


@query
def category_dict(spark, sf):
    return leases(spark, sf).select("contract_code", "category_name_2", "category_2_edit")


@query
def promo_flag(spark, sf):
    daily = frames.sales(spark, sf).groupBy("date_id").agg(F.count(F.lit(1)).alias("record_num"))
    return enrich.flag_promotion(daily, calendar(spark, sf))


@query
def booth_filter(spark, sf):
    rows = shaping.stalls(
        stall_months_of(spark, sf), ["N12", "H7"], "1997-01", "1998-06", F.col("sale") > 20000
    )
    return rows.select("month_id", "contract_code", "booth_name", "house_no", "shop_id", "sale")


@query
def trusted_sales(spark, sf):
    trusted = dealers.trusted_dealers(labelled(spark, sf))
    rows = enrich.trusted_sales(frames.sales(spark, sf), trusted, "1998-01-01", "1998-12-31")
    return rows.select("ordr_id", "partner_name", "date_id", "contract_code", "act_amt")


@query
def staff_purchases(spark, sf):
    rows = enrich.flag_staff_purchase(
        frames.sales(spark, sf), tables.employees(frames.employees(spark, sf))
    )
    return rows.groupBy("month_id", "staff_purchase").agg(
        F.count(F.lit(1)).alias("record_num"), F.sum("act_amt").alias("sale")
    )


@query
def complete_rows(spark, sf):
    rows = frames.sales(spark, sf).select("ordr_id", "booth_id", "house_no", "cont_unit_price")
    return shaping.complete_kinds(rows, {"subset": ["booth_id", "house_no"], "all": None})


@query
def numeric_only(spark, sf):
    return shaping.without_texts(frames.contracts(spark, sf), ["contract_code"])


@query
def label_remap(spark, sf):
    rows = frames.contracts(spark, sf).select(
        "contract_code", F.ascii("booth_grade").alias("label")
    )
    return shaping.relabel(rows, "label", {65: 67, 66: 65, 67: 66})


@query
def text_functions(spark, sf):
    number = F.expr("cast(l_partkey + 9000 as string)")
    mark = F.concat(F.expr("cast(l_partkey % 4 as string)"), F.expr("if(l_partkey % 3 = 0, '楼', 'F')"))
    rows = frames.sales(spark, sf)
    return rows.select(
        "contract_code",
        texts.zero_padded(F.lit("p"), number).alias("padded"),
        texts.dealer_code(number).alias("dealer"),
        texts.prefixed(F.lit("m-"), F.col("house_no")).alias("prefixed"),
        texts.floor_mark(mark).alias("floor_mark"),
        texts.lines(F.col("house_no"), F.col("booth_id")).alias("label"),
        texts.contains_any(F.col("cont_cat2_name"), ["-1", "-2"]).alias("found"),
        F.substring("month_id", 1, 4).alias("year"),
    ).distinct()


@query
def math_functions(spark, sf):
    rows = frames.sales(spark, sf)
    a, b = F.col("act_amt"), F.col("cont_unit_price")
    return rows.groupBy("month_id").agg(
        F.sum(nullsafe.strict_least(a, b)).alias("least_sum"),
        F.sum(nullsafe.strict_greatest(a, b)).alias("greatest_sum"),
        F.sum(F.round(nullsafe.safe_log10(a.cast("double")), 3).cast("decimal(18,3)")).alias("log10_sum"),
        F.sum(F.round(nullsafe.safe_ln(a.cast("double")), 3).cast("decimal(18,3)")).alias("ln_sum"),
        F.count(nullsafe.ratio(a, F.lit(0))).alias("undefined"),
        nullsafe.distinct_with_null(F.col("booth_id")).alias("booths"),
        nullsafe.strict_sum(b).alias("strict"),
        F.sum(nullsafe.bucket(a.cast("double"), [0.0, 1000.0, 20000.0, 50000.0])).alias("buckets"),
    )


# ---- productivity ------------------------------------------------------------


@query
def sale_per_area_period(spark, sf):
    return productivity.sale_per_area_in_period(
        *summed(spark, sf, "month_id"), BEGIN, FINISH
    )


@query
def stall_month(spark, sf):
    return stall_months_of(spark, sf).drop("house_no", "shop_name")


@query
def stall_month_shared(spark, sf):
    """The same where a lease code has two leases."""
    area = enrich.apply_category_dict(
        tables.mall_contracts(frames.shared_contracts(spark, sf)), frames.category_dict(spark, sf), frames.OVERRIDES
    )
    found = productivity.stall_months(tables.mall_sales(frames.sales(spark, sf)), area)
    return found.select("month_id", "shop_id", "contract_code", "booth_code", "category_name_3", "saleperarea", "sale", "order_num")


@query
def stall_metrics(spark, sf):
    return stalls_of(spark, sf)


@query
def quarter_area(spark, sf):
    rows = productivity.quarter_area(leases(spark, sf), YEAR)
    return rows.select("contract_code", *[f"{q}_area" for q in productivity.QUARTERS])


@query
def year_area(spark, sf):
    return productivity.year_area(leases(spark, sf), YEAR).select("contract_code", "area")


@query
def seasonal_sale_per_area(spark, sf):
    return productivity.seasonal_sale_per_area(
        *summed(spark, sf, "month_id"), YEAR
    )


@query
def yearly_sale_per_area(spark, sf):
    return productivity.yearly_sale_per_area(
        *summed(spark, sf, "month_id", "shop_id"), YEAR, also_by=["shop_id"]
    )


@query
def weekend_split(spark, sf):
    return productivity.weekend_split(
        *summed(spark, sf, "month_id", "date_id"), "1998-07-01", "1998-07-31"
    )


@query
def weekend_index(spark, sf):
    return productivity.weekend_index(
        *summed(spark, sf, "month_id", "date_id"), "1998-07-01", "1998-07-31"
    )


@query
def promo_index(spark, sf):
    return productivity.promotion_index(
        *summed(spark, sf, "month_id", "date_id"), calendar(spark, sf), YEAR
    )


@query
def category_index(spark, sf):
    found = productivity.period_ratio(
        *summed(spark, sf, "month_id"), BEGIN, FINISH,
        ["category_2_edit"], "category_2_edit",
    )
    return productivity.category_index(found)


@query
def brand_index(spark, sf):
    return productivity.brand_index(productivity.brand_totals(summed(spark, sf)[0]))


@query
def best_brands(spark, sf):
    rows = summed(spark, sf, levels=enrich.ORDER_LEVELS)[0]
    totals = productivity.brand_totals(rows, "category_name_1", "brand_name")
    return productivity.brands_of(totals, ["ECONOMY", "SMALL", "PROMO"], "category_name_1")


@query
def category_totals(spark, sf):
    """All levels in one pass over the orders."""
    rows = tables.mall_sales(frames.sales(spark, sf))
    levels = [F.struct(F.lit(c).alias("level"), F.col(c).alias("category")) for c in enrich.ORDER_LEVELS]
    return rows.select("act_amt", F.inline(F.array(*levels))).groupBy("level", "category").agg(
        F.sum("act_amt").alias("sale"), F.count(F.lit(1)).alias("record_num")
    )


@query
def floor_totals(spark, sf):
    rows = summed(spark, sf)[0]
    found = rows.groupBy("floor_name").agg(
        F.sum("act_amt").alias("sale"), F.sum("order_num").alias("record_num")
    )
    return found.orderBy(F.col("sale").desc_nulls_last())


@query
def category_month_wide(spark, sf):
    labels = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return productivity.month_by_category(
        tables.mall_sales(frames.sales(spark, sf)), "cont_cat1_name", labels
    )


@query
def top_categories(spark, sf):
    return productivity.top_categories(frames.sales(spark, sf), "cont_cat2_name", 3)


@query
def months_union(spark, sf):
    """Quarters cut out, put together again and turned long."""
    quarter = dates.quarter_label(F.col("date_id")).alias("quarter")
    sale = frames.sales(spark, sf).groupBy("cont_cat1_name", quarter).agg(
        F.sum("act_amt").cast("double").alias("sale")
    )
    table = shaping.wide(sale, ["cont_cat1_name"], "quarter", "sale", productivity.QUARTERS)
    return shaping.long(table, ["cont_cat1_name"], productivity.QUARTERS, "quarter", "sale")


@query
def month_index(spark, sf):
    found = productivity.sale_by(frames.sales(spark, sf), ["month_id", "cont_cat1_name"])
    return shaping.month_index(found)


@query
def brand_peers(spark, sf):
    return productivity.brand_peers(stalls_of(spark, sf))


@query
def brands_in_both(spark, sf):
    rows = frames.contracts(spark, sf).withColumn(
        "brand_name", F.concat_ws(" ", "brand_name", "series_name")
    )
    return productivity.common_brands(rows, "ASIA", "EUROPE")


# ---- floors ------------------------------------------------------------------


@query
def grid_lookup(spark, sf):
    return floors.booth_grid(frames.layout(spark, sf), frames.contracts(spark, sf))


@query
def floor_heat(spark, sf):
    grid = floors.booth_grid(frames.layout(spark, sf), frames.contracts(spark, sf))
    return floors.heat_grid(
        grid, stalls_of(spark, sf), ["series_name", "brand_name"], "saleperareaperdurationinterval"
    )


@query
def floor_heat_by_lease(spark, sf):
    return floors.heat_grid(
        frames.layout(spark, sf), stalls_of(spark, sf), ["brand_name"], "saleperarea",
        "contract_code",
    )


def booth_footfall(spark, sf):
    booths = shaping.first_per_key(
        frames.shop_booths(spark, sf).drop("mall_name"), ["booth_code", "shop_id"], ["shop_name"]
    )
    visits = footfall.stays(footfall.prepare_visits(frames.track(spark, sf)))
    return floors.footfall_by_booth(
        footfall.visitors(visits), booths, frames.contracts(spark, sf)
    )


@query
def booth_visitors(spark, sf):
    return booth_footfall(spark, sf)


@query
def floor_footfall(spark, sf):
    grid = floors.booth_grid(frames.layout(spark, sf), frames.contracts(spark, sf))
    return floors.footfall_grid(grid, booth_footfall(spark, sf))


@query
def floor_footfall_by_lease(spark, sf):
    """Values by lease, labels from the stall table."""
    months = stalls_of(spark, sf).withColumn(
        "saleperareaperduration", F.round("saleperareaperduration", 3)
    )
    return floors.footfall_grid(
        frames.layout(spark, sf), booth_footfall(spark, sf), on="contract_code",
        labels=["brand_name", "series_name"], label_table=months, label_on="contract_code",
    )


@query
def split_booths(spark, sf):
    rows = frames.contracts(spark, sf).select(
        F.regexp_replace("booth_name", "N", "B").alias("booth_code"), "booth_name"
    )
    return floors.booth_dictionary(rows)


@query
def booth_many_to_many(spark, sf):
    rows = split_booth_months(spark, sf)
    return floors.stalls_by_split_booth(rows, floors.booth_dictionary(rows))


@query
def split_booth_metrics(spark, sf):
    rows = split_booth_months(spark, sf, "month_id", "finish_date", "series_name", "category_name_3", "brand_name")
    return floors.split_booth_metrics(rows, floors.booth_dictionary(rows), "1998-01", "1999-06-30")


# ---- dealers -----------------------------------------------------------------


@query
def dealer_totals(spark, sf):
    rows = dealers.city_orders(frames.sales(spark, sf), "NATION_3", "1996-01-01", "1998-12-31")
    return dealers.dealer_totals(rows)


@query
def dealer_places(spark, sf):
    return dealers.dealer_totals(frames.sales(spark, sf), ["mall_name", "shop_id", "contract_code"])


@query
def dealer_labels(spark, sf):
    return labelled(spark, sf)


@query
def trusted_dealers(spark, sf):
    return dealers.trusted_dealers(labelled(spark, sf))


@query
def survey_points(spark, sf):
    return dealers.survey_points(labelled(spark, sf))


@query
def dealer_or_match(spark, sf):
    totals = dealers.dealer_totals(frames.sales(spark, sf))
    return dealers.survey_matches(totals, tables.dealer_survey(frames.dealer_survey(spark, sf)))


@query
def dealer_or_match_patchy(spark, sf):
    """The same with missing, repeated and blank codes and names in the survey."""
    totals = dealers.dealer_totals(frames.sales(spark, sf))
    return dealers.survey_matches(totals, tables.dealer_survey(frames.patchy_survey(spark, sf)))


@query
def duplicate_names(spark, sf):
    totals = dealers.dealer_totals(frames.sales(spark, sf))
    return shaping.with_repeats(totals, "partner_name", "often")


@query
def dealer_gaps(spark, sf):
    """Every gap length of a dealer and how often it occurs, zero gaps included."""
    gaps = dealers.order_gaps(frames.event_orders(spark, sf))
    real = gaps.filter("gap is not null").select("partner_code", "gap", F.lit(1).alias("n"))
    zero = gaps.filter("zero_gaps > 0").select(
        "partner_code", F.lit(0.0).alias("gap"), F.col("zero_gaps").alias("n")
    )
    return real.unionByName(zero).groupBy("partner_code", "gap").agg(F.sum("n").alias("n"))


@query
def dealer_gap_statistics(spark, sf):
    return dealers.gap_statistics(dealers.order_gaps(frames.event_orders(spark, sf)))


@query
def dealer_longest_run(spark, sf):
    gaps = dealers.order_gaps(frames.event_orders(spark, sf))
    return dealers.longest_runs(gaps, dealers.RUNS)


@query
def customer_longest_run(spark, sf):
    """The same per customer and day: many short sequences with equal times."""
    rows = frames.sales(spark, sf).withColumn("partner_code", F.col("cust_name"))
    gaps = dealers.order_gaps(rows)
    kinds = {"max_cont_hit": (2 * 86400, True), "max_cont_hit_nozero": (2 * 86400, False)}
    return dealers.longest_runs(gaps, kinds)


@query
def dealer_isolated(spark, sf):
    return dealers.isolated_orders(dealers.order_gaps(frames.event_orders(spark, sf)))


@query
def dealer_peak_day(spark, sf):
    return dealers.peak_day(frames.sales(spark, sf))


@query
def dealer_big_share(spark, sf):
    return dealers.big_share(frames.sales(spark, sf), 20000)


@query
def dealer_booths(spark, sf):
    return dealers.booth_count(frames.sales(spark, sf))


@query
def dealer_entropy(spark, sf):
    return dealers.customer_entropy(frames.sales(spark, sf))


@query
def dealer_top_category(spark, sf):
    levels = {level: f"cat{i}" for i, level in enumerate(enrich.ORDER_LEVELS, 1)}
    return dealers.top_categories(frames.dirty_sales(spark, sf), levels, "ordr_date")


@query
def missing_share(spark, sf):
    return dealers.missing_shares(frames.sales(spark, sf), ["house_no", "cont_unit_price"])


@query
def status_share_wide(spark, sf):
    return dealers.status_shares(frames.sales(spark, sf), ["3", "15", "X", "Y", "Z"])


@query
def status_share_groups(spark, sf):
    rows = frames.sales(spark, sf)
    final = F.col("ordr_status").isin("Y", "N")
    a = dealers.status_shares(rows, ["Y", "N"], final)
    b = dealers.status_shares(rows, ["3", "15", "X"], ~final)
    return b.join(a, "partner_code", "left")


def all_features(spark, sf):
    return dealers.dealer_features(frames.event_orders(spark, sf))


@query
def dealer_features(spark, sf):
    return all_features(spark, sf)


@query
def model_table(spark, sf):
    return dealers.model_table(all_features(spark, sf))


# ---- footfall ----------------------------------------------------------------


@query
def visit_prep(spark, sf):
    visits = footfall.customers(footfall.stays(footfall.prepare_visits(frames.track(spark, sf))))
    return visits.select("id", "profile_id", "store_id", "enter_date", "enter_time", "duration")


@query
def visits_of_one_shop(spark, sf):
    return footfall.of_shop(footfall.prepare_visits(frames.track(spark, sf)), "2").select(
        "id", "profile_id", "duration"
    )


@query
def visits_without_staff(spark, sf):
    return visits_of(spark, sf).select("id", "profile_id", "store_id", "duration")


@query
def unmatched_orders(spark, sf):
    orders, visits = orders_of(spark, sf), visits_of(spark, sf)
    daily = footfall.unmatched_orders(orders, visits).withColumn("kind", F.lit("shop and day"))
    ever = footfall.unmatched_orders(orders, visits, same_day=False)
    return daily.unionByName(ever.withColumn("kind", F.lit("shop"))).select("ordr_id", "kind")


@query
def visit_attribution(spark, sf):
    """Orders with every visit under way, and how long it was."""
    pairs = footfall.contained_pairs(orders_of(spark, sf), visits_of(spark, sf))
    return pairs.select("ordr_id", F.col("id").alias("visit_id"), "shop_id", "date_id", "duration")


@query
def visit_pairs_of_one_shop(spark, sf):
    """The pairs of one shop that the places stand for."""
    links = footfall.visit_links(orders_of(spark, sf), visits_of(spark, sf))
    return footfall.linked_pairs(links.filter("shop_id = '2'"))


@query
def orders_per_visit(spark, sf):
    visits = visits_of(spark, sf)
    line = footfall.timeline(visits, orders_of(spark, sf))
    return footfall.orders_per_visit(visits, line).select("id", "shop_id", "date_id", "related")


@query
def person_days(spark, sf):
    visits = visits_of(spark, sf)
    return footfall.person_days(visits, footfall.timeline(visits, orders_of(spark, sf)))


@query
def shop_traffic(spark, sf):
    return footfall.shop_traffic(visits_of(spark, sf), dates.iso_week(F.col("enter_date")))


@query
def shop_orders(spark, sf):
    return footfall.shop_orders(orders_of(spark, sf), dates.iso_week(F.col("date_id")))


@query
def related_traffic(spark, sf):
    related = footfall.related_visits(orders_of(spark, sf), visits_of(spark, sf))
    return footfall.related_traffic(related, dates.iso_week(F.col("date_id")))


@query
def shop_analysis(spark, sf):
    return footfall.shop_analysis(orders_of(spark, sf), visits_of(spark, sf), dates.iso_week)


@query
def order_visit_features(spark, sf):
    return footfall.order_visit_features(orders_of(spark, sf), visits_of(spark, sf))


@query
def monthly_uv(spark, sf):
    return footfall.visitors(footfall.stays(footfall.prepare_visits(frames.track(spark, sf))))


@query
def dedupe_shop_booth(spark, sf):
    rows = frames.shop_booths(spark, sf).select("booth_code", "shop_id", "shop_name")
    once = rows.dropDuplicates(["booth_code", "shop_id", "shop_name"])
    return shaping.first_per_key(once, ["booth_code", "shop_id"], ["shop_name"])


@query
def distinct_visit_times(spark, sf):
    visits = footfall.prepare_visits(frames.track(spark, sf))
    return visits.select(F.count_distinct("enter_time", "exit_time").alias("pairs"))


@query
def shops_only_in_sales(spark, sf):
    ids = orders_of(spark, sf).select("shop_id")
    seen = visits_of(spark, sf).filter("duration >= 300").select(F.col("store_id").alias("shop_id"))
    absent = ids.subtract(seen).withColumn("kind", F.lit("absent"))
    found = keep_matching(ids.distinct(), seen, ["shop_id"]).withColumn("kind", F.lit("present"))
    return absent.unionByName(found)


# ---- segmentation ------------------------------------------------------------


@query
def id_name_audit(spark, sf):
    rows = frames.track(spark, sf).withColumn("store_id", F.col("store_id").cast("string"))
    names = segments.names_of_ambiguous_ids(rows, "store_id", "store_name")
    ids = segments.names_of_ambiguous_ids(rows, "store_name", "store_id")
    return names.withColumn("kind", F.lit("names")).unionByName(ids.withColumn("kind", F.lit("ids")))


def ratios(spark, sf):
    return segments.shop_ratios(visits_of(spark, sf), orders_of(spark, sf), dates.iso_week)


@query
def shop_ratios(spark, sf):
    return ratios(spark, sf)


@query
def shop_ratios_scaled(spark, sf):
    return segments.min_max_scaled(ratios(spark, sf), [*segments.MEASURES, *segments.RATIOS])


@query
def shop_ratios_standardised(spark, sf):
    return segments.standardised(ratios(spark, sf), segments.RATIOS)


@query
def outlier_fences(spark, sf):
    return segments.fences(ratios(spark, sf), segments.RATIOS, ["period"])


@query
def shop_outliers(spark, sf):
    return segments.outliers(ratios(spark, sf), segments.RATIOS, ["shop_id"], ["period"])


@query
def shop_clusters(spark, sf):
    rows = segments.min_max_scaled(ratios(spark, sf), segments.RATIOS)
    out = None
    for method in ("sse", "calinski", "gaussian"):
        found, _ = learning.shop_clusters(rows, segments.RATIOS, method)
        found = found.select("shop_id", "period", "cluster").withColumn("method", F.lit(method))
        out = found if out is None else out.unionByName(found)
    return out


@query
def cross_month_test(spark, sf):
    """Shops sampled in the first weeks with their cluster, tested on a later week."""
    rows = segments.min_max_scaled(checkpointed(ratios(spark, sf)), segments.RATIOS)
    clustered, _ = learning.shop_clusters(rows.filter("period <= 2"), segments.RATIOS)
    first = clustered.groupBy("shop_id").agg(F.max_by("cluster", "period").alias("cluster"))
    train_ids, test_ids = shaping.hash_split(first, ["shop_id"], 80)
    train = keep_matching(clustered, train_ids, ["shop_id"])
    models = ensembles.fit_classifiers(train, "cluster", segments.RATIOS, ["shop_id", "period"], learning.FOLDS, learning.REPEATS)
    test = segments.next_period_test(test_ids, rows.filter("period = 3"))
    return models.predictions(test, "cluster", ["shop_id"])


# ---- learning ----------------------------------------------------------------


LINE_FEATURES = ["quantity", "price"]


def line_points(spark, sf):
    """Order lines with their return flag and two scaled features."""
    rows = frames.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag AS true_value",
        "l_quantity / 50 AS quantity", "l_extendedprice / 100000 AS price",
    )
    return rows


@query
def nearest_mean(spark, sf):
    rows = learning.nearest_mean(line_points(spark, sf), "true_value", LINE_FEATURES)
    return learning.confusion(rows)


@query
def confusion(spark, sf):
    """Order state on both sides of the lines of an order: first against any."""
    rows = frames.table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS pred_value", "if(l_returnflag = 'A', 'F', 'O') AS true_value"
    )
    return learning.confusion(rows)


@query
def agreement(spark, sf):
    rows = frames.table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS pred_value", "if(l_returnflag = 'A', 'F', 'O') AS true_value"
    )
    return learning.agreement(learning.confusion(rows))


@query
def self_training(spark, sf):
    rows = line_points(spark, sf).withColumn(
        "label", F.expr("if(l_linenumber = 1, true_value, null)")
    )
    found, _ = learning.self_training(rows, "label", LINE_FEATURES)
    return learning.confusion(found)


@query
def self_training_pairs(spark, sf):
    """Rounds and errors of self-training for all neighbouring pairs of four features."""
    rows = frames.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS true_value", "if(l_linenumber = 1, l_returnflag, null) AS label", "l_quantity / 50 AS quantity",
        "l_extendedprice / 100000 AS price", "l_discount * 10 AS discount", "l_tax * 10 AS tax",
    )
    scores, _ = learning.self_training_pairs(rows, "label", "true_value", ["quantity", "price", "discount", "tax"])
    return scores.withColumn("rounds", F.col("rounds").cast("bigint"))


@query
def rmse(spark, sf):
    """Two guesses of a line's price."""
    rows = frames.table(spark, sf, "lineitem").selectExpr(
        "l_extendedprice AS real", "l_quantity * 1000 AS by_quantity", "l_quantity * 1000 * (1 - l_discount) AS by_discount"
    )
    return learning.rmse(rows, ["by_quantity", "by_discount"], "real")


@query
def nearest_mean_error(spark, sf):
    """Error of the class means of the first lines over all lines."""
    rows = line_points(spark, sf).withColumn(
        "label", F.expr("if(l_linenumber = 1, true_value, null)")
    )
    return learning.error_rate(learning.nearest_mean(rows, "label", LINE_FEATURES), "pred_value", "true_value")


@query
def next_period_rows(spark, sf):
    """Shops of one week with a label, and their ratios of the next week."""
    rows = ratios(spark, sf).drop("uv_over_sale_count", "pv_over_sale_count", "uv_over_sale_sum", "pv_over_sale_sum")
    first = rows.filter("period = 1").select("shop_id", F.expr("cast(shop_id as bigint) % 3").alias("cluster"))
    return segments.next_period_test(first, rows.filter("period = 2"))


@query
def training_rows(spark, sf):
    """Which labelled and complete leases train, and which test."""
    rows = frames.contracts(spark, sf).select("contract_code", "category_name_1", "rentable_area", "actual_area")
    parts = learning.training_sets(rows, "category_name_1", ["rentable_area", "actual_area"], ["contract_code"])
    train, test = (part.select("contract_code", F.lit(n).alias("part")) for part, n in zip(parts, ("train", "test")))
    return train.unionByName(test)


@query
def split(spark, sf):
    """Sizes of a 90/10 split, and keys that fall on both sides (none)."""
    rows = frames.sales(spark, sf).select("ordr_id")
    train, test = shaping.hash_split(rows, ["ordr_id"], 90)
    both = keep_matching(train, test, ["ordr_id"])
    out = None
    for name, part in (("train", train), ("test", test), ("both", both)):
        found = part.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def reported(spark, sf):
    """The joined orders are written once; sums, survey and features read their columns."""
    with releasing(spark):
        rows = checkpointed(frames.sales(spark, sf).select("partner_name", *dealers.FEATURE_COLUMNS))
        sums = checkpointed(dealers.dealer_sums(rows))
    survey = tables.dealer_survey(frames.dealer_survey(spark, sf, sums))
    model = jobs.reported_sales(rows, survey, None, "1996-01-01", "1998-12-31", sums)["model"]
    dropped(rows)
    return model


@query
def classifier_folds(spark, sf):
    """Which dealers the sweep trains on, and the fold of each in every repeat."""
    train, _ = jobs.reported_training(reported(spark, sf))
    folds = ensembles.folds_of([dealers.KEY], learning.FOLDS, learning.REPEATS, learning.SEED)
    found = train.select(dealers.KEY, F.posexplode(folds).alias("repeat", "fold"))
    return found.select(dealers.KEY, F.col("repeat").cast("bigint").alias("repeat"), F.col("fold").cast("bigint").alias("fold"))


@query
def classifier_sweep(spark, sf):
    """All classifiers on the whole model table, repeated folds, scores over the held-out dealers."""
    swept = jobs.reported_models(reported(spark, sf))
    validated = F.create_map(*[F.lit(x) for pair in swept["validated"].items() for x in pair])
    return swept["scores"].withColumn("validated", validated[F.col("model")])


@query
def order_regression(spark, sf):
    shops = checkpointed(footfall.shop_analysis(orders_of(spark, sf), visits_of(spark, sf), dates.iso_week))
    last = shops.agg(F.max("period")).first()[0]
    _, _, score = jobs.order_number_model(shops, last)
    return score
