"""Store visits, their link to orders, and features per shop and per order.

Orders and visits meet on shop and day, and a busy shop-day would have orders
times visits pairs. A shop-day is reduced to one row per instant, and everything
about "visits around this order" is read from running totals over these rows. Times
are exact to the microsecond; totals run inside seconds, and what crosses a second is
carried by one row per second, so no task holds a whole shop-day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import MINUTE, SECOND, micros_of_day, minutes_between, month
from stallwise.functions.nullsafe import distinct_with_null, ratio
from stallwise.operators.intervals import blocks_of_interval, blocks_of_point
from stallwise.operators.joins import join_shuffled, keep_unmatched, null_safe_join
from stallwise.operators.ordered import with_extremes, with_running, with_running_sums
from stallwise.operators.quantiles import group_quantiles
from stallwise.session import checkpointed

# The event of a stay, minutes of a customer's stay, minutes of a counted visitor.
STAY_EVENT = 0
CUSTOMER_MINUTES = 5
COUNTED_MINUTES = 2

SHOP_DAY = ["shop_id", "date_id"]


def prepare_visits(track: DataFrame) -> DataFrame:
    """Visit log with stay in minutes, day and text shop id.

    ``enter_us``, ``exit_us`` and ``stay_us`` are microseconds; the first two
    count from midnight of the day of entry.
    """
    rows = track.withColumns(
        {c: F.col(c).cast("timestamp") for c in ("enter_time", "exit_time")}
    ).withColumns(
        {
            "duration": minutes_between(F.col("enter_time"), F.col("exit_time")),
            "enter_date": F.to_date("enter_time"),
            "store_id": F.col("store_id").cast("string"),
        }
    )
    begin = micros_of_day(F.col("enter_time"), F.col("enter_date"))
    end = micros_of_day(F.col("exit_time"), F.col("enter_date"))
    return rows.withColumns({"enter_us": begin, "exit_us": end, "stay_us": end - begin})


def stays(visits: DataFrame) -> DataFrame:
    return visits.filter(F.col("event_type") == STAY_EVENT)


def customers(visits: DataFrame, minutes: float = CUSTOMER_MINUTES) -> DataFrame:
    """Visits of at least some minutes."""
    return visits.filter(F.col("duration") >= minutes)


def without_staff(visits: DataFrame, staff: DataFrame) -> DataFrame:
    """Visits of persons that are not staff; unknown persons stay in."""
    return visits.join(staff.select("profile_id").distinct(), "profile_id", "left_anti")


def of_shop(visits: DataFrame, store_id: str, event_type: int = STAY_EVENT) -> DataFrame:
    return visits.filter((F.col("store_id") == store_id) & (F.col("event_type") == event_type))


def prepare_orders(orders: DataFrame, ts: str = "ordr_date") -> DataFrame:
    """Orders with ``order_us``, the microsecond of their day."""
    return orders.withColumn("order_us", micros_of_day(F.col(ts), F.col("date_id")))


def unmatched_orders(orders: DataFrame, visits: DataFrame, same_day: bool = True) -> DataFrame:
    """Orders without any visit in their shop (on their day)."""
    ids = visits.select(F.col("store_id").alias("shop_id"), F.col("enter_date").alias("date_id"))
    return keep_unmatched(orders, ids, SHOP_DAY if same_day else ["shop_id"])


# ---- one row per shop, day and instant ---------------------------------------


def _placed(visits: DataFrame) -> DataFrame:
    return visits.withColumnsRenamed({"store_id": "shop_id", "enter_date": "date_id"})


def timeline(visits: DataFrame, orders: DataFrame, minutes: float = CUSTOMER_MINUTES) -> DataFrame:
    """Running totals at every instant of a shop-day where something happens.

    ``inside`` visits are under way at that instant (both ends included) with
    ``inside_stay`` microseconds of stay in total; ``distance`` is the time to the
    nearest visit of at least ``minutes``; ``orders_before`` and ``orders_upto``
    count the orders of the shop-day up to the instant.
    """
    lasting = (F.col("duration") >= minutes).cast("int")
    none = F.lit(0).cast("bigint")

    def point(at: str, enters: Column, exits: Column) -> Column:
        return F.struct(
            F.col(at).alias("at"),
            enters.cast("bigint").alias("enters"),
            exits.cast("bigint").alias("exits"),
            (enters * F.col("stay_us")).cast("bigint").alias("enter_stay"),
            (exits * F.col("stay_us")).cast("bigint").alias("exit_stay"),
            (enters * lasting).cast("bigint").alias("long_enters"),
            (exits * lasting).cast("bigint").alias("long_exits"),
        )

    ends = F.array(point("enter_us", F.lit(1), F.lit(0)), point("exit_us", F.lit(0), F.lit(1)))
    from_visits = (
        _placed(visits)
        .filter("exit_us >= enter_us")
        .select(*SHOP_DAY, F.inline(ends))
        .withColumn("orders", none)
    )
    counts = ["enters", "exits", "enter_stay", "exit_stay", "long_enters", "long_exits"]
    from_orders = orders.filter("order_us is not null").select(
        *SHOP_DAY,
        F.col("order_us").alias("at"),
        *[none.alias(c) for c in counts],
        F.lit(1).cast("bigint").alias("orders"),
    )
    rows = (
        from_visits.unionByName(from_orders)
        .groupBy(*SHOP_DAY, "at")
        .agg(*[F.sum(c).alias(c) for c in [*counts, "orders"]])
    )

    rows = rows.na.drop(subset=SHOP_DAY).withColumn("second", F.floor(F.col("at") / SECOND))
    sums = {f"upto_{c}": F.col(c) for c in [*counts, "orders"]}
    rows = with_running(
        rows, SHOP_DAY, "second", "at", sums,
        {"left_at": F.when(F.col("long_exits") > 0, F.col("at"))},
        {"comes_at": F.when(F.col("long_enters") > 0, F.col("at"))},
    )

    def upto(c: str) -> Column:
        return F.col(f"upto_{c}")

    def before(c: str) -> Column:
        return upto(c) - F.col(c)

    nearest = F.least(F.col("at") - F.col("left_at"), F.col("comes_at") - F.col("at"))
    under_way = upto("long_enters") - before("long_exits") > 0
    return rows.select(
        *SHOP_DAY,
        "at",
        "orders",
        before("orders").alias("orders_before"),
        upto("orders").alias("orders_upto"),
        (upto("enters") - before("exits")).alias("inside"),
        (upto("enter_stay") - before("exit_stay")).alias("inside_stay"),
        F.when(under_way, F.lit(0)).otherwise(nearest).alias("distance"),
    )


def orders_per_visit(visits: DataFrame, line: DataFrame) -> DataFrame:
    """Visits with ``related``: the orders of the shop-day made during the visit."""
    start = line.select(*SHOP_DAY, F.col("at").alias("enter_us"), "orders_before")
    end = line.select(*SHOP_DAY, F.col("at").alias("exit_us"), "orders_upto")
    rows = _placed(visits)
    joined = join_shuffled(rows, start, [*SHOP_DAY, "enter_us"], "left")
    joined = join_shuffled(joined, end, [*SHOP_DAY, "exit_us"], "left")
    made = F.coalesce(F.col("orders_upto") - F.col("orders_before"), F.lit(0))
    related = F.when(F.col("exit_us") >= F.col("enter_us"), made).otherwise(0)
    return joined.select(*rows.columns, related.cast("bigint").alias("related"))


def person_days(visits: DataFrame, line: DataFrame) -> DataFrame:
    """Per shop, day and person: visits, stay, and orders made during the visits."""
    return (
        orders_per_visit(visits, line)
        .groupBy(*SHOP_DAY, "profile_id")
        .agg(
            F.sum("related").alias("related_sum"),
            F.count(F.lit(1)).alias("visits"),
            F.sum("stay_us").alias("stay_us"),
        )
    )


def longest_stay_around(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Longest stay among the visits under way at every instant with an order.

    Of the visits entering at one instant only the longest can win, and none can
    win that ends before one that began earlier.
    """
    longest = (
        _placed(visits)
        .filter("exit_us >= enter_us")
        .na.drop(subset=SHOP_DAY)
        .groupBy(*SHOP_DAY, "enter_us")
        .agg(F.max("exit_us").alias("exit_us"))
        .withColumn("second", F.floor(F.col("enter_us") / SECOND))
    )
    longest = with_extremes(
        longest, SHOP_DAY, "second", "enter_us", {"_ends": F.col("exit_us")}
    ).filter("_ends is null or exit_us > _ends")
    blocks = (
        longest.select(
            *SHOP_DAY,
            (F.col("exit_us") - F.col("enter_us")).alias("stay"),
            F.inline(blocks_of_interval("enter_us", "exit_us")),
        )
        .groupBy(*SHOP_DAY, "size", "block")
        .agg(F.max("stay").alias("stay"))
    )
    moments = orders.select(*SHOP_DAY, F.col("order_us").alias("at")).na.drop().distinct()
    placed = moments.select("*", F.inline(blocks_of_point("at")))
    return (
        join_shuffled(placed, blocks, [*SHOP_DAY, "size", "block"])
        .groupBy(*SHOP_DAY, "at")
        .agg(F.max("stay").alias("longest"))
    )


def contained_pairs(orders: DataFrame, visits: DataFrame) -> DataFrame:
    """Orders with each visit that was under way in their shop at their time: one row per pair."""
    covered = _placed(visits).filter("exit_us >= enter_us")
    covered = covered.select("*", F.inline(blocks_of_interval("enter_us", "exit_us")))
    placed = orders.filter("order_us is not null").select("*", F.inline(blocks_of_point("order_us")))
    return join_shuffled(placed, covered, [*SHOP_DAY, "size", "block"]).drop("size", "block")


def visit_links(orders: DataFrame, visits: DataFrame) -> DataFrame:
    """Which orders were made during which visits, without listing the pairs.

    The orders of a shop-day stand in a line by time; orders of one microsecond share a place,
    the number of orders up to then. A visit covers the places ``first`` to ``last``, an order
    is at one place (``first`` = ``last``): the order was made during the visit exactly if its
    place is covered. ``links`` counts the partners of a row. One row per order and per visit
    (``kind``); a visit without an order has ``first`` above ``last``. Orders without a time
    and visits that end before they begin have no places, rows without shop or day neither.
    """
    line = shop_day_line(visits, orders)
    at = line.select(*SHOP_DAY, F.col("at").alias("order_us"), "orders_upto", "inside")
    start = line.select(*SHOP_DAY, F.col("at").alias("enter_us"), (F.col("orders_upto") - F.col("orders")).alias("orders_before"))
    end = line.select(*SHOP_DAY, F.col("at").alias("exit_us"), F.col("orders_upto").alias("last"))
    from_orders = (
        join_shuffled(
            orders.select(*SHOP_DAY, "order_us", F.col("ordr_id").cast("string").alias("id")), at, [*SHOP_DAY, "order_us"], "left"
        )
        .select(
            F.lit("order").alias("kind"), "id", *SHOP_DAY, F.col("orders_upto").alias("first"), F.col("orders_upto").alias("last"),
            F.coalesce("inside", F.lit(0)).cast("bigint").alias("links"),
        )
    )
    valid = F.col("exit_us") >= F.col("enter_us")
    placed = _placed(visits).select(
        *SHOP_DAY, F.col("id").cast("string").alias("id"), F.when(valid, F.col("enter_us")).alias("enter_us"), F.when(valid, F.col("exit_us")).alias("exit_us")
    )
    covered = join_shuffled(join_shuffled(placed, start, [*SHOP_DAY, "enter_us"], "left"), end, [*SHOP_DAY, "exit_us"], "left")
    from_visits = (
        covered.select(
            F.lit("visit").alias("kind"), "id", *SHOP_DAY, (F.col("orders_before") + 1).alias("first"), "last",
            F.coalesce(F.col("last") - F.col("orders_before"), F.lit(0)).cast("bigint").alias("links"),
        )
    )
    return from_orders.unionByName(from_visits)


def shop_day_line(visits: DataFrame, orders: DataFrame) -> DataFrame:
    """Per shop, day and instant: the orders then and up to then, and the visits under way."""
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def point(at: str, enters: Column, exits: Column) -> Column:
        return F.struct(F.col(at).alias("at"), enters.alias("enters"), exits.alias("exits"))

    ends = F.array(point("enter_us", one, none), point("exit_us", none, one))
    from_visits = _placed(visits).filter("exit_us >= enter_us").select(*SHOP_DAY, F.inline(ends)).withColumn("orders", none)
    from_orders = orders.filter("order_us is not null").select(
        *SHOP_DAY, F.col("order_us").alias("at"), none.alias("enters"), none.alias("exits"), one.alias("orders")
    )
    counts = ["enters", "exits", "orders"]
    rows = from_visits.unionByName(from_orders).groupBy(*SHOP_DAY, "at").agg(*[F.sum(c).alias(c) for c in counts])
    rows = rows.na.drop(subset=SHOP_DAY).withColumn("second", F.floor(F.col("at") / SECOND))
    rows = with_running_sums(rows, SHOP_DAY, "second", "at", {f"upto_{c}": F.col(c) for c in counts})
    inside = F.col("upto_enters") - F.col("upto_exits") + F.col("exits")
    return checkpointed(rows.select(*SHOP_DAY, "at", "orders", F.col("upto_orders").alias("orders_upto"), inside.alias("inside")))


def linked_pairs(links: DataFrame) -> DataFrame:
    """(ordr_id, visit_id, shop_id, date_id) of all pairs that :func:`visit_links` stands for.

    As many rows as there are links: for a few shop-days, not for a whole mall.
    """
    visits = links.filter("kind = 'visit' and links > 0")
    placed = visits.select(F.col("id").alias("visit_id"), *SHOP_DAY, F.explode(F.sequence("first", "last")).alias("first"))
    orders = links.filter("kind = 'order' and links > 0").select(F.col("id").alias("ordr_id"), *SHOP_DAY, "first")
    return orders.join(placed, [*SHOP_DAY, "first"]).select("ordr_id", "visit_id", *SHOP_DAY)


def order_visit_features(
    orders: DataFrame,
    visits: DataFrame,
    keys: Sequence[str] = ("ordr_id", "prod_name", "cont_cat3_name", "act_amt"),
    minutes: float = CUSTOMER_MINUTES,
) -> DataFrame:
    """Features of the visits of an order's shop-day, per order.

    Orders whose shop had no visit that day are left out. Stays are in minutes.
    ``time_distance`` is the time to the nearest visit of at least ``minutes``
    (0 during one), ``related_person_duration_sum`` the stay of all visits by
    persons with a visit during any order of the shop-day. The bodies of these
    two are our own definition.
    """
    # Visits and orders are prepared once; the steps read the written columns.
    visits = checkpointed(
        visits.select(
            "store_id", "enter_date", "profile_id", "enter_us", "exit_us", "stay_us", "duration"
        )
    )
    orders = checkpointed(orders.select(*SHOP_DAY, "order_us", *dict.fromkeys(["ordr_id", *keys])))
    # Read three times; one row per shop, day and instant.
    line = checkpointed(timeline(visits, orders, minutes))
    people = (
        orders_per_visit(visits, line)
        .groupBy(*SHOP_DAY, "profile_id")
        .agg(
            F.sum("related").alias("related_sum"),
            F.count(F.lit(1)).alias("visits"),
            F.sum("stay_us").alias("stay_us"),
            F.max("stay_us").alias("max_stay"),
        )
    )
    shop_day = people.groupBy(*SHOP_DAY).agg(
        F.sum("visits").alias("visits"),
        F.sum("stay_us").alias("stay"),
        F.max("max_stay").alias("max_stay"),
        F.coalesce(F.sum(F.when(F.col("related_sum") > 0, F.col("stay_us"))), F.lit(0)).alias(
            "person_stay"
        ),
    )
    numbers = orders.groupBy(*SHOP_DAY).agg(F.count_distinct("ordr_id").alias("order_num_perday"))
    # Everything about the shop-day goes to the instants of its orders first, so that
    # the join with the orders themselves is on the instant and not on a busy day.
    moments = line.filter("orders > 0").select(*SHOP_DAY, "at", "inside", "inside_stay", "distance")
    moments = join_shuffled(join_shuffled(moments, shop_day, SHOP_DAY), numbers, SHOP_DAY)
    moments = join_shuffled(moments, longest_stay_around(visits, orders), [*SHOP_DAY, "at"], "left")
    rows = join_shuffled(orders, moments.withColumnRenamed("at", "order_us"), [*SHOP_DAY, "order_us"])
    minute = F.lit(float(MINUTE))
    found = rows.groupBy(*keys, "order_num_perday").agg(
        F.sum("visits").alias("visit_times"),
        F.sum("inside").alias("related_visit_times"),
        (F.max("max_stay") / minute).alias("max_duration"),
        (ratio(F.sum("stay"), F.sum("visits")) / minute).alias("mean_duration"),
        (ratio(F.sum("inside_stay"), F.sum("inside")) / minute).alias("related_mean_duration"),
        (F.max("longest") / minute).alias("related_max_duration"),
        (F.min("distance") / minute).alias("time_distance"),
        (F.sum("person_stay") / minute).alias("related_person_duration_sum"),
    )
    return found.withColumn(
        "visit_per_order", ratio(F.col("visit_times"), F.col("order_num_perday"))
    )


# ---- per shop ----------------------------------------------------------------


def _with_median_stay(found: DataFrame, visits: DataFrame, name: str) -> DataFrame:
    """Add the exact median stay in minutes per shop and period."""
    keys = ["shop_id", "period"]
    medians = group_quantiles(visits, "stay_us", [0.5], keys)
    median = medians.select(*keys, (F.col("quantiles")[0] / MINUTE).alias(name))
    return null_safe_join(found, median, keys, "left")


def shop_traffic(visits: DataFrame, period: Column) -> DataFrame:
    """Visitors (per day), entries and stays of a shop in a period."""
    rows = visits.select(
        F.col("store_id").alias("shop_id"), period.alias("period"),
        "enter_date", "profile_id", "enter_time", "stay_us",
    )
    found = rows.groupBy("shop_id", "period").agg(
        F.count_distinct(F.struct("enter_date", "profile_id")).alias("total_uv"),
        distinct_with_null(F.col("enter_time")).alias("total_pv"),
        (F.avg("stay_us") / MINUTE).alias("avg_duration"),
    )
    return _with_median_stay(found, rows, "median_duration")


def shop_orders(
    orders: DataFrame, period: Column, by: Sequence[str] = ("cont_cat3_name", "cont_main_brand_name")
) -> DataFrame:
    """Orders of a shop, category and brand in a period."""
    return orders.groupBy("shop_id", *by, period.alias("period")).agg(
        F.count(F.lit(1)).alias("order_num")
    )


def related_visits(orders: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits during an order, one per instant of entry over all shops.

    Of all order-visit combinations that share an instant of entry only the
    first (shop, day, order time, order, person) is looked at, and it is kept if
    the order falls into the visit. The first combination is the first visit of
    that instant with the first order of the shop-day, so minima are enough.
    """
    first_order = orders.groupBy(*SHOP_DAY).agg(
        F.min(F.struct("order_us", "ordr_id")).alias("order")
    )
    entries = (
        _placed(visits)
        .groupBy(*SHOP_DAY, "enter_time")
        .agg(F.min(F.struct("profile_id", "enter_us", "exit_us", "stay_us")).alias("visit"))
    )
    first = (
        entries.join(first_order, SHOP_DAY)
        .groupBy("enter_time")
        .agg(F.min(F.struct(*SHOP_DAY, "order", "visit")).alias("f"))
        .select("enter_time", "f.*")
        .select("enter_time", *SHOP_DAY, "order.*", "visit.*")
    )
    return first.filter("order_us between enter_us and exit_us")


def related_traffic(related: DataFrame, period: Column) -> DataFrame:
    """Visitors, entries and stays of a shop among the related visits."""
    rows = related.select("shop_id", period.alias("period"), "profile_id", "stay_us")
    found = rows.groupBy("shop_id", "period").agg(
        distinct_with_null(F.col("profile_id")).alias("total_related_uv"),
        F.count(F.lit(1)).alias("total_related_pv"),
        (F.avg("stay_us") / MINUTE).alias("avg_related_duration"),
    )
    return _with_median_stay(found, rows, "median_related_duration")


def shop_analysis(orders: DataFrame, visits: DataFrame, period=month) -> DataFrame:
    """Orders, traffic and related traffic of every shop and period.

    ``period`` makes the period key from a date column. Shops need all three.
    """
    keys = ["shop_id", "period"]
    return (
        shop_orders(orders, period(F.col("date_id")))
        .join(shop_traffic(visits, period(F.col("enter_date"))), keys)
        .join(related_traffic(related_visits(orders, visits), period(F.col("date_id"))), keys)
    )


def visitors(visits: DataFrame, minutes: float = COUNTED_MINUTES) -> DataFrame:
    """Distinct persons per shop, and the sum over days of distinct longer-staying ones."""
    daily = F.when(F.col("duration") > minutes, F.struct("enter_date", "pid"))
    return visits.groupBy("store_id").agg(
        distinct_with_null(F.col("pid")).alias("month_uv"),
        F.count_distinct(daily).alias("month_daily_uv"),
    )
