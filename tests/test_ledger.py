"""Small hand-made frames for the rules where null, order or bounds decide."""

import datetime as dt
from math import log

import pytest
from pyspark.sql import functions as F

from stallwise.functions import dates, nullsafe, texts
from stallwise.operators import dealers, enrich, floors, footfall, productivity, quantiles, segments, shaping
from stallwise.operators.joins import null_safe_join, unique_on
from stallwise.sources import tables


def values(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def one(df):
    return df.first()[0]


def day(text):
    return dt.date.fromisoformat(text)


def orders_at(spark, seconds, dealer="d"):
    start = dt.datetime(2017, 5, 1)
    rows = [(dealer, start + dt.timedelta(seconds=s)) for s in seconds]
    return spark.createDataFrame(rows, "partner_code string, ordr_date timestamp")


def from_gaps(gaps):
    at = [0]
    for g in gaps:
        at.append(at[-1] + g)
    return at


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, None)], "k int, x double")
    found = df.groupBy("k").agg(nullsafe.strict_sum(F.col("x")).alias("s"))
    assert values(found, "k", "s") == [(1, 3.0), (2, None)]


def test_strict_least_and_greatest(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    found = df.select(nullsafe.strict_least(a, b).alias("l"), nullsafe.strict_greatest(a, b).alias("g"))
    assert values(found, "l", "g") == [(1, 2), (None, None)]


def test_ratio_has_no_infinity(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    found = df.select(nullsafe.ratio(F.col("a"), F.col("b")).alias("r"))
    assert values(found, "r") == [(0.25,), (None,), (None,)]


def test_null_keys_match_only_on_request(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 5), ("a", 6)], "k string, y int")
    assert values(left.join(right, "k"), "x", "y") == [(2, 6)]
    assert values(null_safe_join(left, right, ["k"]), "k", "x", "y") == [("a", 2, 6), (None, 1, 5)]


def test_distinct_with_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    assert one(df.agg(nullsafe.distinct_with_null(F.col("c")))) == 2


def test_valid_order_rules(spark):
    rows = [("OMS", "Y", 0, 5), ("OMS", "3", 9, 5), ("POS", "7", 1, 5), ("POS", None, 1, 5), ("POS", "3", 0, 0)]
    df = spark.createDataFrame(rows, "type string, ordr_status string, trade_amt int, act_amt int")
    assert df.filter(tables.valid_order("trade")).count() == 3
    assert values(df.filter(tables.valid_order("status")), "type", "ordr_status") == [("OMS", "3"), ("OMS", "Y")]


def test_backfill_keeps_all_rows(spark):
    cols = "category_name_1 string, category_name_2 string, category_name_3 string, cont_cat1_name string, cont_cat2_name string, cont_cat3_name string"
    rows = [("a", "b", "c", "x", "y", "z"), (" ", "b", "c", "x", "y", "z"), ("a", "b", "c", None, "y", "z"), (None,) * 6]
    found = enrich.fill_categories(spark.createDataFrame(rows, cols))
    assert found.count() == 4
    assert ("x", "y", "z", "x", "y", "z") in values(found, *found.columns)
    assert ("a", "b", "c", "a", "b", "c") in values(found, *found.columns)


def test_mode_tie_takes_lowest(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    assert one(df.agg(F.mode("c", True))) == "a"


def test_top_category_tie_takes_first_seen(spark):
    rows = [("d", t, c) for t, c in ((1, "x"), (2, "y"), (3, "y"), (4, "x"))]
    df = spark.createDataFrame(rows, "partner_code string, t int, cat string")
    assert values(dealers.top_category(df, "cat", "t", "cat"), "cat", "cat_perc_value") == [("x", 0.5)]


def test_top_category_counts_missing(spark):
    rows = [("d", 1, None), ("d", 2, None), ("d", 3, "x")]
    df = spark.createDataFrame(rows, "partner_code string, t int, cat string")
    found = dealers.top_category(df, "cat", "t", "cat").first()
    assert found["cat"] is None and found["cat_perc_value"] == pytest.approx(2 / 3)


def test_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 9)], "x double")
    assert quantiles.breaks(df, "x", [0.125, 0.25]) == [1.5, 2.0]


def test_octile_bucket(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5, 9.0, 10.0)], "x double")
    points = [float(i) for i in range(1, 10)]
    found = [r[0] for r in df.select(nullsafe.bucket(F.col("x"), points)).collect()]
    assert found == [None, 1, 2, 8, None]
    lowest = [r[0] for r in df.select(nullsafe.bucket(F.col("x"), points, True)).collect()]
    assert lowest == [1, 1, 2, 8, None]
    low, high = nullsafe.bucket_bounds(F.lit(2), points)
    assert tuple(df.select(low, high).first()) == (2.0, 3.0)


def test_promotion_length(spark):
    rows = [("2017-05-01 10:00", "2017-05-01"), ("2017-05-01", "2017-05-15"), ("2017-05-01", "2017-05-16"), ("soon", "2017-05-02")]
    found = tables.promotions(spark.createDataFrame(rows, "prom_begin_time string, date string"))
    assert values(found, "end_date") == [(day("2017-05-01"),), (day("2017-05-15"),)]


def test_promotion_flag_includes_both_ends(spark):
    promo = spark.createDataFrame([(day("2017-05-02"), day("2017-05-03")), (day("2017-05-09"), day("2017-05-08"))], "begin_date date, end_date date")
    rows = spark.createDataFrame([(day(f"2017-05-0{i}"),) for i in range(1, 10)], "date_id date")
    found = enrich.flag_promotion(rows, promo).filter("onsale")
    assert values(found, "date_id") == [(day("2017-05-02"),), (day("2017-05-03"),)]


def test_quarter_weight(spark):
    rows = [("a", 89.0, day("2017-01-01"), day("2017-03-31")), ("b", 89.0, day("2017-03-31"), day("2017-12-31"))]
    df = spark.createDataFrame(rows, "contract_code string, actual_area double, begin_date date, finish_date date")
    found = productivity.quarter_area(df, 2017)
    assert values(found, "contract_code", "Q1_area") == [("a", 89.0), ("b", 0.0)]
    all_cols = found.select([F.col(f"{q}_area") for q in productivity.QUARTERS])
    assert all(0 <= x <= 89 for r in all_cols.collect() for x in r)
    counted = productivity.quarter_area(df, 2017, inclusive=True)
    assert values(counted, "contract_code", "Q1_area")[1][1] == pytest.approx(89 / 90)


def test_one_order_dealer_has_no_gap_row(spark):
    gaps = dealers.order_gaps(orders_at(spark, [5]))
    assert dealers.gap_statistics(gaps).count() == 0
    assert dealers.longest_run(gaps, "r").count() == 0
    assert dealers.isolated_orders(gaps).count() == 0


def test_longest_run(spark):
    gaps = dealers.order_gaps(orders_at(spark, from_gaps([10, 0, 400, 5, 5, 5])))
    assert one(dealers.longest_run(gaps, "r").select("r")) == 3
    assert one(dealers.longest_run(gaps, "r", zero_counts=False).select("r")) == 3


def test_run_over_midnight(spark):
    gaps = dealers.order_gaps(orders_at(spark, [86390, 86395, 86400 + 1, 86400 + 5]))
    assert one(dealers.longest_run(gaps, "r").select("r")) == 3


def test_isolated_orders(spark):
    gaps = dealers.order_gaps(orders_at(spark, from_gaps([400, 10, 500])))
    assert values(dealers.isolated_orders(gaps), "isolated", "orders") == [(2, 4)]


def test_gap_statistics(spark):
    gaps = dealers.order_gaps(orders_at(spark, from_gaps([0, 86400, 30])))
    found = dealers.gap_statistics(gaps).first()
    assert (found["min_time_space"], found["min_time_space_nonzero"]) == (0, 30)
    assert found["reg_time_perc"] == pytest.approx(2 / 3)


def test_only_zero_gaps(spark):
    found = dealers.gap_statistics(dealers.order_gaps(orders_at(spark, [7, 7, 7]))).first()
    assert (found["min_time_space"], found["min_time_space_nonzero"], found["reg_time_perc"]) == (0, 86400, 1.0)


def test_entropy(spark):
    df = spark.createDataFrame([("d", c) for c in "aabb"], "partner_code string, cust_name string")
    assert dealers.customer_entropy(df).first()["cust_entropy"] == pytest.approx(log(2) / 2)


def test_agree_degree_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("d", None, None, None, 1.0, "t")], "partner_code string, `15` double, `3` double, Y double, x double, t string")
    found = dealers.model_table(df)
    assert found.first()["agree_degree"] == 0.0
    assert found.columns == ["partner_code", "x", "agree_degree"]


def test_band_and_label_bounds(spark):
    df = spark.createDataFrame([(0.8, 1.0), (1.8, 1.0), (1.0, 1.0), (0.81, 1.0), (None, 1.0)], "e double, r double")
    found = df.select(nullsafe.in_band(F.col("e"), F.col("r")).alias("b"), nullsafe.bigger_side(F.col("e"), F.col("r")).alias("s"))
    assert [tuple(r) for r in found.collect()] == [(0, -1), (1, 1), (1, 0), (1, -1), (None, None)]


def test_texts(spark):
    df = spark.createDataFrame([("10423", "三楼A"), ("9934", "A")], "n string, b string")
    found = df.select(texts.zero_padded(F.lit("p"), F.col("n")), texts.floor_mark(F.col("b")))
    assert [tuple(r) for r in found.collect()] == [("p10423", "三楼"), ("p09934", None)]
    none = df.select(texts.prefixed(F.lit("p"), F.lit(None)), texts.lines(F.lit("a"), F.lit(None), F.lit("b")))
    assert tuple(none.first()) == (None, "a\nb")


def test_code_repair(spark):
    rows = [("", "x方太y"), (" ", "other"), ("7", "方太"), (None, "方太")]
    df = spark.createDataFrame(rows, "contract_code string, shop_name string")
    assert values(enrich.repair_contract_code(df), "contract_code") == [(" ",), ("0203010009892",), ("7",)]


def test_split_cells(spark):
    df = spark.createDataFrame([("a/b", "1/2"), ("c", "3")], "x string, y string")
    assert values(shaping.split_cells(df, ["x", "y"]), "x", "y") == [("a", "1"), ("b", "2"), ("c", "3")]


def test_relabel_does_not_chain(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "c int")
    found = shaping.relabel(df, "c", {1: 3, 2: 1, 3: 2})
    assert [r[0] for r in found.collect()] == [3, 1, 2, 4]


def test_containment_includes_both_ends(spark):
    visit = [("v", "1", "p", dt.datetime(2019, 1, 1, 10), dt.datetime(2019, 1, 1, 11), 0)]
    track = spark.createDataFrame(visit, "id string, store_id string, profile_id string, enter_time timestamp, exit_time timestamp, event_type int")
    at = [dt.datetime(2019, 1, 1, 10), dt.datetime(2019, 1, 1, 11), dt.datetime(2019, 1, 1, 11, 0, 1)]
    rows = [(str(i), "1", day("2019-01-01"), t) for i, t in enumerate(at)]
    orders = spark.createDataFrame(rows, "ordr_id string, shop_id string, date_id date, ordr_date timestamp")
    pairs = footfall.linked_pairs(footfall.visit_links(footfall.prepare_orders(orders), footfall.prepare_visits(track)))
    assert values(pairs, "ordr_id") == [("0",), ("1",)]


def test_dedupe_comes_before_the_filter(spark):
    enter = dt.datetime(2019, 1, 1, 10)
    visits = [("a", "1", "p", enter, dt.datetime(2019, 1, 1, 11), 0), ("b", "2", "q", enter, dt.datetime(2019, 1, 1, 11), 0)]
    track = spark.createDataFrame(visits, "id string, store_id string, profile_id string, enter_time timestamp, exit_time timestamp, event_type int")
    rows = [("x", "1", day("2019-01-01"), dt.datetime(2019, 1, 1, 9)), ("y", "2", day("2019-01-01"), dt.datetime(2019, 1, 1, 10, 30))]
    orders = spark.createDataFrame(rows, "ordr_id string, shop_id string, date_id date, ordr_date timestamp")
    assert footfall.related_visits(footfall.prepare_orders(orders), footfall.prepare_visits(track)).count() == 0


def test_matched_and_unmatched_are_all(spark):
    orders = spark.createDataFrame([("1", day("2019-01-01")), ("2", day("2019-01-01"))], "shop_id string, date_id date")
    visits = spark.createDataFrame([("1", day("2019-01-01")), ("2", day("2019-01-02"))], "store_id string, enter_date date")
    assert values(footfall.unmatched_orders(orders, visits), "shop_id") == [("2",)]
    assert footfall.unmatched_orders(orders, visits, same_day=False).count() == 0


def test_duplicate_dimension_is_reported(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        unique_on(df, ["k"])


def test_layout_has_a_row_per_cell(spark):
    plan = floors.layout_of(spark, "1F", [["a", None, "b"], ["c", "a", None]])
    stalls = spark.createDataFrame([("a", "A", "s", 3)], "contract_code string, booth_grade string, series_name string, v int")
    found = floors.heat_grid(plan, stalls.withColumn("begin_date", F.lit(1)), value="v", on="contract_code")
    assert found.count() == 6
    assert found.filter("value = 3 and label = 's' and grade = 'A'").count() == 2
    assert found.filter("value = 0 and label = '' and grade = ''").count() == 4


def test_names_of_ambiguous_ids(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "c")], "id string, name string")
    assert values(segments.names_of_ambiguous_ids(df, "id", "name"), "id", "name") == [("1", "a"), ("1", "b")]
    assert values(segments.names_of_ambiguous_ids(df, "name", "id"), "name", "id") == [("b", "1"), ("b", "2")]


def test_weekend_and_quarter(spark):
    df = spark.createDataFrame([(day("2018-07-06"),), (day("2018-07-07"),)], "d date")
    found = df.select(dates.weekend_label(F.col("d")), dates.quarter_label(F.col("d")), dates.day_name(F.col("d")))
    assert [tuple(r) for r in found.collect()] == [("weekday", "Q3", "Friday"), ("weekend", "Q3", "Saturday")]


def test_event_table_gaps(spark):
    rows = [(1, 2), (1, 3), (1, 5), (2, 2), (2, 5), (2, 8), (2, 17), (3, 3), (3, 5)]
    df = spark.createDataFrame([(str(s), dt.datetime.fromtimestamp(p, dt.timezone.utc)) for s, p in rows], "partner_code string, ordr_date timestamp")
    found = dealers.order_gaps(df).filter("gap is not null").groupBy("partner_code").agg(F.sum("gap").alias("s"))
    assert values(found, "partner_code", "s") == [("1", 3), ("2", 15), ("3", 2)]


def test_gaps_below_a_second(spark):
    at = [0, 299_999_999, 599_999_999, 599_999_999, 599_999_999 + 1]
    rows = [("d", dt.datetime(2019, 1, 1) + dt.timedelta(microseconds=m)) for m in at]
    gaps = dealers.order_gaps(spark.createDataFrame(rows, "partner_code string, ordr_date timestamp"))
    assert [r["gap"] for r in gaps.orderBy("at").collect()] == [None, 299.999999, 300.0, 0.000001]
    assert one(dealers.longest_run(gaps, "r").select("r")) == 2  # the zero gap and the one after it
    found = dealers.gap_statistics(gaps).first()
    assert (found["min_time_space"], found["min_time_space_nonzero"]) == (0.0, 0.000001)


def test_containment_to_the_microsecond(spark):
    enter, leave = dt.datetime(2019, 1, 1, 10, 0, 0, 500), dt.datetime(2019, 1, 1, 11, 0, 0, 500)
    track = spark.createDataFrame(
        [("v", "1", "p", enter, leave, 0)],
        "id string, store_id string, profile_id string, enter_time timestamp, exit_time timestamp, event_type int",
    )
    tick = dt.timedelta(microseconds=1)
    rows = [(str(i), "1", day("2019-01-01"), t) for i, t in enumerate([enter - tick, enter, leave, leave + tick])]
    orders = footfall.prepare_orders(spark.createDataFrame(rows, "ordr_id string, shop_id string, date_id date, ordr_date timestamp"))
    visits = footfall.prepare_visits(track)
    assert values(footfall.linked_pairs(footfall.visit_links(orders, visits)), "ordr_id") == [("1",), ("2",)]
    line = footfall.timeline(visits, orders)
    assert footfall.orders_per_visit(visits, line).first()["related"] == 2
    assert sorted(r["distance"] for r in line.filter("orders > 0").collect()) == [0, 0, 1, 1]


def test_a_code_with_two_leases_counts_once_for_each(spark):
    lease = "contract_code string, booth_code string, actual_area double, category_name_1 string, category_name_3 string"
    rest = ["floor_name", "booth_name", "booth_grade", "brand_name", "series_name", "begin_date", "finish_date"]
    leases = spark.createDataFrame([("c", "B1", 4.0, "x", "y"), ("c", "B2", 4.0, "x", "y")], lease)
    leases = leases.withColumns({c: F.lit(None).cast("string") for c in rest} | {"contract_duration": F.lit(1)})
    order = "contract_code string, month_id string, house_no string, shop_name string, shop_id string, cont_cat3_name string, act_amt decimal(18,2)"
    from decimal import Decimal

    orders = spark.createDataFrame([("c", "2018-01", "h", "s", "1", "z", Decimal(100))], order)
    found = productivity.stall_months(orders, leases)
    assert values(found, "booth_code", "sale", "order_num") == [("B1", 100.0, 1), ("B2", 100.0, 1)]


def test_any_match_keeps_rows_without_a_code(spark):
    totals = spark.createDataFrame([("D1", "X"), ("C9", "W"), ("D3", " ")], "partner_code string, partner_name string")
    survey = spark.createDataFrame(
        [(None, "X", None), ("C9", "Z", None), ("C9", "Y", "W"), (" ", " ", " ")],
        "partner_code string, partner_name string, contact_name string",
    )
    found = values(dealers.survey_matches(totals, survey), "partner_code", "survey_name")
    assert found == [("C9", "Y"), ("C9", "Z"), ("D1", "X")]


def test_split_booth_sum_is_strict(spark):
    rows = spark.createDataFrame(
        [("B1", "B1", "A", "c", day("2018-01-01"), 5.0), ("B1", "B1", "A", "c", day("2018-01-01"), None), ("B2", "B2", "A", "d", day("2018-01-01"), 5.0)],
        "booth_code string, booth_name string, booth_grade string, contract_code string, begin_date date, saleperarea double",
    )
    found = floors.stalls_by_split_booth(rows, floors.booth_dictionary(rows))
    assert values(found, "booth_code", "saleperarea") == [("B1", None), ("B2", 5.0)]
