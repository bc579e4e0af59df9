"""Readers, writers, models, and the four jobs end to end."""

import pytest
from pyspark.sql import functions as F

from registry import frames
from stallwise.functions import dates
from stallwise.operators import ensembles, footfall, learning, segments, shaping
from stallwise.plans import jobs
from stallwise.sources import schemas, sinks, tables

SF = "/root/testdata/sf0.01"


def test_write_and_read_by_month(spark, tmp_path):
    rows = frames.sales(spark, SF).select("ordr_id", "act_amt", "month_id")
    sinks.write_by_month(rows, str(tmp_path / "m"))
    back = tables.visits_of_month(spark, str(tmp_path / "m"), "1998-03")
    assert back.count() == rows.filter("month_id = '1998-03'").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_id" in plan


def test_days_are_kept_reloaded_and_completed(spark, tmp_path):
    def rows(*of):
        return spark.createDataFrame(of, "id string, stay long, dt string")

    def kept(first="20240101", last="20240109"):
        found = tables.kept_days(spark, folder, first, last)
        return sorted((r["id"], r["stay"], r["dt"]) for r in found.collect())

    folder = str(tmp_path / "days")
    sinks.load_days(rows(("a", 1, "20240101"), ("b", 2, "20240102")), folder)
    sinks.load_days(rows(("c", 3, "20240102"), ("d", 4, "20240102")), folder)
    sinks.load_days(rows(("c", 3, "20240102"), ("d", 4, "20240102")), folder)  # once more
    assert kept() == [("a", 1, "20240101"), ("c", 3, "20240102"), ("d", 4, "20240102")]
    sinks.add_late(rows(("d", 5, "20240102"), ("d", 5, "20240102"), ("e", 6, "20240102"), ("f", 7, "20240103")), folder, ["id"])
    assert kept("20240102") == [("c", 3, "20240102"), ("d", 5, "20240102"), ("e", 6, "20240102"), ("f", 7, "20240103")]
    assert kept("20240101", "20240101") == [("a", 1, "20240101")]
    sinks.add_late(rows(("g", 8, "20240104")), str(tmp_path / "new"), ["id"])
    assert tables.kept_days(spark, str(tmp_path / "new"), "20240104", "20240104").count() == 1
    plan = tables.kept_days(spark, folder, "20240103", "20240103")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan or "PartitionFilters: [(cast(dt" in plan


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_write_and_read_table(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("0001", "1F", 1, 2)], "contract_code string, floor string, row int, col int")
    sinks.write_table(rows, str(tmp_path / fmt), fmt)
    options = {"header": True} if fmt == "csv" else {}
    back = tables.read(spark, str(tmp_path / fmt), "contract_code string, floor string, row int, col int", fmt, **options)
    assert [tuple(r) for r in back.collect()] == [("0001", "1F", 1, 2)]


def test_schemas_parse(spark):
    for name in [n for n in dir(schemas) if n.isupper()]:
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_given_table_is_not_fetched(spark):
    df = spark.range(1)
    assert tables.given_or(df, lambda: pytest.fail("fetched")) is df
    assert tables.given_or(None, lambda: df) is df


def test_sheet_codes_get_their_prefix(spark):
    names = {"mall_sale": "m", "total_sale": "t", "name": "n", "number": "no", "contact": "c"}
    rows = spark.createDataFrame([(1.0, 2.0, "a", 42, "b")], "m double, t double, n string, no int, c string")
    assert tables.dealer_sheet(rows, names).first()["partner_code"] == "0042"


def test_order_filters_reach_the_files(spark, tmp_path):
    rows = frames.sales(spark, SF).drop("l_linenumber", "l_partkey")
    sinks.write_by_month(rows, str(tmp_path / "o"))
    found = tables.mall_sales(spark.read.parquet(str(tmp_path / "o")), "ASIA", "1998-02-10", "1998-03-05")
    plan = found.select("act_amt")._jdf.queryExecution().executedPlan().toString()
    assert "(month_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "StringContains(mall_name,ASIA)" in plan and "GreaterThan(act_amt" in plan
    assert "prod_name" not in plan.split("ReadSchema")[1]
    direct = tables.mall_sales(rows, "ASIA", "1998-02-10", "1998-03-05")
    assert found.count() == direct.count() > 0


def test_category_job(spark):
    found = jobs.category_productivity(
        frames.sales(spark, SF), frames.contracts(spark, SF), frames.promotion_calendar(spark, SF),
        frames.category_dict(spark, SF), "ASIA", "1998-03-01", "1998-03-31", 1998, "1999-06-30",
        frames.OVERRIDES, "1998-01",
    )
    for name, table in found.items():
        assert table.count() > 0, name


def test_trusted_job(spark):
    names = frames.malls(spark, SF).select("partner_name").limit(5)
    rows = jobs.trusted_productivity(
        frames.sales(spark, SF), frames.contracts(spark, SF), names, "1998-03-01", "1998-05-31"
    )
    assert [r["id"] for r in rows.collect()] == list(range(1, rows.count() + 1))


def test_reported_sales_job(spark):
    survey = tables.dealer_survey(frames.dealer_survey(spark, SF))
    found = jobs.reported_sales(frames.sales(spark, SF), survey, "NATION_3", "1996-01-01", "1998-12-31")
    model = found["model"]
    assert found["features"].count() == model.count() > 0
    assert "agree_degree" in model.columns and "cont_cat3_name" not in model.columns
    assert found["trusted"].count() <= model.count()


def test_footfall_job(spark):
    found = jobs.footfall_link(
        frames.shop_orders(spark, SF), frames.track(spark, SF), frames.staff_profiles(spark, SF), dates.iso_week
    )
    assert all(t.count() > 0 for t in found.values())
    _, compared, score = jobs.order_number_model(found["shops"], 5, folds=0)
    mean = found["shops"].filter("period <> 5").agg(F.avg("order_num")).first()[0]
    naive = compared.agg(F.sqrt(F.avg(F.pow(F.col("real") - mean, 2)))).first()[0]
    assert score.first()["random_forest_predict_rmse"] < naive * 1.5


def test_segment_job(spark):
    visits = footfall.prepare_visits(frames.track(spark, SF))
    found = jobs.shop_segments(visits, frames.shop_orders(spark, SF), dates.iso_week)
    assert found["clusters"].select("cluster").distinct().count() >= 2
    scaled = found["shops"].agg(*[F.min(c) for c in segments.RATIOS], *[F.max(c) for c in segments.RATIOS]).first()
    assert list(scaled) == [0.0] * 4 + [1.0] * 4


def blobs(spark, n=300):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000
    y = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000
    return spark.range(n).select("id", (F.col("id") % 3).alias("g"), x.alias("x"), y.alias("y")).select(
        "id", F.col("g").cast("string").alias("g"), (F.col("x") + 5 * F.col("g")).alias("x"), (F.col("y") - 4 * F.col("g")).alias("y")
    )


@pytest.mark.parametrize("method", ["sse", "calinski", "gaussian"])
def test_number_of_clusters(spark, method):
    found, scores = learning.shop_clusters(blobs(spark), ["x", "y"], method, range(2, 6))
    assert set(scores) == {2, 3, 4, 5}
    if method != "gaussian":
        assert found.select("cluster").distinct().count() == 3


def test_calinski_score(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 10.0), (1, 12.0)], "c int, x double")
    # between = 2 * 25 * 2 = 100 on 1 degree, within = 4 on 2 degrees
    assert learning.between_over_within(rows, ["x"], "c") == pytest.approx(50.0)


def test_self_training_uses_few_labels(spark):
    rows = blobs(spark).withColumn("label", F.when(F.col("id") < 6, F.col("g")))
    found, rounds = learning.self_training(rows, "label", ["x", "y"])
    assert learning.error_rate(found, "pred_value", "g").first()[0] == 0.0
    assert rounds < 10


def test_nearest_mean_ignores_incomplete_rows(spark):
    rows = blobs(spark).withColumn("x", F.when(F.col("id") > 0, F.col("x")))
    found = learning.nearest_mean(rows, "g", ["x", "y"])
    assert found.filter("pred_value is null").count() == 1


def test_split_is_stable(spark):
    a = {r[0] for r in shaping.hash_split(blobs(spark), ["id"], 90)[0].select("id").collect()}
    b = {r[0] for r in shaping.hash_split(blobs(spark).repartition(7), ["id"], 90)[0].select("id").collect()}
    assert a == b


@pytest.mark.parametrize("method, ks", [("sse", [2, 3]), ("calinski", []), ("calinski", [2, 300]), ("gaussian", [1, 2])])
def test_unusable_numbers_of_clusters_are_reported(spark, method, ks):
    with pytest.raises(ValueError):
        learning.shop_clusters(blobs(spark), ["x", "y"], method, ks)


def test_reported_models_end_to_end(spark):
    """From orders and survey to scores; few folds, the query runs all."""
    from registry.frames import dealer_survey

    found = jobs.reported_sales(
        frames.sales(spark, SF), tables.dealer_survey(dealer_survey(spark, SF)), None, "1996-01-01", "1998-12-31"
    )
    swept = jobs.reported_models(found["model"], folds=2, repeats=1)
    scores = {r["model"]: r["accuracy"] for r in swept["scores"].collect()}
    assert set(scores) == set(swept["validated"]) == set(ensembles.CLASSIFIERS)
    assert all(0 <= x <= 1 for x in scores.values())
