"""The four jobs: category productivity, reported sales, footfall, segmentation.

Each takes the source tables and returns its result tables by name; nothing runs
until a result is used, except the statistics that a plan needs as numbers and the
dealer features, which are written step by step.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import month
from stallwise.operators import dealers, enrich, ensembles, footfall, learning, productivity, segments
from stallwise.sources import tables


def category_productivity(
    orders: DataFrame,
    contracts: DataFrame,
    promotion_calendar: DataFrame,
    category_dict: DataFrame,
    mall: str,
    month_begin: str,
    month_finish: str,
    year: int,
    as_of: str,
    overrides: Mapping[str, str] | None = None,
    start_month: str = "2017-04",
) -> dict[str, DataFrame]:
    """Sale per square metre of one mall in all its breakdowns."""
    sales = tables.mall_sales(orders, mall)
    leases = enrich.apply_category_dict(
        tables.mall_contracts(contracts, mall), category_dict, overrides
    )
    calendar = tables.promotions(promotion_calendar)
    daily = enrich.with_contract(
        enrich.per_lease(sales, ["month_id", "date_id"], levels=()), leases
    )
    period = productivity.sale_per_area_in_period(daily, leases, month_begin, month_finish)
    stalls = productivity.stall_metrics(
        productivity.stall_months(sales, leases), start_month, as_of
    )
    return {
        "period": productivity.category_index(period),
        "brands": productivity.brand_index(productivity.brand_totals(daily)),
        "weekend": productivity.weekend_index(daily, leases, month_begin, month_finish),
        "season": productivity.seasonal_sale_per_area(daily, leases, year),
        "promotion": productivity.promotion_index(daily, leases, calendar, year),
        "stalls": stalls,
        "peers": productivity.brand_peers(stalls),
        "contracts": leases,
        "promotions": calendar,
    }


def trusted_productivity(
    orders: DataFrame,
    contracts: DataFrame,
    trusted: DataFrame,
    begin: str,
    finish: str,
    mall: str = "",
) -> DataFrame:
    """Period table of the trusted dealers' orders only, by lease category 2."""
    sales = enrich.trusted_sales(tables.mall_sales(orders, mall), trusted, begin, finish)
    leases = tables.mall_contracts(contracts, mall)
    summed = enrich.with_contract(enrich.per_lease(sales, ["month_id"]), leases)
    return productivity.sale_per_area_in_period(
        summed, leases, begin, finish, ["category_name_2"], "category_name_2"
    )


def reported_sales(
    orders: DataFrame, survey: DataFrame, city: str | None, begin: str, finish: str, sums: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Dealer features with the survey labels, the trusted dealers, and a model table.

    Without a city all orders count. ``sums`` are the :func:`dealers.dealer_sums` of all of them, where
    known; the orders must then be a written table, which every step reads without writing it again, and
    which no result reads any more.
    """
    rows = orders if city is None else dealers.city_orders(orders, city, begin, finish)
    summed = sums is not None and city is None
    totals = dealers.totals_of_sums(sums) if summed else dealers.dealer_totals(rows)
    labelled = dealers.survey_labels(totals, survey)
    features = dealers.dealer_features(rows, written=summed)
    merged = features.join(labelled, dealers.KEY, "left")
    return {
        "features": merged,
        "trusted": dealers.trusted_dealers(merged),
        "model": dealers.model_table(merged),
    }


# Columns of the model table that say what the survey says.
REPORTED = [
    dealers.KEY, "relation_record_estimate", "relation_record_estimate_value",
    "relation_record_estimate_real",
]


REPORTED_LABEL = "relation_record_estimate_real"


def reported_features(model: DataFrame) -> list[str]:
    """Every number of the model table but the survey's own."""
    return [c for c in model.columns if c not in REPORTED]


def reported_training(model: DataFrame, label: str = REPORTED_LABEL) -> tuple[DataFrame, DataFrame]:
    """Labelled and complete rows of the model table to train and to test on."""
    return learning.training_sets(model, label, reported_features(model), [dealers.KEY])


def reported_models(
    model: DataFrame,
    label: str = REPORTED_LABEL,
    folds: int = learning.FOLDS,
    repeats: int = learning.REPEATS,
) -> dict[str, object]:
    """All classifiers trained on the model table, tested on the rows held out.

    Every number of the table but the survey's own is a feature. ``scores`` has accuracy,
    kappa and Rand index per model, ``validated`` the cross-validated accuracy.
    """
    features = reported_features(model)
    train, test = reported_training(model, label)
    models = ensembles.fit_classifiers(train, label, features, [dealers.KEY], folds, repeats)
    predicted = models.predictions(test, label, [dealers.KEY])
    return {
        "models": models,
        "validated": models.accuracy,
        "predictions": predicted,
        "scores": learning.model_scores(predicted),
    }


def footfall_link(
    orders: DataFrame, track: DataFrame, staff_profiles: DataFrame, period=month
) -> dict[str, DataFrame]:
    """Visits without staff linked to orders, per shop and per order."""
    visits = footfall.without_staff(
        footfall.stays(footfall.prepare_visits(track)), tables.staff(staff_profiles)
    )
    placed = footfall.prepare_orders(orders)
    return {
        "shops": footfall.shop_analysis(placed, visits, period),
        "orders": footfall.order_visit_features(placed, visits),
        "unmatched": footfall.unmatched_orders(placed, visits),
    }


SHOP_FEATURES = [
    "total_uv", "total_pv", "median_duration", "avg_duration", "total_related_uv",
    "total_related_pv", "median_related_duration", "avg_related_duration",
]


# What names a row of the shop analysis.
SHOP_ROW = ["shop_id", "period", "cont_cat3_name", "cont_main_brand_name"]


def order_number_model(
    shops: DataFrame, test_period, folds: int = learning.FOLDS, repeats: int = learning.REPEATS
) -> tuple[ensembles.Regressors, DataFrame, DataFrame]:
    """Predict a shop's orders from its traffic; one period is held out.

    The score has each model's RMSE over the held-out period and over repeated folds of
    the others; no folds leave the second out.
    """
    rows = shops.na.drop(subset=SHOP_FEATURES)
    test = rows.filter(F.col("period") == test_period)
    train = rows.filter(F.col("period") != test_period)
    models = ensembles.fit_regressors(train, "order_num", SHOP_FEATURES, SHOP_ROW, folds, repeats)
    compared = learning.comparison(models, test, "order_num", ["shop_id"])
    score = learning.rmse(compared, [f"{m}_predict" for m in models.rmse], "real")
    if folds:
        for name, found in models.rmse.items():
            score = score.withColumn(f"{name}_validated_rmse", F.lit(found))
    return models, compared, score


def shop_segments(
    visits: DataFrame, orders: DataFrame, period=month, method: str = "calinski"
) -> dict[str, DataFrame]:
    """Shop ratios scaled to 0..1, their clusters and their outliers."""
    shops = segments.shop_ratios(visits, orders, period)
    scaled = segments.min_max_scaled(shops, [*segments.MEASURES, *segments.RATIOS])
    clustered, _ = learning.shop_clusters(scaled, segments.RATIOS, method)
    return {
        "shops": scaled,
        "clusters": clustered,
        "outliers": segments.outliers(shops, segments.RATIOS, ["shop_id"], ["period"]),
    }
