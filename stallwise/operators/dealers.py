"""Dealer behaviour features and the check of recorded against surveyed sales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.dates import MINUTE, SECOND, micros_of
from stallwise.functions.nullsafe import (
    bigger_side,
    distinct_with_null,
    in_band,
    ratio,
    safe_ln,
    safe_log10,
)
from stallwise.operators.joins import match_any
from stallwise.operators.ordered import with_neighbours, with_running_sums
from stallwise.operators.shaping import without_texts
from stallwise.session import checkpointed, dropped, releasing
from stallwise.sources.tables import valid_order

# Seconds in a day, the gap that still counts as a run, a big order.
DAY_SECONDS = 86400
SHORT_GAP = 300
BIG_ORDER = 500
# Fixed value: survey figures are in units of ten thousand.
SURVEY_UNIT = 10000
# Order states whose shares become columns, and those meaning agreement.
STATES = ["1", "12", "14", "15", "17", "19", "3", "7", "Y"]
AGREED_STATES = ["15", "3", "Y"]

RUNS = {"max_cont_hit": (SHORT_GAP, True), "max_cont_hit_nozero": (SHORT_GAP, False)}

KEY = "partner_code"
# What the features of a dealer are made of.
FEATURE_COLUMNS = [
    KEY, "ordr_date", "date_id", "act_amt", "booth_id", "cust_name", "cont_cat3_name", "ordr_status",
    "house_no", "cont_unit_price",
]


def city_orders(orders: DataFrame, city: str, begin: str, finish: str) -> DataFrame:
    """Valid orders of a period by dealers active in a city in that period.

    The orders themselves may be in any city.
    """
    period = orders.filter(valid_order("trade")).filter(
        F.col("date_id").between(F.lit(begin).cast("date"), F.lit(finish).cast("date"))
    )
    active = period.filter(F.col("mall_city_name") == city).select(KEY).distinct()
    return period.join(active, KEY, "left_semi")


def dealer_totals(orders: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """Number of orders, amount (survey unit) and name per dealer.

    With ``places`` the first step also keeps them, as one row per dealer and
    place with the first order day.
    """
    first = dealer_sums(orders, places)
    return first if places else totals_of_sums(first)


def dealer_sums(orders: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """Number of orders, exact amount and first order day per dealer, name and place."""
    return orders.groupBy(KEY, "partner_name", *places).agg(
        F.min("date_id").alias("min_date_id"),
        F.sum("act_amt").alias("sum_act_amt"),
        F.count("act_amt").alias("freq"),
    )


def totals_of_sums(sums: DataFrame) -> DataFrame:
    """:func:`dealer_totals` from the sums per dealer and name."""
    total = sums.groupBy(KEY).agg(
        F.sum("freq").alias("freq"),
        F.sum("sum_act_amt").cast("double").alias("sum_act_amt"),
        F.max("partner_name").alias("partner_name"),
    )
    return total.withColumn("sum_act_amt", F.col("sum_act_amt") / SURVEY_UNIT)


def survey_labels(totals: DataFrame, survey: DataFrame) -> DataFrame:
    """Dealers in the survey with how its estimate relates to the record.

    ``relation_record_estimate`` is 1 above, 0 equal, -1 below;
    ``relation_record_estimate_value`` the quotient, and
    ``relation_record_estimate_real`` whether it is in the accepted band.
    """
    estimates = survey.select("mall_sale_estimated", "total_sale_estimated", KEY)
    joined = totals.join(estimates, KEY)
    estimated, recorded = F.col("mall_sale_estimated"), F.col("sum_act_amt")
    return joined.withColumns(
        {
            "relation_record_estimate": bigger_side(estimated, recorded),
            "relation_record_estimate_value": ratio(estimated, recorded),
            "relation_record_estimate_real": in_band(estimated, recorded),
        }
    )


def trusted_dealers(labelled: DataFrame, lower: float = 0.75, upper: float = 1.5) -> DataFrame:
    """Labelled dealers whose record is close to the estimate."""
    share = F.round(ratio(F.col("sum_act_amt"), F.col("mall_sale_estimated")), 9)
    return labelled.filter("relation_record_estimate_real is not null").filter(
        (share < upper) & (share > lower)
    )


def survey_matches(totals: DataFrame, survey: DataFrame) -> DataFrame:
    """Dealers and survey rows with equal code, or the dealer named as firm or contact."""
    right = survey.withColumnsRenamed(
        {KEY: "survey_code", "partner_name": "survey_name"}
    )
    return match_any(
        totals,
        right,
        [(KEY, "survey_code"), ("partner_name", "survey_name"), ("partner_name", "contact_name")],
    )


def survey_points(labelled: DataFrame) -> DataFrame:
    """Logarithms of record and estimate, and which of them is bigger."""
    recorded, estimated = F.col("sum_act_amt"), F.col("mall_sale_estimated")
    return labelled.select(
        KEY,
        safe_log10(recorded).alias("recorded_log"),
        safe_log10(estimated).alias("estimated_log"),
        F.when(recorded > estimated, "sale_is_bigger")
        .when(recorded <= estimated, "claim_is_bigger")
        .alias("sale_vs_claim"),
    )


# ---- order times -------------------------------------------------------------


def order_moments(orders: DataFrame, ts: str = "ordr_date") -> DataFrame:
    """One row per dealer and instant with its number of orders, cut into minutes."""
    return (
        orders.select(KEY, micros_of(F.col(ts)).alias("at"))
        .na.drop()
        .groupBy(KEY, "at")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("minute", F.floor(F.col("at") / MINUTE))
    )


def order_gaps(orders: DataFrame, ts: str = "ordr_date") -> DataFrame:
    """Gaps to the previous order per dealer, orders of one instant counted.

    Per dealer and instant: ``gap`` seconds, exact to the microsecond, to the
    previous instant with orders (null for the first), and ``zero_gaps`` between
    the orders of that instant.
    """
    return gaps_of_moments(order_moments(orders, ts))


def gaps_of_moments(moments: DataFrame) -> DataFrame:
    """:func:`order_gaps` from :func:`order_moments`."""
    rows = with_neighbours(moments, [KEY], "minute", "at")
    return rows.select(
        KEY,
        "minute",
        "at",
        "n",
        ((F.col("at") - F.col("previous")) / SECOND).alias("gap"),
        ((F.col("next") - F.col("at")) / SECOND).alias("next_gap"),
        (F.col("n") - 1).alias("zero_gaps"),
    )


def gap_statistics(gaps: DataFrame) -> DataFrame:
    """Share of whole-day gaps, shortest gap and shortest non-zero gap per dealer.

    A dealer with one order has no gap and no row.
    """
    whole_days = F.count(F.when(F.col("gap") % DAY_SECONDS == 0, 1)) + F.sum("zero_gaps")
    number = F.count("gap") + F.sum("zero_gaps")
    shortest = F.when(F.sum("zero_gaps") > 0, F.lit(0.0)).otherwise(F.min("gap"))
    return (
        gaps.groupBy(KEY)
        .agg(
            ratio(whole_days, number).alias("reg_time_perc"),
            shortest.alias("min_time_space"),
            F.coalesce(F.min("gap"), F.lit(float(DAY_SECONDS))).alias("min_time_space_nonzero"),
            number.alias("_gaps"),
        )
        .filter("_gaps > 0")
        .drop("_gaps")
    )


def longest_runs(gaps: DataFrame, kinds: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """Longest runs of consecutive short gaps per dealer, one column per kind.

    A kind is (seconds a gap has to stay below, whether a zero gap counts).
    Every gap that does not count ends the current island; islands are numbered
    by a running count, all kinds in one pass. Gaps that are no hit add nothing to an
    island, so they share one that is none.
    """
    columns, ends, tokens = {}, {}, []
    for name, (below, zero_counts) in kinds.items():
        hit = F.coalesce(F.col("gap") < below, F.lit(False)).cast("int")
        missed = F.coalesce(F.col("gap") >= below, F.lit(False)).cast("int")
        zero = F.col("zero_gaps")
        columns[f"hits_{name}"] = hit + zero if zero_counts else hit
        columns[f"after_{name}"] = F.lit(0) if zero_counts else (zero > 0).cast("int")
        ends[f"ends_{name}"] = missed + F.col(f"after_{name}")
        tokens.append(
            F.struct(
                F.lit(name).alias("kind"),
                F.when(F.col(f"hits_{name}") > 0, F.col(f"ends_{name}") - F.col(f"after_{name}")).alias("island"),
                F.col(f"hits_{name}").cast("bigint").alias("hits"),
            )
        )
    rows = with_running_sums(gaps.withColumns(columns), [KEY], "minute", "at", ends)
    number = (F.col("gap").isNotNull().cast("int") + F.col("zero_gaps")).alias("gaps")
    islands = (
        rows.select(KEY, number, F.inline(F.array(*tokens)))
        .groupBy(KEY, "kind", "island")
        .agg(F.sum("hits").alias("hits"), F.sum("gaps").alias("gaps"))
    )
    return (
        islands.groupBy(KEY)
        .agg(
            *[F.max(F.when(F.col("kind") == n, F.col("hits"))).alias(n) for n in kinds],
            F.sum("gaps").alias("_gaps"),
        )
        .filter("_gaps > 0")
        .drop("_gaps")
    )


def longest_run(
    gaps: DataFrame, name: str, shorter_than: int = SHORT_GAP, zero_counts: bool = True
) -> DataFrame:
    """Longest run of gaps below ``shorter_than`` seconds per dealer."""
    return longest_runs(gaps, {name: (shorter_than, zero_counts)})


def isolated_orders(gaps: DataFrame, farther_than: int = SHORT_GAP) -> DataFrame:
    """Number and share of orders with no other order close by, per dealer."""
    before = F.coalesce(F.col("gap") > farther_than, F.lit(True))
    after = F.coalesce(F.col("next_gap") > farther_than, F.lit(True))
    alone = (F.col("n") == 1) & before & after
    return (
        gaps.groupBy(KEY)
        .agg(F.count(F.when(alone, 1)).alias("isolated"), F.sum("n").alias("orders"))
        .filter("orders > 1")
        .withColumn("isolated_perc", ratio(F.col("isolated"), F.col("orders")))
    )


# ---- counts ------------------------------------------------------------------


def peak_day(orders: DataFrame) -> DataFrame:
    """Most orders of a dealer on one day."""
    daily = orders.groupBy(KEY, "date_id").agg(F.count(F.lit(1)).alias("freq_per_day"))
    return daily.groupBy(KEY).agg(F.max("freq_per_day").alias("max_freq_in_day"))


def _big_orders(split: float) -> list[Column]:
    amount = F.col("act_amt")
    return [
        F.count(F.when(amount > split, 1)).alias("over_500_sum"),
        F.count(F.when(amount <= split, 1)).alias("below_500_sum"),
    ]


def _with_big_share(counts: DataFrame) -> DataFrame:
    total = F.col("over_500_sum") + F.col("below_500_sum")
    return counts.withColumn("big_sale_percentage", ratio(F.col("over_500_sum"), total))


def _booths() -> Column:
    return distinct_with_null(F.col("booth_id")).alias("num_booth")


def _missing(columns: Sequence[str]) -> list[Column]:
    return [F.avg(F.col(c).isNull().cast("int")).alias(f"missing_{c}") for c in columns]


def _states(states: Sequence[str]) -> list[Column]:
    number = [F.count(F.when(F.col("ordr_status") == s, 1)) for s in states]
    return [F.when(n > 0, ratio(n, F.count(F.lit(1)))).alias(s) for s, n in zip(states, number)]


def big_share(orders: DataFrame, split: float = BIG_ORDER) -> DataFrame:
    """Orders above and up to the split, and the share above."""
    return _with_big_share(orders.groupBy(KEY).agg(*_big_orders(split)))


def booth_count(orders: DataFrame) -> DataFrame:
    """Distinct booths per dealer; an unknown booth counts as one."""
    return orders.groupBy(KEY).agg(_booths())


def counted_features(
    orders: DataFrame, missing: Sequence[str], states: Sequence[str], split: float = BIG_ORDER
) -> DataFrame:
    """Big orders, booths, missing values and state shares of every dealer in one pass."""
    found = orders.groupBy(KEY).agg(
        *_big_orders(split), _booths(), *_missing(missing), *_states(states)
    )
    return _with_big_share(found)


def customer_entropy(orders: DataFrame, customer: str = "cust_name") -> DataFrame:
    """Entropy of the orders over customers, divided by the number of customers.

    With counts c and their total n it is (ln n - sum(c ln c) / n) / customers,
    which needs only sums per dealer.
    """
    counts = orders.groupBy(KEY, customer).agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(KEY).agg(
        F.sum("c").alias("_n"),
        F.sum(F.col("c") * safe_ln(F.col("c"))).alias("_s"),
        F.count(F.lit(1)).alias("category_num"),
    )
    entropy = safe_ln(F.col("_n")) - ratio(F.col("_s"), F.col("_n"))
    return sums.select(KEY, "category_num", ratio(entropy, F.col("category_num")).alias("cust_entropy"))


def top_categories(orders: DataFrame, levels: Mapping[str, str], ts: str) -> DataFrame:
    """Most frequent category of a dealer per level and its share of the orders.

    ``levels`` maps a level to the prefix of its share; all levels are counted in one
    pass. The category seen first wins a tie, then the name; a missing category is
    one of the categories.
    """
    entries = [
        F.struct(F.lit(level).alias("_level"), F.col(level).alias("_category")) for level in levels
    ]
    laid = orders.select(KEY, F.col(ts).alias("_ts"), F.inline(F.array(*entries)))
    counts = laid.groupBy(KEY, "_level", "_category").agg(
        F.count(F.lit(1)).alias("c"), F.min("_ts").alias("first")
    )
    best = F.min(F.struct((-F.col("c")).alias("o"), "first", "_category"))
    tops = counts.groupBy(KEY, "_level").agg(
        best.alias("best"), ratio(F.max("c"), F.sum("c")).alias("share")
    )
    wanted = []
    for level, prefix in levels.items():
        here = F.col("_level") == level
        wanted.append(F.max(F.when(here, F.col("best._category"))).alias(level))
        wanted.append(F.max(F.when(here, F.col("share"))).alias(f"{prefix}_perc_value"))
    return tops.groupBy(KEY).agg(*wanted)


def top_category(orders: DataFrame, level: str, ts: str, prefix: str) -> DataFrame:
    """Most frequent category of a dealer and its share of the orders."""
    return top_categories(orders, {level: prefix}, ts)


def missing_shares(orders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values of some columns per dealer."""
    return orders.groupBy(KEY).agg(*_missing(columns))


def status_shares(
    orders: DataFrame, states: Sequence[str] = STATES, within: Column | None = None
) -> DataFrame:
    """Share of every order state per dealer, one column per state.

    ``within`` limits numerator and denominator to a subset of the states. A
    state the dealer never had is null.
    """
    rows = orders if within is None else orders.filter(within)
    return rows.groupBy(KEY).agg(*_states(states))


def dealer_features(
    orders: DataFrame,
    ts: str = "ordr_date",
    missing: Sequence[str] = ("house_no", "cont_unit_price"),
    states: Sequence[str] = STATES,
    written: bool = False,
) -> DataFrame:
    """All behaviour features of a dealer in one row; ``written`` orders are read as they are, again and again.

    Every step is run at once and leaves one row per dealer: no two steps have their shuffle files on disk
    together, and nothing that grows with the orders is left at the end.
    """
    needed = [KEY, ts, "date_id", "act_amt", "booth_id", "cust_name", "cont_cat3_name", "ordr_status"]
    # The orders are read once; every step reads its columns of the written projection.
    rows = orders.select(*dict.fromkeys([*needed, *missing]))
    with releasing(orders.sparkSession):
        rows = rows if written else checkpointed(rows)
        moments = checkpointed(order_moments(rows, ts))
        # Read three times; one row per dealer and instant.
        gaps = checkpointed(gaps_of_moments(moments))
        dropped(moments)
        steps = [
            peak_day(rows),
            gap_statistics(gaps),
            longest_runs(gaps, RUNS),
            isolated_orders(gaps).select(KEY, "isolated_perc"),
            counted_features(rows, missing, states),
            customer_entropy(rows),
            top_category(rows, "cont_cat3_name", ts, "cat3"),
        ]
        table, *pieces = [checkpointed(step) for step in steps]
    dropped(gaps)
    if not written:
        dropped(rows)
    for piece in pieces:
        table = table.join(piece, KEY, "left")
    return table


def model_table(features: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """Features for a model: agreement degree instead of states, no texts or estimates."""
    agreed = sum(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in AGREED_STATES if s in states)
    slim = features.withColumn("agree_degree", agreed).drop(
        *states, "mall_sale_estimated", "total_sale_estimated"
    )
    return without_texts(slim, keep=[KEY])
