"""Tables that many steps read are joined once; the rows are made here."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from registry import frames, queries
from stallwise import session
from stallwise.operators import dealers, footfall, shaping
from tests.test_scale import crowd

SALES = [
    ("1", "d1", "Dealer 1", dt.date(1998, 1, 2), Decimal("10.50"), "c1"),
    ("2", "d1", "Dealer 1", dt.date(1998, 1, 1), Decimal("4.25"), "c2"),
    ("3", "d1", "Other", dt.date(1998, 3, 1), None, "c1"),
    ("4", "d2", None, dt.date(1998, 2, 1), Decimal("7.00"), None),
]
COLUMNS = "ordr_id string, partner_code string, partner_name string, date_id date, act_amt decimal(18,2), cust_name string"


@pytest.fixture
def reads(spark, monkeypatch):
    """Own rows in place of the joined orders, and how often they were asked for."""
    asked = []

    def sales(session, sf):
        asked.append(sf)
        rows = spark.createDataFrame(SALES, COLUMNS)
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("booth_id", "cont_cat3_name", "house_no", "cont_unit_price", "ordr_status")} | {"ordr_date": F.col("date_id").cast("timestamp")})

    monkeypatch.setattr(frames, "sales", sales)
    return asked


def test_every_pair_is_listed(spark):
    visits, orders, v, o = crowd(spark, seed=5)
    minutes = {p[0]: (p[4] - p[3]).total_seconds() / 60 for p in visits}
    found = sorted((r["ordr_id"], r["id"], round(r["duration"], 6)) for r in footfall.contained_pairs(o, v).collect())
    expected = sorted((q[0], p[0], round(minutes[p[0]], 6)) for q in orders for p in visits if q[1] == p[1] and p[3] <= q[3] <= p[4])
    assert expected and found == expected


def test_complete_kinds_as_complete_rows(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), (None, "b", 1.0), ("a", None, 2.0), ("a", "b", float("nan")), ("a", "b", 1.0)], "x string, y string, z double")
    kinds = {"subset": ["x", "y"], "all": None}
    found = shaping.complete_kinds(rows, kinds)
    for kind, subset in kinds.items():
        mine = sorted(map(str, found.filter(F.col("kind") == kind).drop("kind").collect()))
        assert mine == sorted(map(str, shaping.complete_rows(rows, subset).collect()))
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()


def test_totals_and_survey_share_one_pass(spark, reads):
    found = {r["partner_code"]: r for r in dealers.totals_of_sums(dealers.dealer_sums(frames.sales(spark, ""))).collect()}
    assert (found["d1"]["freq"], found["d1"]["sum_act_amt"], found["d1"]["partner_name"]) == (2, 14.75 / 10000, "Other")
    assert (found["d2"]["freq"], found["d2"]["partner_name"]) == (1, None)
    reads.clear()
    queries.labelled(spark, "")
    assert len(reads) == 1


def test_facts_are_shuffled_for_facts_only(spark, monkeypatch):
    def one(spark, sf, name):
        schema = spark.createDataFrame([], frames.SCHEMAS[name]).schema
        return spark.range(1).select(*[F.col("id").cast("string").cast(f.dataType).alias(f.name) for f in schema])

    monkeypatch.setattr(frames, "table", one)
    plan = frames.sales(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 3
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_partkey" in plan and "hashpartitioning(l_suppkey" not in plan


def test_features_sums_and_survey_read_one_written_table(spark, reads):
    queries.reported(spark, "")
    assert len(reads) == 1


def test_split_booths_read_written_months(spark, monkeypatch):
    row = ("N1", "A", "c", dt.date(1998, 1, 1), 2.0)
    months = spark.createDataFrame([row], "booth_name string, booth_grade string, contract_code string, begin_date date, saleperarea double")
    monkeypatch.setattr(queries, "stall_months_of", lambda session, sf: months)
    found = queries.QUERIES["booth_many_to_many"](spark, "")
    assert sorted((r["booth_code"], r["saleperarea"]) for r in found.collect()) == [("B1", 2.0)]
    plan = queries.split_booth_months(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan


def test_queries_bound_their_tasks(spark):
    other, kept = spark.newSession(), dict(queries.QUERIES)
    queries.query(lambda spark, sf: spark.range(1))
    added = queries.QUERIES.pop("<lambda>")
    assert queries.QUERIES == kept and added(other, "").count() == 1
    assert all(other.conf.get(k) == v for k, v in session.TASK_SETTINGS.items())
