"""Distributed steps against brute force, with one key holding most rows."""

import datetime as dt
import glob
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import dealers, footfall, intervals, ordered, quantiles
from stallwise.session import RELEASE

DAY = dt.date(2019, 1, 1)
MIDNIGHT = dt.datetime(2019, 1, 1)


def test_positions_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("v"))
        laid = ordered.laid_out(df, [F.col("v").desc(), "id"])
        assert laid.select("_part").distinct().count() > 1
        rows = ordered.with_position(df, [F.col("v").desc(), "id"], "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = sorted(rows, key=lambda r: (-r["v"], r["id"]))
    assert [r["place"] for r in expected] == list(range(1, 5001))


@pytest.mark.parametrize("small", [0, 20_000])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_group_quantiles(spark, coalesce, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", max(small, 3000))
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(400)) / 7) for _ in range(4000)]
    rows += [(f"g{i % 9}", rng.random() * 10) for i in range(500)]
    rows += [(None, 1.0), (None, 2.0), ("empty", None), ("single", 3.5)]
    probs = [0, 0.125, 0.25, 0.5, 0.9, 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = spark.createDataFrame(rows, "g string, x double").repartition(6)
        found = quantiles.group_quantiles(df, "x", probs, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert {r["g"] for r in found} == set(by)
    for r in found:
        assert r["n"] == len(by[r["g"]])
        assert r["quantiles"] == pytest.approx(list(np.quantile(by[r["g"]], probs)))


def test_quantiles_of_large_and_odd_columns(spark):
    """Sketched groups: heavy tails, one value for most rows, negative and huge numbers."""
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("tail")).otherwise(F.lit("same")).alias("g"),
        F.when(F.col("id") % 2 == 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 200.0) * F.when(F.col("id") % 3 == 0, -1).otherwise(1))
        .otherwise(F.when(F.col("id") % 50 == 1, F.col("id") / 7).otherwise(F.lit(5.0))).alias("x"),
    )
    probs = [0, 0.001, 0.125, 0.25, 0.5, 0.75, 0.9999, 1]
    found = {r["g"]: r for r in quantiles.group_quantiles(rows, "x", probs, ["g"]).collect()}
    for g in ("tail", "same"):
        values = [r["x"] for r in rows.filter(F.col("g") == g).collect()]
        assert found[g]["n"] == len(values) > quantiles.SMALL
        assert found[g]["quantiles"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    plan = quantiles.group_quantiles(rows, "x", probs, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_neighbours_and_running_sums(spark):
    rng = random.Random(3)
    rows = {("hot", t) for t in rng.sample(range(5000), 1500)}
    rows |= {(f"k{rng.randrange(20)}", rng.randrange(5000)) for _ in range(300)}
    df = spark.createDataFrame(sorted(rows), "k string, at long").withColumn("seg", F.floor(F.col("at") / 250))
    near = {(r["k"], r["at"]): (r["previous"], r["next"]) for r in ordered.with_neighbours(df, ["k"], "seg", "at").collect()}
    sums = {
        (r["k"], r["at"]): r["s"]
        for r in ordered.with_running_sums(df, ["k"], "seg", "at", {"s": F.col("at") % 7}).collect()
    }
    for k in {k for k, _ in rows}:
        line = sorted(t for q, t in rows if q == k)
        total = 0
        for i, t in enumerate(line):
            total += t % 7
            assert near[(k, t)] == (line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None)
            assert sums[(k, t)] == total
    assert len(near) == len(rows)


def test_runs_and_isolated_orders(spark):
    rng = random.Random(11)
    rows = []
    for d in range(6):
        t = 0
        for _ in range(400 if d == 0 else 40):
            t += rng.choice([0, 0, 5, 100, 299, 300, 301, 4000, 86400, 100000])
            rows.append((f"d{d}", t))
    df = spark.createDataFrame([(d, MIDNIGHT + dt.timedelta(seconds=t)) for d, t in rows], "partner_code string, ordr_date timestamp")
    gaps = dealers.order_gaps(df)
    runs = {r[0]: r[1] for r in dealers.longest_run(gaps, "r").collect()}
    nozero = {r[0]: r[1] for r in dealers.longest_run(gaps, "r", zero_counts=False).collect()}
    alone = {r[0]: r["isolated"] for r in dealers.isolated_orders(gaps).collect()}

    def longest(v, ok):
        best = now = 0
        for g in v:
            now = now + 1 if ok(g) else 0
            best = max(best, now)
        return best

    for d in {d for d, _ in rows}:
        at = sorted(t for q, t in rows if q == d)
        v = [b - a for a, b in zip(at, at[1:])]
        assert runs[d] == longest(v, lambda g: g < 300)
        assert nozero[d] == longest(v, lambda g: 0 < g < 300)
        padded = [301, *v, 301]
        assert alone[d] == sum(a > 300 and b > 300 for a, b in zip(padded, padded[1:]))


def left_on_disk(spark):
    """Shuffle files and folders of checkpointed tables."""
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = {f for d in dirs for at, _, names in os.walk(d) for f in (f"{at}/{n}" for n in names) if "/shuffle_" in f}
    return files, set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/staged-*"))


def test_features_leave_nothing_that_grows(spark):
    """Shuffle files go with the step that wrote them, orders and gaps with the last step that reads them."""
    rng = random.Random(4)
    rows = [(f"d{i % 3}", MIDNIGHT + dt.timedelta(seconds=rng.randrange(900_000)), DAY, float(i), *"bchs", None, 1.0) for i in range(600)]
    types = "string, ordr_date timestamp, date_id date, act_amt double, booth_id string, cust_name string, cont_cat3_name string"
    orders = spark.createDataFrame(rows, f"partner_code {types}, ordr_status string, house_no string, cont_unit_price double")
    files, folders = left_on_disk(spark)
    features = dealers.dealer_features(orders)
    until = time.time() + 20
    while (more := left_on_disk(spark)[0] - files) and time.time() < until:
        time.sleep(0.5)
    assert not more
    made = left_on_disk(spark)[1] - folders
    assert made and all(spark.read.parquet(f).count() <= 3 for f in made)
    assert [(r["partner_code"], r["below_500_sum"] + r["over_500_sum"]) for r in features.orderBy("partner_code").collect()] == [(f"d{i}", 200) for i in range(3)]
    assert spark.conf.get(RELEASE) == "false"


def test_neighbours_take_two_shuffles(spark):
    """Only the first and last rows of the segments are shuffled again, and nothing is joined."""
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("at"), F.floor(F.col("id") / 100).alias("seg"))
    found = ordered.with_neighbours(df.repartition(4), ["k"], "seg", "at")
    rows = {r["at"]: (r["previous"], r["next"]) for r in found.collect()}
    assert rows == {i: (i - 1 if i else None, i + 1 if i < 999 else None) for i in range(1000)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_interval_blocks(spark):
    rng = random.Random(7)
    rows = [(0, 0), (0, 65535), (0, 65536), (1, 65536), (5, 4), (86000, 300000), (131071, 131072)]
    rows += [tuple(sorted((rng.randrange(90000), rng.randrange(200000)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "lo long, hi long").select(
        "lo", "hi", intervals.blocks_of_interval("lo", "hi").alias("blocks")
    )
    for r in df.collect():
        covered = []
        for size, block in r["blocks"] or []:
            covered.append((block << 2 * size, ((block + 1) << 2 * size) - 1))
        covered.sort()
        if r["hi"] < r["lo"]:
            assert not covered
            continue
        assert covered[0][0] == r["lo"] and covered[-1][1] == r["hi"]
        assert all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))


def crowd(spark, n_visits=400, n_orders=250, seed=1):
    """Visits and orders of which most fall on one shop and day."""
    rng = random.Random(seed)
    visits, orders = [], []
    for i in range(n_visits):
        shop = "hot" if rng.random() < 0.8 else f"s{rng.randrange(4)}"
        enter = MIDNIGHT + dt.timedelta(seconds=rng.randrange(36000, 40000))
        stay = rng.choice([0, 30, 299, 300, 301, 1500, 4000, 60000])
        visits.append((f"v{i:04d}", shop, f"p{rng.randrange(60):02d}", enter, enter + dt.timedelta(seconds=stay), 0))
    visits.append(("v9999", "hot", "p99", MIDNIGHT + dt.timedelta(seconds=50), MIDNIGHT, 0))
    for i in range(n_orders):
        shop = "hot" if rng.random() < 0.8 else f"s{rng.randrange(5)}"
        orders.append((f"o{i:04d}", shop, DAY, MIDNIGHT + dt.timedelta(seconds=rng.randrange(35000, 43000)), "m", "c", 1.5))
    v = spark.createDataFrame(visits, "id string, store_id string, profile_id string, enter_time timestamp, exit_time timestamp, event_type int")
    o = spark.createDataFrame(orders, "ordr_id string, shop_id string, date_id date, ordr_date timestamp, prod_name string, cont_cat3_name string, act_amt double")
    return visits, orders, footfall.prepare_visits(v), footfall.prepare_orders(o)


def test_pairs_against_nested_loop(spark):
    visits, orders, v, o = crowd(spark)
    links = footfall.visit_links(o, v).cache()
    assert links.count() == len(visits) + len(orders)
    found = sorted((r["ordr_id"], r["visit_id"]) for r in footfall.linked_pairs(links).collect())
    expected = sorted(
        (q[0], p[0]) for q in orders for p in visits if q[1] == p[1] and p[3] <= q[3] <= p[4]
    )
    assert found == expected
    for kind, n in (("order", 0), ("visit", 1)):
        counts = {r["id"]: r["links"] for r in links.collect() if r["kind"] == kind and r["links"]}
        assert counts == Counter(pair[n] for pair in expected)


def test_links_of_a_crowd_are_one_row_each(spark):
    """A third of all orders at one instant, inside every visit: the pairs are never listed."""
    n = 3000
    at = MIDNIGHT + dt.timedelta(hours=12)
    visits = [(f"v{i}", "1", "p", at - dt.timedelta(seconds=i), at + dt.timedelta(seconds=i), 0) for i in range(n)]
    orders = [(f"o{i}", "1", DAY, at + dt.timedelta(seconds=max(0, i - n // 3))) for i in range(n)]
    v = spark.createDataFrame(visits, "id string, store_id string, profile_id string, enter_time timestamp, exit_time timestamp, event_type int")
    o = spark.createDataFrame(orders, "ordr_id string, shop_id string, date_id date, ordr_date timestamp")
    links = footfall.visit_links(footfall.prepare_orders(o), footfall.prepare_visits(v)).cache()
    assert links.count() == 2 * n
    total = {r["kind"]: r["n"] for r in links.groupBy("kind").agg(F.sum("links").alias("n")).collect()}
    shifts = [max(0, i - n // 3) for i in range(n)]
    assert total["order"] == total["visit"] == sum(sum(1 for s in shifts if s <= i) for i in range(n))


def test_order_features_against_nested_loop(spark):
    visits, orders, v, o = crowd(spark, seed=2)
    found = {r["ordr_id"]: r for r in footfall.order_visit_features(o, v).collect()}
    stay = {p[0]: (p[4] - p[3]).total_seconds() for p in visits}
    related_people = {
        (p[1], p[2]) for p in visits for q in orders if q[1] == p[1] and p[3] <= q[3] <= p[4]
    }
    seen = 0
    for q in orders:
        here = [p for p in visits if p[1] == q[1]]
        if not here:
            assert q[0] not in found
            continue
        seen += 1
        r = found[q[0]]
        inside = [stay[p[0]] for p in here if p[3] <= q[3] <= p[4]]
        assert r["visit_times"] == len(here)
        assert r["related_visit_times"] == len(inside)
        assert r["order_num_perday"] == sum(x[1] == q[1] for x in orders)
        assert r["max_duration"] == pytest.approx(max(stay[p[0]] for p in here) / 60)
        assert r["mean_duration"] == pytest.approx(sum(stay[p[0]] for p in here) / len(here) / 60)
        if inside:
            assert r["related_mean_duration"] == pytest.approx(sum(inside) / len(inside) / 60)
            assert r["related_max_duration"] == pytest.approx(max(inside) / 60)
        else:
            assert r["related_mean_duration"] is None and r["related_max_duration"] is None
        away = [
            max(0, (p[3] - q[3]).total_seconds(), (q[3] - p[4]).total_seconds())
            for p in here
            if stay[p[0]] >= 300
        ]
        assert r["time_distance"] == pytest.approx(min(away) / 60) if away else r["time_distance"] is None
        people = sum(stay[p[0]] for p in here if (p[1], p[2]) in related_people)
        assert r["related_person_duration_sum"] == pytest.approx(people / 60)
    assert len(found) == seen


def test_related_visits_against_row_order(spark):
    visits, orders, v, o = crowd(spark, seed=3)
    merged = sorted(
        (q[1], q[2], q[3], q[0], p[2], p[4], p[3]) for q in orders for p in visits if q[1] == p[1]
    )
    first, kept = set(), []
    for shop, _, at, _, person, leave, enter in merged:
        if enter in first:
            continue
        first.add(enter)
        if enter <= at <= leave:
            kept.append((shop, enter, person))
    found = footfall.related_visits(o, v).collect()
    got = sorted((r["shop_id"], r["enter_time"], r["profile_id"]) for r in found)
    assert got == sorted(kept)


def test_no_pair_table_in_the_plan(spark):
    """The hot shop-day is joined second by second: no nested loop, no cartesian product."""
    _, _, v, o = crowd(spark)
    for df in (footfall.order_visit_features(o, v), footfall.visit_links(o, v)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables_of_instants_are_not_broadcast(spark):
    """Their size before a run is a guess from compressed files; a large one would go through the driver."""
    _, _, v, o = crowd(spark)
    for df in (footfall.order_visit_features(o, v), footfall.visit_links(o, v)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
