"""Models grown together, nearest classes and self-training, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import ensembles, histograms, learning, nearest


def blobs(spark, n=300):
    x = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000
    y = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000
    return spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("g"), (x + 5 * (F.col("id") % 3)).alias("x"), (y - 4 * (F.col("id") % 3)).alias("y"))


# ---- trees ---------------------------------------------------------------------


def brute_tree(rows, depth, classes, node=1, out=None):
    """(feature, cut, counts) per node of a greedy tree over binned rows [(bins, label)]."""
    out = {} if out is None else out
    counts = [sum(1 for _, y in rows if y == k) for k in range(classes)]
    out[node] = (-1, 0, counts)

    def purity(c):
        return sum(x * x for x in c) / sum(c)

    best = (1e-9 * max(1, sum(counts)), None)
    for f in range(len(rows[0][0]) if depth else 0):
        for cut in sorted({b[f] for b, _ in rows}):
            parts = [[r for r in rows if (r[0][f] <= cut) == side] for side in (True, False)]
            if all(parts):
                found = [[sum(1 for _, y in p if y == k) for k in range(classes)] for p in parts]
                gain = purity(found[0]) + purity(found[1]) - purity(counts)
                if gain > best[0]:
                    best = (gain, (f, cut, parts))
    if best[1]:
        f, cut, parts = best[1]
        out[node] = (f, cut, counts)
        for side, part in enumerate(parts):
            brute_tree(part, depth - 1, classes, 2 * node + side, out)
    return out


def test_every_fold_has_the_tree_that_a_plain_loop_grows(spark):
    rng = random.Random(4)
    data = [([rng.randint(-1, 6) for _ in range(3)], rng.randint(0, 2), [rng.randint(0, 2), rng.randint(0, 2)]) for _ in range(120)]
    rows = spark.createDataFrame(data, "bins array<int>, y int, folds array<int>").repartition(5)
    runs = ensembles.Runs(3, 2)
    trees = ensembles.grow(rows, runs.count, 3, runs.trains("lane"), [f"if(y = {k}, 1, 0)" for k in range(3)], ensembles.gini, ensembles.all_rows)
    for run in range(runs.count):
        mine = [(b, y) for b, y, folds in data if run == 0 or folds[(run - 1) // 3] != (run - 1) % 3]
        for node, (feature, cut, counts) in brute_tree(mine, 3, 3).items():
            assert trees.feature[run][node] == feature and trees.sums[run][node] == counts
            assert feature < 0 or trees.cut[run][node] == cut


def test_forests_look_at_some_features_only(spark):
    data = [([i % 5, i % 7, i % 3, i % 2], i % 2) for i in range(200)]
    rows = spark.createDataFrame(data, "bins array<int>, y int")
    trees = ensembles.grow(rows, 40, 1, "true", ["if(y = 0, 1, 0)", "if(y = 1, 1, 0)"], ensembles.gini, ensembles.all_rows, "if(lane < 20, 4, 1)", 3)
    assert all(trees.feature[lane][1] == 3 for lane in range(20))
    assert len({trees.feature[lane][1] for lane in range(20, 40)}) > 1


def labelled_bins(spark, n=600, parts=4):
    """Rows of three classes with bins, folds, draws and units."""
    h = lambda seed, mod: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(mod)).cast("int")
    rows = spark.range(n).select("id", h(0, 3).alias("y"), F.array(h(1, 9) - 1, h(2, 7) + h(0, 3), h(3, 4), h(4, 9)).alias("bins"), h(5, 1 << 30).cast("bigint").alias("units"))
    return rows.withColumns({"folds": ensembles.folds_of(["id"], 3, 2, 1), "draws": ensembles.draws_of(["id"], 2, 1)}).repartition(parts).cache()


def test_lanes_add_what_their_sql_says(spark):
    """Counts, sums and residuals in tasks' arrays give the trees of the same sums in SQL."""
    rows, runs = labelled_bins(spark), ensembles.Runs(3, 2)
    width = 3
    run, drawn = f"cast(lane div {width} as int)", f"if(lane % {width} = 0, 1, draws[cast(lane % {width} as int) - 1])"
    counts, few, n = f"{runs.trains(run)} and {drawn} > 0", f"if(lane % {width} > 1, 2, 4)", runs.count * width
    for adds, stats, score, size in [
        (histograms.class_counts, [f"if(y = {k}, {drawn}, 0)" for k in range(3)], ensembles.gini, ensembles.all_rows),
        (histograms.count_and_sum, [drawn, f"{drawn} * units"], ensembles.squares, ensembles.first_sum),
    ]:
        mine = ensembles.grow_lanes(rows, n, 3, adds(runs.lanes(width)), len(stats), score, size, few, 5)
        assert mine == ensembles.grow(rows, n, 3, counts, stats, score, size, few, 5)
    rows = rows.withColumn("chances", F.expr(f"transform(sequence(0, {n - 1}), l -> pmod(xxhash64(id, l), 1000) / 1000)"))
    mine = ensembles.grow_lanes(rows, n, 2, histograms.what_is_left(runs.lanes(3), 1 << 30), 3, ensembles.squares, ensembles.first_sum)
    left = ["1", f"round({1 << 30} * (if(y = lane % 3, 1, 0) - chances[lane]))", f"round({1 << 30} * chances[lane] * (1 - chances[lane]))"]
    assert mine == ensembles.grow(rows, n, 2, runs.trains(run), left, ensembles.squares, ensembles.first_sum)


@pytest.mark.parametrize("limit", [1 << 17, 50])
def test_tasks_send_sums_and_not_rows(spark, monkeypatch, limit):
    """What leaves a slab is at most one row a cell, and the rows lie in few files."""
    monkeypatch.setattr(histograms, "SLAB_ROWS", limit)
    rows, runs = labelled_bins(spark, 6000, 2), ensembles.Runs(3, 2)
    none = ensembles.Trees.empty(21, 1)
    tasks = histograms.cells(21, 0, *none.splits(), 3, histograms.class_counts(runs.lanes(3)), {})
    found = rows.select("bins", "y", "folds", "draws").mapInArrow(tasks, "lane int, node int, feature int, bin int, s0 long, s1 long, s2 long").cache()
    if limit > 6000:
        assert found.count() <= 2 * 21 * (9 + 9 + 4 + 9)
    sums = found.groupBy("lane", "feature").agg((F.sum("s0") + F.sum("s1") + F.sum("s2")).alias("n"))
    assert {r["n"] for r in sums.filter("lane = 0").collect()} == {6000}
    assert 1 < len(ensembles.spread_out(rows, 1271, 40).inputFiles()) <= 16  # two a core
    assert len(ensembles.spread_out(rows.limit(100), 1271, 4).inputFiles()) == 1


def test_written_orders_are_not_written_again(spark, monkeypatch):
    from registry import queries
    from stallwise.operators import dealers

    plain, columns = dealers.checkpointed, []
    monkeypatch.setattr(dealers, "checkpointed", lambda df: columns.append(df.columns) or plain(df))
    assert queries.reported(spark, "/root/testdata/sf0.001").count() > 0
    assert columns and not any("house_no" in c for c in columns)


def test_bins(spark):
    rows = spark.createDataFrame([(float(i), None if i < 3 else 1.0) for i in range(64)], "a double, b double")
    breaks = ensembles.breaks_of(rows, ["a", "b"])
    assert len(breaks["a"]) == 31 and breaks["b"] == [1.0]
    found = [r[0] for r in rows.orderBy("a").select(ensembles.bins_of(breaks)).collect()]
    assert [b[0] for b in found] == [min(31, max(0, (i * 32 - 1) // 63)) if i else 0 for i in range(64)] or sorted({b[0] for b in found}) == list(range(32))
    assert [b[1] for b in found] == [-1] * 3 + [0] * 61


def test_folds_and_draws(spark):
    rows = spark.range(20_000).select("id", ensembles.folds_of(["id"], 10, 3, 1).alias("f"), ensembles.draws_of(["id"], 4, 1).alias("d"))
    sizes = rows.select(F.posexplode("f").alias("r", "fold")).groupBy("r", "fold").count().collect()
    assert len(sizes) == 30 and all(1800 < r["count"] < 2200 for r in sizes)
    draws = {r["d"]: r["count"] for r in rows.select(F.explode("d").alias("d")).groupBy("d").count().collect()}
    assert all(abs(draws[k] / 80_000 - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(4))


SMALL = ensembles.Settings(depth=3, trees=4, boosts=3)


def test_all_classifiers_on_three_classes(spark):
    train, test = learning.training_sets(blobs(spark), "g", ["x", "y"], ["id"])
    models = ensembles.fit_classifiers(train, "g", ["x", "y"], ["id"], 4, 2, SMALL)
    assert set(models.accuracy) == set(ensembles.CLASSIFIERS) and all(a > 0.9 for a in models.accuracy.values())
    found = models.predictions(test, "g", ["id"]).cache()
    assert found.count() == 5 * test.count()
    for name in ensembles.CLASSIFIERS:
        score = learning.agreement(learning.confusion(found.filter(F.col("model") == name))).first()
        assert score["accuracy"] > 0.9 and score["kappa"] > 0.85


def test_accuracy_is_that_of_the_rows_left_out(spark):
    """Labels without any pattern: a model that saw its test rows would do far better than chance."""
    rows = spark.range(300).select("id", (F.pmod(F.xxhash64("id"), F.lit(2))).cast("string").alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    models = ensembles.fit_classifiers(rows, "g", ["x", "y"], ["id"], 5, 1, SMALL)
    assert all(0.35 < a < 0.65 for a in models.accuracy.values())


def test_classifiers_do_not_depend_on_the_layout(spark):
    rows = blobs(spark).withColumn("x", F.col("x") * F.when(F.col("id") % 7 > 0, 1.0).otherwise(-1.0))
    a, b = (ensembles.fit_classifiers(r, "g", ["x", "y"], ["id"], 2, 1, SMALL) for r in (rows, rows.repartition(9, "y")))
    assert a.trees == b.trees and a.rounds == b.rounds
    assert a.accuracy == pytest.approx(b.accuracy)


def test_odd_rows_for_classifiers(spark):
    rows = blobs(spark, 60).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("x"))).withColumn("g", F.when(F.col("id") % 9 > 0, F.col("g")))
    models = ensembles.fit_classifiers(rows.unionByName(rows), "g", ["x", "y"], ["id"], 0, 0, SMALL)
    assert all(math.isnan(a) for a in models.accuracy.values())
    assert models.predictions(rows, "g", ["id"]).filter("pred_value is null").count() == 0
    one = rows.withColumn("g", F.lit("only"))
    assert {r["pred_value"] for r in ensembles.fit_classifiers(one, "g", ["x", "y"], ["id"], 2, 1, SMALL).predictions(one, "g", ["id"]).collect()} == {"only"}
    with pytest.raises(ValueError):
        ensembles.fit_classifiers(rows.filter("g is null"), "g", ["x", "y"], ["id"], 2, 1, SMALL)


def test_regressors_and_their_validation(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.rand(3).alias("b"))
    rows = rows.withColumn("t", 1e6 * F.when(F.col("a") < 10, 1).otherwise(3) + F.col("b"))
    models = ensembles.fit_regressors(rows, "t", ["a", "b"], ["id"], 5, 2, SMALL)
    assert models.rmse["decision_tree"] < 1000 and models.rmse["random_forest"] < 4e5
    found = learning.comparison(models, rows, "t", ["id"]).agg(F.max(F.abs(F.col("decision_tree_predict") - F.col("real")))).first()[0]
    assert found < 1000
    mean_only = ensembles.fit_regressors(rows.withColumn("a", F.lit(1)).withColumn("b", F.lit(1)), "t", ["a", "b"], ["id"], 5, 1, SMALL)
    assert mean_only.rmse["decision_tree"] == pytest.approx(1e6, rel=0.05)


# ---- nearest classes -------------------------------------------------------------


def brute_nearest(points, classes):
    out = {}
    for key, p in points:
        out[key] = None if any(x is None or x != x for x in p) else min((sum((a - b) ** 2 for a, b in zip(p, m)), label) for label, m in classes)[1]
    return out


@pytest.mark.parametrize("width", [1, 2, 5])
def test_many_classes_like_a_plain_loop(spark, monkeypatch, width):
    monkeypatch.setattr(nearest, "FEW", 3)
    monkeypatch.setattr(nearest, "BLOCK", 8)
    rng = random.Random(width)
    classes = [(f"c{i:03d}", [float(rng.randint(0, 12)) for _ in range(width)]) for i in range(300)]  # many ties
    points = [(i, [float(rng.randint(-3, 15)) for _ in range(width)]) for i in range(200)]
    points += [(1000, [None] + [1.0] * (width - 1)), (1001, [float("nan")] + [1.0] * (width - 1))] + [(2000 + i, [6.0] * width) for i in range(100)]
    names = [f"f{i}" for i in range(width)]
    rows = spark.createDataFrame([(k, *p) for k, p in points], "id long, " + ", ".join(f"{n} double" for n in names))
    means = spark.createDataFrame([*classes, ("gone", [None] * width)], "label string, means array<double>")
    found = {r["id"]: r["pred_value"] for r in nearest.with_nearest(rows, means, names).collect()}
    assert found == brute_nearest(points, classes)
    few = nearest.with_nearest(rows, means.limit(2), names)
    assert {r["id"]: r["pred_value"] for r in few.collect()} == brute_nearest(points, classes[:2])


def test_fifty_thousand_classes(spark):
    n = 50_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("g"), (F.col("id") % 250).cast("double").alias("x"), F.floor(F.col("id") / 250).cast("double").alias("y"))
    moved = rows.select("g", (F.col("x") + 0.3).alias("x"), (F.col("y") - 0.2).alias("y"))
    found = nearest.with_nearest(moved, learning.class_means(rows, "g", ["x", "y"]), ["x", "y"])
    assert found.filter("pred_value = g").count() == n


def test_plan_does_not_grow_with_the_classes(spark):
    def plan(n):
        rows = spark.range(n).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("x"))
        return nearest.with_nearest(rows, learning.class_means(rows, "g", ["x"]), ["x"])._jdf.queryExecution().executedPlan().toString()

    small, large = plan(2_000), plan(20_000)
    assert small.count("Join") == large.count("Join") and "Window" not in large and "CartesianProduct" not in large


# ---- self-training over pairs -----------------------------------------------------


def brute_pairs(rows, features):
    out = {}
    for i, (a, b) in enumerate(zip(features, features[1:])):
        points = [((r[a], r[b]), r["label"], r["true"]) for r in rows if r[a] is not None and r[b] is not None]

        def means(labels):
            groups = {}
            for (p, _, _), label in zip(points, labels):
                if label is not None:
                    groups.setdefault(label, []).append(p)
            return {k: tuple(sum(x) / len(v) for x in zip(*v)) for k, v in sorted(groups.items())}

        def guess(model, p):
            return min((sum((x - m) ** 2 for x, m in zip(p, at)), k) for k, at in model.items())[1]

        first = now = means([label for _, label, _ in points])
        if not first:
            continue
        rounds = 0
        while True:
            rounds += 1
            after = means([label or guess(now, p) for p, label, _ in points])
            same = after.keys() == now.keys() and all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-15) for k in now for x, y in zip(now[k], after[k]))
            now = after
            if same:
                break
        errors = [sum(guess(m, p) != t for p, _, t in points) / len(points) for m in (first, now)]
        out[(a, b)] = (rounds, *errors, now)
    return out


def test_self_training_of_all_pairs(spark):
    rng = random.Random(8)
    data = []
    for i in range(240):
        g = "ab"[i % 2] if i % 5 else "c"
        centre = {"a": 0.0, "b": 2.0, "c": 5.0}[g]
        data.append({"w": rng.gauss(centre, 1), "x": rng.gauss(centre, 1) if i % 11 else None, "y": rng.gauss(-centre, 1), "z": 1.0, "true": g, "label": g if i < 12 else None})
    names = ["w", "x", "y", "z"]
    rows = spark.createDataFrame([tuple(r[k] for k in (*names, "true", "label")) for r in data], "w double, x double, y double, z double, true string, label string")
    scores, lines = learning.self_training_pairs(rows, "label", "true", names)
    expected = brute_pairs(data, names)
    found = {(r["feature_u"], r["feature_v"]): r for r in scores.collect()}
    assert found.keys() == expected.keys()
    for pair, (rounds, before, after, _) in expected.items():
        assert found[pair]["rounds"] == rounds
        assert (found[pair]["error_before"], found[pair]["error_after"]) == pytest.approx((before, after))
    boundaries = lines.filter("stage = 'self_trained'").collect()
    assert len(boundaries) == 9 and lines.count() == 18
    for r in boundaries:
        model = expected[(r["feature_u"], r["feature_v"])][3]
        a, b = model[r["class_a"]], model[r["class_b"]]
        at = [(p + q) / 2 for p, q in zip(a, b)]  # half way between the means
        assert r["w_u"] * at[0] + r["w_v"] * at[1] == pytest.approx(r["c"])
        assert (r["w_u"], r["w_v"]) == pytest.approx((b[0] - a[0], b[1] - a[1]))


def test_settled_rows_are_not_read_again(spark, monkeypatch):
    """A slow walk of the means: same rounds and means as by brute force, few rows in most rounds."""
    rng = random.Random(4)
    data = [{"u": rng.random(), "v": rng.random() * 3, "true": "abc"[i % 3], "label": "abc"[i % 3] if i < 90 else None} for i in range(3000)]
    rows = spark.createDataFrame([(r["u"], r["v"], r["true"], r["label"]) for r in data], "u double, v double, true string, label string")
    expected = brute_pairs(data, ["u", "v"])[("u", "v")]
    read, whole = [], learning.class_sums

    def counted(rows, *rest):
        read.append(rows.count())
        return whole(rows, *rest)

    monkeypatch.setattr(learning, "class_sums", counted)
    monkeypatch.setattr(learning, "MANY", 100)
    first, last, rounds = learning.moved_means(learning._kept(rows, "label", ["u", "v"]), 2)
    assert rounds == expected[0] > 8
    for label, at in last:
        assert at == pytest.approx(expected[3][label], rel=1e-12)
    assert sum(n < 1500 for n in read) > rounds // 3
    assert learning.self_training(rows, "label", ["u", "v"])[1] == rounds


def test_self_training_of_odd_rows(spark):
    """Missing, NaN and infinite features, a label with no mean, and no labels at all."""
    nan, big = float("nan"), float("inf")
    data = [(0.0, 0.0, "a"), (None, 2.0, "a"), (5.0, 5.0, "b"), (nan, 1.0, "c"), (None, None, "d"), (1.0, 1.0, None), (4.0, None, None), (nan, 3.0, None), (4.5, 4.0, None)]
    rows = spark.createDataFrame(data, "x double, y double, label string")
    found = {(str(r["x"]), str(r["y"])): r["pred_value"] for r in learning.self_training(rows, "label", ["x", "y"])[0].collect()}
    assert (found[("1.0", "1.0")], found[("4.5", "4.0")], found[("4.0", "None")], found[("nan", "3.0")]) == ("a", "b", None, None)
    assert learning.self_training(rows.withColumn("label", F.lit(None).cast("string")), "label", ["x", "y"])[1] == 1
    more = rows.unionByName(spark.createDataFrame([(big, 1.0, "z")], rows.schema))
    assert learning.self_training(more, "label", ["x", "y"])[0].filter("pred_value is null").count() == 5
