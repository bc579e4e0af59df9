"""Training rows, scores, clusters and nearest-mean classification."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import dist, frexp, inf, isclose, isfinite, log
from multiprocessing.pool import ThreadPool

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.nullsafe import ratio
from stallwise.operators.ensembles import REGRESSORS, Regressors
from stallwise.operators.nearest import FEW, complete, nearest_label, squared_distance, with_nearest
from stallwise.operators.shaping import complete_rows, hash_split
from stallwise.session import checkpointed

# Cross-validation folds and repeats, and the seed.
FOLDS = 10
REPEATS = 3
SEED = 666


def training_sets(
    rows: DataFrame,
    label: str,
    features: Sequence[str],
    keys: Sequence[str],
    omit_missing: bool = True,
    percent: int = 90,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Labelled (and complete) rows, split into training and test rows."""
    kept = rows.select(*keys, label, *features).filter(F.col(label).isNotNull())
    if omit_missing:
        kept = complete_rows(kept, features)
    return hash_split(checkpointed(kept), keys, percent, seed)


def comparison(models: Regressors, rows: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Every regressor's prediction next to the real value."""
    found = models.predict(rows)
    return found.select(
        *keys, *[F.col(m).alias(f"{m}_predict") for m in REGRESSORS], F.col(label).cast("double").alias("real")
    )


def rmse(rows: DataFrame, predicted: Sequence[str], real: str) -> DataFrame:
    """Root mean squared error of several prediction columns."""
    return rows.agg(
        *[F.sqrt(F.avg(F.pow(F.col(p) - F.col(real), 2))).alias(f"{p}_rmse") for p in predicted]
    )


def confusion(rows: DataFrame, predicted: str = "pred_value", true: str = "true_value") -> DataFrame:
    """Number of rows per predicted and true label."""
    return rows.groupBy(
        F.col(predicted).alias("pred_value"), F.col(true).alias("true_value")
    ).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """Accuracy, kappa, Rand index and adjusted Rand index of a confusion table."""

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    # The margins as long rows; a label seen on one side only has 0 on the other.
    margins = (
        table.select(
            F.inline(
                F.array(
                    F.struct(F.col("pred_value").alias("label"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t")),
                    F.struct(F.col("true_value").alias("label"), F.lit(0).cast("bigint").alias("p"), F.col("n").alias("t")),
                )
            )
        )
        .groupBy("label")
        .agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
        .agg(
            F.sum(pairs(F.col("p"))).alias("pred_pairs"),
            F.sum(pairs(F.col("t"))).alias("true_pairs"),
            F.sum((F.col("p") * F.col("t")).cast("double")).alias("chance"),
        )
    )
    same = F.col("pred_value") == F.col("true_value")
    cells = table.agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("hits"),
        F.sum(pairs(F.col("n"))).alias("cell_pairs"),
    )
    # Two one-row tables side by side.
    stacked = cells.unionByName(margins, allowMissingColumns=True)
    one = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    total = pairs(F.col("n"))
    by_chance = ratio(F.col("chance"), F.col("n") * F.col("n"))
    accuracy = ratio(F.col("hits"), F.col("n"))
    both, p, t = F.col("cell_pairs"), F.col("pred_pairs"), F.col("true_pairs")
    expected = ratio(p * t, total)
    return one.select(
        accuracy.alias("accuracy"),
        ratio(accuracy - by_chance, 1 - by_chance).alias("kappa"),
        ratio(total + 2 * both - p - t, total).alias("rand"),
        ratio(both - expected, (p + t) / 2 - expected).alias("adjusted_rand"),
    )


def model_scores(rows: DataFrame) -> DataFrame:
    """Accuracy, kappa and Rand indices per model of ``predictions``."""
    names = sorted(r["model"] for r in rows.select("model").distinct().collect())  # a handful
    out = None
    for name in names:
        found = agreement(confusion(rows.filter(F.col("model") == name))).withColumn("model", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


# ---- clustering --------------------------------------------------------------


def _vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    gather = VectorAssembler(inputCols=list(features), outputCol="features")
    return gather.transform(complete_rows(rows, features))


def between_over_within(clustered: DataFrame, features: Sequence[str], cluster: str) -> float | None:
    """Calinski-Harabasz score from counts, sums and squared sums per cluster."""
    sums = clustered.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in features],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in features],
    )
    parts = sums.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(sum(F.col(f"s_{c}") * F.col(f"s_{c}") / F.col("n") for c in features)).alias("m"),
        F.sum(sum(F.col(f"q_{c}") for c in features)).alias("q"),
        *[F.sum(f"s_{c}").alias(f"t_{c}") for c in features],
    ).first()
    centre = sum(parts[f"t_{c}"] ** 2 for c in features) / parts["n"]
    within, between = parts["q"] - parts["m"], parts["m"] - centre
    if parts["k"] < 2 or parts["n"] <= parts["k"] or within <= 0:
        return None
    return (between / (parts["k"] - 1)) / (within / (parts["n"] - parts["k"]))


def shop_clusters(
    rows: DataFrame,
    features: Sequence[str],
    method: str = "calinski",
    candidates: Sequence[int] = range(2, 9),
    seed: int = SEED,
) -> tuple[DataFrame, dict[int, float]]:
    """Cluster rows and choose the number of clusters; returns rows and scores.

    ``sse`` takes the k-means elbow (the largest second difference of the cost),
    ``calinski`` the best Calinski-Harabasz score, ``gaussian`` the mixture with
    the lowest BIC. Which k a method chooses is our own definition. Rows with a
    missing feature are left out of the clusters.
    """
    data = checkpointed(_vectors(rows, features)).persist()
    n = data.count()
    wanted = sorted(set(candidates))
    if not wanted or wanted[0] < 2 or wanted[-1] >= n:
        raise ValueError(f"numbers of clusters must be from 2 to {n - 1}, below the {n} complete rows")
    if method == "sse" and len(wanted) < 3:
        raise ValueError("the elbow needs at least three numbers of clusters")
    scores, models = {}, {}
    for k in wanted:
        if method == "gaussian":
            model = GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(data)
            d = len(features)
            free = k - 1 + k * d + k * d * (d + 1) / 2
            scores[k] = free * log(n) - 2 * model.summary.logLikelihood
        else:
            model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data)
            if method == "sse":
                scores[k] = model.summary.trainingCost
            else:
                found = between_over_within(model.transform(data), features, "cluster")
                scores[k] = float("-inf") if found is None else found
        models[k] = model
    chosen = _chosen(method, scores)
    out = models[chosen].transform(data).drop("features", "probability")
    data.unpersist()
    return out, scores


def _chosen(method: str, scores: Mapping[int, float]) -> int:
    if method == "gaussian":
        return min(scores, key=scores.get)
    if method == "calinski":
        return max(scores, key=scores.get)
    ks = sorted(scores)
    bends = {
        b: scores[a] - 2 * scores[b] + scores[c] for a, b, c in zip(ks, ks[1:], ks[2:])
    }
    return max(bends, key=bends.get)


# ---- nearest mean ------------------------------------------------------------


def class_means(rows: DataFrame, label: str | Column, features: Sequence[str]) -> DataFrame:
    """(label, means): the fitted nearest-mean model, one row per class."""
    name = F.col(label) if isinstance(label, str) else label
    return (
        rows.select(name.cast("string").alias("_label"), *features)
        .filter("_label is not null")
        .groupBy("_label")
        .agg(F.array(*[F.avg(c) for c in features]).alias("means"))
        .withColumnRenamed("_label", "label")
    )


def nearest_mean(rows: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Rows with the label predicted from the class means of the labelled rows."""
    return with_nearest(rows, class_means(rows, label, features), features)


def self_training(rows: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, int]:
    """Label the unlabelled rows by nearest mean and refit until nothing moves.

    Given labels never change. The rows are written once with their features. The state is the
    class means: numbers for a few classes (:func:`moved_means`), a written table for many.
    Returns the rows with ``pred_value`` and the rounds used.
    """
    few = class_means(rows, label, features).limit(FEW + 1).collect()  # at most FEW + 1 rows
    if len(few) > FEW:
        return _self_training_of_many(rows, label, features)
    _, last, used = moved_means(_kept(rows, label, features), len(features))
    return rows.withColumn("pred_value", nearest_label(last, features)), used


def _kept(rows: DataFrame, label: str, features: Sequence[str], *more: Column) -> DataFrame:
    values = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    return checkpointed(rows.select(F.col(label).cast("string").alias("_label"), *more, *values))


# Steps as long as the last one that settled rows can bear.
AHEAD = 16
# Rows in doubt from which it pays to set the settled ones apart.
MANY = 500_000
# Whole units in the highest place of a feature, and of these in turn.
PLACE = 1 << 30


@dataclass
class Settled:
    """Rows that may change their class while every mean stays within half of ``margin`` from
    ``means``, and the sums per class of all others."""

    rows: DataFrame
    margin: float
    means: list[tuple[str, list[float]]]
    sums: dict[str, list[tuple[int, int]]]


def moved_means(rows: DataFrame, width: int) -> tuple[list, list, int]:
    """Class means of the rows with a ``_label``, after self-training, and its rounds; features are ``_x0``, ``_x1``, ...

    A round adds up the rows without a label by nearest mean. Rows whose two nearest means differ
    by more than the means can move in the next rounds are added up once, and only the others are
    read until the means have moved that far; the steps shrink, and with them the rows in doubt.
    Sums are whole numbers, so it makes no difference which rows are added up together.
    """
    names = [f"_x{i}" for i in range(width)]
    units = units_of(rows, names)
    given = class_sums(rows.filter("_label is not null"), F.col("_label"), names, units)
    first = now = means_of_sums([given], units)
    levels = [Settled(rows.filter("_label is null").filter(complete(names)).select(*names), inf, first, {})]
    used, in_doubt = 0, MANY
    while True:
        used += 1
        while len(levels) > 1 and not 2 * movement(levels[-1].means, now) < levels[-1].margin:
            levels.pop()
        top = levels[-1]
        nearest = nearest_of(now, names, in_doubt >= MANY) if now else F.lit(None).cast("string")
        open_sums = class_sums(top.rows, nearest, names, units)
        in_doubt = sum(max(n for n, _ in sums) for sums in open_sums.values())
        moved = means_of_sums([given, top.sums, open_sums], units)
        if same_numbers(now, moved):
            return first, moved, used
        margin = 2 * AHEAD * movement(now, moved)
        now = moved
        if in_doubt >= MANY and margin < top.margin / 8 and margin < closest(now) / 4:
            near, clear = nearest_of(now, names), clearly_nearest(now, names, margin)
            settled = class_sums(top.rows.filter(clear), near, names, units)
            levels.append(Settled(checkpointed(top.rows.filter(~clear)), margin, now, added([top.sums, settled])))


def units_of(rows: DataFrame, names: Sequence[str]) -> list[float | None]:
    """Per feature, a power of two that every value has at most PLACE of; none where values are not finite."""
    tops = rows.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in names]).first()
    return [2.0 ** max(frexp(m)[1] - 30, -900) if isfinite(m) else None for m in (tops[c] or 0.0 for c in names)]


def class_sums(rows: DataFrame, label: Column, names: Sequence[str], units: Sequence[float | None]) -> dict[str, list[tuple]]:
    """Per class, (number, sum) of the values of every feature, in units divided by PLACE."""
    columns = []
    for c, unit in zip(names, units, strict=True):
        whole = F.rint(F.col(c) / unit) if unit else None
        columns += [
            F.count(c),
            F.sum(whole.cast("bigint")) if unit else F.sum(c),
            F.sum(F.rint((F.col(c) / unit - whole) * PLACE).cast("bigint")) if unit else F.lit(0),
        ]
    found = rows.groupBy(label.alias("label")).agg(*[col.alias(f"s{i}") for i, col in enumerate(columns)])
    return {
        r["label"]: [(r[f"s{i}"], (r[f"s{i + 1}"] or 0) * PLACE + (r[f"s{i + 2}"] or 0)) for i in range(0, len(columns), 3)]
        for r in found.collect()  # one a class
        if r["label"] is not None
    }


def added(parts: Sequence[Mapping[str, list[tuple]]]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for part in parts:
        for label, sums in part.items():
            mine = out.get(label, [(0, 0)] * len(sums))
            out[label] = [(n + m, s + t) for (n, s), (m, t) in zip(mine, sums, strict=True)]
    return out


def means_of_sums(parts: Sequence[Mapping[str, list[tuple]]], units: Sequence[float | None]) -> list[tuple[str, list[float]]]:
    """Classes with their means in order of label, but for those with a missing mean."""
    found = []
    for label, sums in added(parts).items():
        means = [s / n * (unit or 1.0) / PLACE if n else float("nan") for (n, s), unit in zip(sums, units, strict=True)]
        found.append((label, means))
    return sorted((label, means) for label, means in found if all(m == m for m in means))


def movement(a: Sequence, b: Sequence) -> float:
    """The longest way of a mean from ``a`` to ``b``."""
    if [x[0] for x in a] != [x[0] for x in b]:
        return inf
    return max((dist(x[1], y[1]) for x, y in zip(a, b, strict=True)), default=0.0)


def closest(means: Sequence) -> float:
    """The shortest distance between two means; 0 for a single one."""
    return min((dist(x[1], y[1]) for x, y in combinations(means, 2)), default=0.0)


def tried_classes(means: Sequence, names: Sequence[str], compiled: bool = True) -> Column:
    """Array of (squared distance, label) of all classes; ``compiled`` code is quicker but made anew for other means."""
    own = [F.col(c) for c in names]
    if compiled and len(means) <= FEW:
        return F.array(*[F.struct(squared_distance(own, [F.lit(m) for m in at]).alias("d"), F.lit(c).alias("label")) for c, at in means])
    classes = F.from_json(F.lit(json.dumps([{"label": c, "at": list(at)} for c, at in means])), "array<struct<label: string, at: array<double>>>")
    return F.transform(
        classes, lambda c: F.struct(squared_distance(own, [c["at"][i] for i in range(len(own))]).alias("d"), c["label"].alias("label"))
    )


def nearest_of(means: Sequence, names: Sequence[str], compiled: bool = True) -> Column:
    """The nearest class of a complete row, the first label of equals."""
    if compiled and len(means) <= FEW:
        return nearest_label(means, names)
    return F.array_min(tried_classes(means, names, False))["label"]


def clearly_nearest(means: Sequence, names: Sequence[str], margin: float) -> Column:
    """Whether the second mean is farther than the nearest by more than ``margin``, rounding apart."""
    tried = F.sort_array(tried_classes(means, names))
    near, second = F.sqrt(tried[0]["d"]), F.sqrt(tried[1]["d"])
    return (second < F.lit(inf)) & (second - near > F.lit(margin) + second * 1e-9)


def same_numbers(a: Sequence, b: Sequence) -> bool:
    """Whether two lists of (label, means) are the same up to rounding."""
    return [x[0] for x in a] == [x[0] for x in b] and all(
        isclose(p, q, rel_tol=1e-12, abs_tol=1e-15) for x, y in zip(a, b, strict=True) for p, q in zip(x[1], y[1], strict=True)
    )


def _self_training_of_many(rows: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, int]:
    means = checkpointed(class_means(rows, label, features))
    used = 0
    while True:
        used += 1
        guessed = with_nearest(rows, means, features, "_guess")
        guess = F.coalesce(F.col(label).cast("string"), F.col("_guess"))
        moved = checkpointed(class_means(guessed, guess, features))
        if _same_means(means, moved):
            return with_nearest(rows, moved, features), used
        means = moved


def _same_means(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same classes with equal means, up to rounding."""
    both = a.join(b.withColumnRenamed("means", "others"), "label", "full")
    close = F.zip_with("means", "others", same_mean)
    return both.filter(~F.coalesce(F.forall(close, lambda c: c), F.lit(False))).isEmpty()


def same_mean(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * 1e-12, F.lit(1e-15))


# ---- self-training over pairs of features --------------------------------------


def self_training_pairs(
    rows: DataFrame, label: str, true: str, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Self-training by nearest mean for every pair of neighbouring features.

    A pair takes the rows that have both features. The rows are written once; rounds read only
    what is in doubt (:func:`moved_means`). The classes should be few: their means are numbers.

    Returns the pairs with ``rounds`` and the share of rows (with a true label) that the
    supervised and the self-trained means get wrong, and the boundaries between any two
    classes before and after: the points with ``w_u * u + w_v * v = c`` are as far from one as
    from the other. Pairs without a labelled row are left out.
    """
    spark = rows.sparkSession
    kept = _kept(rows, label, features, F.col(true).cast("string").alias("_true"))
    both = ["_x0", "_x1"]

    def trained(i: int) -> tuple | None:
        pair = kept.select("_label", "_true", F.col(f"_x{i}").alias("_x0"), F.col(f"_x{i + 1}").alias("_x1")).filter(complete(both))
        first, last, rounds = moved_means(pair, 2)
        if not first:
            return None
        models = {"supervised": first, "self_trained": last}
        wrong = [F.avg((nearest_of(m, both) != F.col("_true")).cast("double")).alias(stage) for stage, m in models.items()]
        return features[i], features[i + 1], rounds, pair.agg(*wrong).first(), models

    # The rounds of a pair are short jobs; those of a few pairs run side by side.
    with ThreadPool(4) as pool:
        found = [x for x in pool.map(trained, range(len(features) - 1)) if x]
    scores = [(u, v, rounds, *wrong) for u, v, rounds, wrong, _ in found]
    lines = [
        (u, v, stage, a, b, *boundary(p, q))
        for u, v, _, _, models in found
        for stage, classes in models.items()
        for (a, p), (b, q) in combinations(classes, 2)
    ]
    schema = "feature_u string, feature_v string, stage string, class_a string, class_b string, w_u double, w_v double, c double"
    return (
        spark.createDataFrame(scores, "feature_u string, feature_v string, rounds int, error_before double, error_after double"),
        spark.createDataFrame(sorted(lines, key=lambda x: x[2] != "supervised"), schema),
    )


def boundary(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float]:
    """(w_u, w_v, c) of the points that are as far from ``a`` as from ``b``."""
    w_u, w_v = b[0] - a[0], b[1] - a[1]
    return w_u, w_v, (w_u * (a[0] + b[0]) + w_v * (a[1] + b[1])) / 2


def error_rate(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    wrong = (F.col(predicted).cast("string") != F.col(true).cast("string")).cast("double")
    return rows.agg(F.avg(wrong).alias("error_rate"))
