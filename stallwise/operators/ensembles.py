"""Trees of many models grown together.

A lane is one tree of one model: of the fit to all rows, or of one fold of one repeat of a
cross-validation. Rows are binned once. One level of all lanes is one pass over the rows: in every
lane that it counts in a row finds its node, a task adds up its rows per (lane, node, feature, bin)
(:mod:`histograms`), Spark adds up the tasks' sums, and the best split of every node comes back.
What the driver holds is the trees themselves, whose size is given by lanes and depth and not by
the rows.

All sums are whole numbers, so a tree does not depend on how the rows were laid out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators import histograms
from stallwise.operators.quantiles import group_quantiles
from stallwise.session import checkpointed, discard, scratch

BINS = 32
# Whole units in one: residuals and scaled targets are rounded to these.
UNIT = 1 << 30
# Chances of at most 0, 1, 2, ... draws of a row in a sample with replacement (Poisson, mean 1).
DRAWS = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917]
# Cells of (row, lane, feature) in one file of the rows: the fewest that pay for a task, and those from
# which more files are written than two a core.
LEAST_CELLS, TASK_CELLS = 10_000_000, 150_000_000


# ---- rows ----------------------------------------------------------------------


def breaks_of(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per feature, the distinct values between its bins; at most one less than ``bins``."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    found = group_quantiles(long, "x", [i / bins for i in range(1, bins)], ["feature"])
    quantiles = {r["feature"]: sorted(set(r["quantiles"])) for r in found.collect()}  # one row a feature
    return {f: quantiles.get(f, []) for f in features}


def bins_of(breaks: dict[str, list[float]]) -> Column:
    """Array of bins: how many breaks are below each feature's value; -1 for a missing one."""

    def one(feature: str, ends: list[float]) -> Column:
        x = F.col(feature).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: e < x))
        return F.when(x.isNull(), F.lit(-1)).otherwise(below)

    return F.array(*[one(f, ends) for f, ends in breaks.items()])


def hashed(keys: Sequence[str], seed: int) -> Column:
    """A number of 32 bits from the seed and the keys as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def folds_of(keys: Sequence[str], folds: int, repeats: int, seed: int) -> Column:
    """Array with the fold of a row in every repeat; equal keys are in the same fold."""
    return F.array(*[(hashed(keys, seed + r) % max(1, folds)).cast("int") for r in range(repeats)]).cast("array<int>")


def draws_of(keys: Sequence[str], trees: int, seed: int) -> Column:
    """Array saying how often a row is drawn into the sample of every tree."""
    chance = F.array(*[F.lit(d) for d in DRAWS])
    key = hashed(keys, seed)

    def drawn(tree: Column) -> Column:
        u = F.pmod(F.xxhash64(key, tree), F.lit(1_000_000)) / 1_000_000
        return F.size(F.filter(chance, lambda c: c <= u))

    return F.transform(F.sequence(F.lit(1), F.lit(max(1, trees))), drawn)


@dataclass
class Runs:
    """The fit to all rows (run 0) and one fit per repeat and fold that leaves the fold out."""

    folds: int
    repeats: int

    @property
    def count(self) -> int:
        return 1 + (self.repeats * self.folds if self.folds > 1 else 0)

    def trains(self, run: str) -> str:
        """SQL: whether a row with ``folds`` is trained on in a run."""
        if self.count == 1:
            return "true"
        return f"({run} = 0 or folds[cast(({run} - 1) div {self.folds} as int)] <> ({run} - 1) % {self.folds})"

    def lanes(self, width: int) -> histograms.Lanes:
        """So many lanes for every run."""
        return histograms.Lanes(self.folds if self.count > 1 else 0, width)

    def held_out(self) -> str:
        """SQL: array of the runs that leave a row out."""
        if self.count == 1:
            return "cast(array() as array<int>)"
        return f"transform(folds, (f, r) -> 1 + r * {self.folds} + f)"


def named(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` as the given columns, whatever its own are called.

    The names are given afterwards: inside a lambda a name of the same select would win over
    a feature of that name.
    """
    return rows.select(*[c.alias(f"__new_{n}") for n, c in columns.items()]).toDF(*columns)


def spread_out(rows: DataFrame, lanes: int, features: int) -> DataFrame:
    """Rows written in as many parts as their work for all lanes asks for."""
    work = rows.count() * lanes * features
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(work // LEAST_CELLS, max(2 * cores, work // TASK_CELLS))
    return checkpointed(rows.repartition(max(1, parts)))


# ---- growing -------------------------------------------------------------------


def one_row(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    """A model as a table of one row of arrays."""
    return spark.range(1).select(F.from_json(F.lit(json.dumps(row)), schema).alias("m")).select("m.*")


@dataclass
class Trees:
    """Per lane and node (1 is the root, 2n and 2n + 1 are below n): split and sums."""

    feature: list[list[int]]
    cut: list[list[int]]
    sums: list[list[list[int] | None]]
    depth: int

    @classmethod
    def empty(cls, lanes: int, depth: int) -> Trees:
        size = 2 << depth
        return cls([[-1] * size for _ in range(lanes)], [[0] * size for _ in range(lanes)], [[None] * size for _ in range(lanes)], depth)

    def of_lanes(self, lanes: range) -> Trees:
        return Trees(*([part[i] for i in lanes] for part in (self.feature, self.cut, self.sums)), self.depth)

    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and cuts by lane and node."""
        return np.array(self.feature, np.int32), np.array(self.cut, np.int32)

    def table(self, spark: SparkSession, value=None) -> DataFrame:
        """The trees as one row of arrays, with ``value`` of every node's sums."""
        schema = "m_feature array<array<int>>, m_cut array<array<int>>"
        row = {"m_feature": self.feature, "m_cut": self.cut}
        if value:
            schema += ", m_value array<array<array<double>>>"
            row["m_value"] = [[value(s) if s else None for s in lane] for lane in self.sums]
        return one_row(spark, row, schema)


def walk(lane: str, steps: int) -> str:
    """SQL: the node a row with ``bins`` is at after so many splits of a lane."""
    if not steps:
        return "1"
    feature, cut = f"m_feature[{lane}][n]", f"m_cut[{lane}][n]"
    return f"aggregate(sequence(1, {steps}), 1, (n, i) -> if({feature} < 0, n, 2 * n + if(bins[{feature}] <= {cut}, 0, 1)))"


def gini(sums: Sequence[str]) -> str:
    """SQL: purity of class counts, squares over the total."""
    return f"(({' + '.join(f'cast({c} as double) * ({c})' for c in sums)}) / ({all_rows(sums)}))"


def all_rows(sums: Sequence[str]) -> str:
    return "(" + " + ".join(sums) + ")"


def squares(sums: Sequence[str]) -> str:
    """SQL: what a mean explains, the squared sum over the number of rows (the first two sums)."""
    return f"(cast({sums[1]} as double) * ({sums[1]}) / ({sums[0]}))"


def first_sum(sums: Sequence[str]) -> str:
    return f"({sums[0]})"


def chosen_features(spark: SparkSession, lanes: int, depth: int, features: int, allowed: str, seed: int) -> dict[int, np.ndarray]:
    """Per lane whose nodes look at ``allowed`` (SQL) features only, those of every node, chosen by a hash."""
    ranked = f"transform(sequence(0, {features - 1}), feature -> struct(xxhash64({seed}, lane, node, feature) AS h, feature AS f))"
    found = spark.sql(f"""
        SELECT lane, node, slice(array_sort({ranked}).f, 1, cast({allowed} AS int)) AS few
        FROM (SELECT cast(l.id AS int) AS lane, cast(n.id AS int) AS node FROM range({lanes}) l CROSS JOIN range(1, {1 << depth}) n)
        WHERE {allowed} < {features}""")
    out: dict[int, np.ndarray] = {}
    for r in found.collect():  # at most one row a node of every lane
        out.setdefault(r["lane"], np.zeros((1 << depth, len(r["few"])), np.int32))[r["node"]] = r["few"]
    return out


def level_query(sums: int, score, size) -> str:
    """SQL: the best split of every node of one level, from the tasks' sums in {found}."""
    names = [f"s{i}" for i in range(sums)]
    low, all_ = [f"l_{n}" for n in names], [f"t_{n}" for n in names]
    high = [f"({t} - {l})" for t, l in zip(all_, low, strict=True)]
    return f"""
        WITH placed AS (SELECT /*+ REPARTITION(lane, node) */ * FROM {{found}}),
        summed AS (
          SELECT lane, node, feature, bin, {", ".join(f"sum({n}) AS {n}" for n in names)}
          FROM placed GROUP BY lane, node, feature, bin),
        split AS (
          SELECT lane, node, feature, bin, {", ".join(f"sum({n}) OVER upto AS l_{n}, sum({n}) OVER whole AS t_{n}" for n in names)}
          FROM summed
          WINDOW whole AS (PARTITION BY lane, node, feature),
            upto AS (PARTITION BY lane, node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT lane, node, first(array({", ".join(all_)})) AS all, max(struct(
            CASE WHEN {size(low)} > 0 AND {size(high)} > 0 THEN {score(low)} + {score(high)} - {score(all_)} ELSE -1D END AS gain,
            -feature AS f, -bin AS b, array({", ".join(low)}) AS low)) AS best
        FROM split GROUP BY lane, node"""


def grow(
    rows: DataFrame,
    lanes: int,
    depth: int,
    counts: str,
    stats: Sequence[str],
    score,
    size,
    allowed: str | None = None,
    seed: int = 0,
) -> Trees:
    """:func:`grow_lanes` where ``counts`` says in SQL whether a row counts in ``lane`` and ``stats`` what it adds there."""

    def each(of: str, name: str) -> Column:
        return F.expr(f"transform(sequence(0, {lanes - 1}), lane -> {of})").alias(name)

    sums = [each(f"cast({s} AS bigint)", f"s{i}") for i, s in enumerate(stats)]
    rows = rows.select("bins", each(f"if({counts}, 1, 0)", "counted"), *sums)
    return grow_lanes(rows, lanes, depth, histograms.given(len(stats)), len(stats), score, size, allowed, seed)


def grow_lanes(
    rows: DataFrame, lanes: int, depth: int, adds: histograms.Adds, sums: int, score, size, allowed: str | None = None, seed: int = 0,
) -> Trees:
    """Grow a tree in every lane by the largest gain in ``score``.

    ``rows`` have ``bins`` and what ``adds`` reads to say which rows count in a lane and what they
    add to its ``sums``, in whole numbers (below 2^53 in the sums of one slab). ``size`` gives the
    number of rows of some sums. With ``allowed`` a node looks at so many features of a lane, chosen
    by a hash. The lower feature and then the lower bin wins a tie.
    """
    spark = rows.sparkSession
    trees = Trees.empty(lanes, depth)
    first = rows.select(F.size("bins").alias("n")).first() if allowed else None
    chosen = chosen_features(spark, lanes, depth, first["n"], allowed, seed) if first else {}
    schema = "lane int, node int, feature int, bin int, " + ", ".join(f"s{i} long" for i in range(sums))
    query = level_query(sums, score, size)
    for level in range(depth):
        found = rows.mapInArrow(histograms.cells(lanes, level, *trees.splits(), sums, adds, chosen), schema)
        split = False
        for r in spark.sql(query, found=found).collect():  # at most one row a node of every lane
            lane, at, best, total = r["lane"], r["node"], r["best"], list(r["all"])
            trees.sums[lane][at] = total
            if best["gain"] > 1e-9 * max(1.0, abs(sum(total))):
                trees.feature[lane][at], trees.cut[lane][at] = -best["f"], -best["b"]
                trees.sums[lane][2 * at] = list(best["low"])
                trees.sums[lane][2 * at + 1] = [a - b for a, b in zip(total, best["low"], strict=True)]
                split = True
        if not split:
            break
    return trees


# ---- classifiers ----------------------------------------------------------------


@dataclass
class Settings:
    """Numbers of a sweep; none of them depends on the rows."""

    depth: int = 5
    trees: int = 20
    boosts: int = 20
    boost_depth: int = 3
    rate: float = 0.1
    seed: int = 666


CLASSIFIERS = ["decision_tree", "bagged_trees", "random_forest", "boosted_trees", "naive_bayes"]


def votes(classes: int, lane: str, first: int, last: int, depth: int) -> str:
    """SQL: class shares of the leaves of lanes ``first``..``last``, added up."""
    none = f"array_repeat(0D, {classes})"
    leaf = f"coalesce(m_value[{lane}][{walk(lane, depth)}], {none})"
    return f"aggregate(sequence({first}, {last}), {none}, (a, t) -> zip_with(a, {leaf}, (x, y) -> x + y))"


def largest(shares: str) -> str:
    """SQL: the class with the largest share, the first one of equals."""
    return f"cast(array_position({shares}, array_max({shares})) - 1 as int)"


def shares_of(sums: list[int]) -> list[float]:
    total = sum(sums)
    return [s / total if total else 0.0 for s in sums]


def tree_guesses(rows: DataFrame, trees: Trees, classes: int, width: int, run: str, settings: Settings) -> DataFrame:
    """Rows with the class each of the three tree models gives them in a run."""
    table = trees.table(rows.sparkSession, shares_of)
    spans = {"decision_tree": (0, 0), "bagged_trees": (1, settings.trees), "random_forest": (settings.trees + 1, 2 * settings.trees)}
    joined = rows.crossJoin(F.broadcast(table))
    for name, (first, last) in spans.items():
        joined = joined.withColumn(f"v_{name}", F.expr(votes(classes, f"{run} * {width} + t", first, last, trees.depth)))
    return joined.select(*rows.columns, *[F.expr(largest(f"v_{n}")).alias(n) for n in spans])


def grow_classifiers(rows: DataFrame, runs: Runs, classes: int, features: int, settings: Settings) -> tuple[Trees, int]:
    """One tree, bagged trees and a random forest of every run; returns the trees and the lanes a run has."""
    width = 1 + 2 * settings.trees
    some = max(1, round(features**0.5))
    trees = grow_lanes(
        rows.select("bins", "y", "folds", "draws"), runs.count * width, settings.depth,
        histograms.class_counts(runs.lanes(width)), classes, gini, all_rows,
        f"if(lane % {width} > {settings.trees}, {some}, {features})", settings.seed,
    )
    return trees, width


def boost(rows: DataFrame, runs: Runs, classes: int, settings: Settings) -> tuple[DataFrame, list[Trees]]:
    """Gradient boosting of every run: each round grows a tree per class towards what is left.

    Any number of classes; a leaf takes a Newton step on the multinomial loss. Returns the rows
    with ``margins`` per run and class, and the rounds' trees.
    """
    lanes = runs.count * classes
    rows = rows.drop("draws").withColumn("margins", F.array_repeat(F.lit(0.0), lanes))
    rounds, last = [], None
    shrink = settings.rate * (classes - 1) / classes

    def step(sums: list[int]) -> float:
        return shrink * sums[1] / max(sums[2], 1)

    for _ in range(settings.boosts):
        rows, path = with_chances(rows, runs.count, classes)
        if last:
            discard(rows.sparkSession, last)
        last = path
        trees = grow_lanes(
            rows.select("bins", "y", "folds", "chances"), lanes, settings.boost_depth,
            histograms.what_is_left(runs.lanes(classes), UNIT), 3, squares, first_sum,
        )
        rounds.append(trees)
        rows = stepped(rows.drop("chances"), trees, step)
    return checkpointed(rows), rounds


def with_chances(rows: DataFrame, runs: int, classes: int) -> tuple[DataFrame, str]:
    """Rows written with the ``chances`` that their margins give every class in every run, and the folder."""
    mine = f"slice(margins, 1 + run * {classes}, {classes})"
    exps = f"transform(sequence(0, {runs - 1}), run -> transform({mine}, m -> exp(m - array_max({mine}))))"
    shares = f"flatten(transform({exps}, e -> transform(e, x -> x / aggregate(e, 0D, (a, v) -> a + v))))"
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "boosted")
    out = rows.withColumn("chances", F.expr(shares))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path), path


def stepped(rows: DataFrame, trees: Trees, step) -> DataFrame:
    """Rows with ``margins`` moved by the leaves of one round; a lane without a tree stays."""
    value = np.array([[step(s) if s else 0.0 for s in lane] for lane in trees.sums])
    return rows.mapInArrow(histograms.stepping(*trees.splits(), value, trees.depth), rows.schema)


@dataclass
class Bayes:
    """Per run and class: log share, and mean and variance of every feature."""

    prior: list[list[float]]
    mean: list[list[list[float]]]
    variance: list[list[list[float]]]

    def of_run(self, run: int) -> Bayes:
        return Bayes(self.prior[run : run + 1], self.mean[run : run + 1], self.variance[run : run + 1])

    def guess(self, rows: DataFrame, run: str) -> DataFrame:
        """Rows with the likeliest class under a normal distribution of every feature."""
        row = {"b_prior": self.prior, "b_mean": self.mean, "b_var": self.variance}
        schema = "b_prior array<array<double>>, b_mean array<array<array<double>>>, b_var array<array<array<double>>>"
        table = one_row(rows.sparkSession, row, schema)
        at = f"[{run}][c]"
        term = f"-0.5D * ln(2 * pi() * b_var{at}[j]) - pow(x[j] - b_mean{at}[j], 2) / (2 * b_var{at}[j])"
        one = f"aggregate(sequence(0, size(x) - 1), b_prior{at}, (a, j) -> a + coalesce({term}, 0D))"
        logs = F.expr(f"transform(sequence(0, size(b_prior[0]) - 1), c -> {one})")
        joined = rows.crossJoin(F.broadcast(table)).withColumn("logs", logs)
        return joined.select(*rows.columns, F.expr(largest("logs")).alias("naive_bayes"))


def fit_bayes(rows: DataFrame, runs: Runs, classes: int, features: int) -> Bayes:
    """Means and variances of every run from one aggregation over scaled features ``x``."""
    each = rows.select("y", "folds", "x", F.explode(F.sequence(F.lit(0), F.lit(runs.count - 1))).alias("run")).filter(runs.trains("run"))
    long = each.select("run", "y", F.posexplode("x").alias("j", "v"))
    found = long.groupBy("run", "y", "j").agg(
        F.count("v").alias("n"), F.count(F.lit(1)).alias("rows"), F.avg("v").alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var")
    )
    # A class that a run has not seen is never guessed; one of equal values keeps a little width.
    mean, variance = ([[[d] * features for _ in range(classes)] for _ in range(runs.count)] for d in (0.0, 1.0))
    rows_of = [[0] * classes for _ in range(runs.count)]
    for r in found.collect():  # runs x classes x features rows
        if r["n"]:
            mean[r["run"]][r["y"]][r["j"]] = r["mean"]
            variance[r["run"]][r["y"]][r["j"]] = r["var"] + 1e-9
        rows_of[r["run"]][r["y"]] = r["rows"]
    prior = [[log(n / sum(of)) if n else -1e300 for n in of] for of in rows_of]
    return Bayes(prior, mean, variance)


@dataclass
class Classifiers:
    """All classifiers fitted to all rows, with the accuracy they had over the folds."""

    labels: list[str]
    features: list[str]
    breaks: dict[str, list[float]]
    scale: dict[str, tuple[float, float]]
    trees: Trees
    width: int
    rounds: list[Trees]
    bayes: Bayes
    settings: Settings
    accuracy: dict[str, float]

    def predictions(self, rows: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
        """(keys, true_value, model, pred_value): what every classifier says about every row."""
        classes = len(self.labels)
        base = named(rows, _key=F.struct(*keys), _true=F.col(label).cast("string"), bins=bins_of(self.breaks), x=scaled_features(self.scale))
        out = tree_guesses(base, self.trees, classes, self.width, "0", self.settings)
        out = self.bayes.guess(out, "0").withColumn("margins", F.array_repeat(F.lit(0.0), classes))
        shrink = self.settings.rate * (classes - 1) / classes
        joined = Trees(*([lane for t in self.rounds for lane in part(t)] for part in (lambda t: t.feature, lambda t: t.cut, lambda t: t.sums)), self.settings.boost_depth)
        table = joined.table(rows.sparkSession, lambda s: [shrink * s[1] / max(s[2], 1)])
        lane = f"i * {classes} + c"
        leaf = f"coalesce(m_value[{lane}][{walk(lane, joined.depth).replace('(n, i) ->', '(n, j) ->')}][0], 0D)"
        added = f"transform(sequence(0, {classes - 1}), c -> aggregate(sequence(0, {len(self.rounds) - 1}), 0D, (a, i) -> a + {leaf}))"
        out = out.crossJoin(F.broadcast(table)).withColumn("margins", F.expr(added)).withColumn("boosted_trees", F.expr(largest("margins")))
        names = F.array(*[F.lit(x) for x in self.labels])
        pairs = [F.struct(F.lit(m).alias("model"), F.get(names, F.col(m)).alias("pred_value")) for m in CLASSIFIERS]
        return out.select("_key.*", F.col("_true").alias("true_value"), F.inline(F.array(*pairs)))


def scaled_features(scale: dict[str, tuple[float, float]]) -> Column:
    """Array of features less their mean, in standard deviations."""
    return F.array(*[(F.col(f).cast("double") - m) / s for f, (m, s) in scale.items()])


def scale_of(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    found = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).first()
    return {f: (float(found[f"m_{f}"] or 0.0), float(found[f"s_{f}"] or 0.0) or 1.0) for f in features}


def fit_classifiers(
    train: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], folds: int, repeats: int, settings: Settings | None = None,
) -> Classifiers:
    """Fit every classifier to all rows and to every fold of every repeat.

    ``keys`` name a row: they choose its folds and samples. A missing feature lies in a bin of
    its own below all others, and says nothing to naive Bayes. Rows without a label are left out.
    """
    settings = settings or Settings()
    runs = Runs(folds, repeats)
    kept = train.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("string"))
    labels = sorted(r[0] for r in kept.select("_label").distinct().collect())  # one a class
    if not labels:
        raise ValueError("no labelled rows")
    breaks, scale = breaks_of(kept, features), scale_of(kept, features)
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("_label")).cast("int") - 1
    rows = named(
        kept, y=y, bins=bins_of(breaks), x=scaled_features(scale),
        folds=folds_of(keys, folds, repeats, settings.seed), draws=draws_of(keys, settings.trees, settings.seed),
    )
    rows = spread_out(rows, runs.count * (1 + 2 * settings.trees), len(features))
    classes = len(labels)
    trees, width = grow_classifiers(rows, runs, classes, len(features), settings)
    boosted, rounds = boost(rows, runs, classes, settings)
    bayes = fit_bayes(rows, runs, classes, len(features))

    tested = boosted.select("y", "bins", "x", "margins", F.explode(F.expr(runs.held_out())).alias("run"))
    guessed = bayes.guess(tree_guesses(tested, trees, classes, width, "run", settings), "run")
    mine = f"slice(margins, 1 + run * {classes}, {classes})"
    guessed = guessed.withColumn("boosted_trees", F.expr(largest(mine)))
    per_run = guessed.groupBy("run").agg(*[F.avg((F.col(m) == F.col("y")).cast("double")).alias(m) for m in CLASSIFIERS])
    means = per_run.agg(*[F.avg(m).alias(m) for m in CLASSIFIERS]).first()
    accuracy = {m: float("nan") if means[m] is None else means[m] for m in CLASSIFIERS}
    of_all = range(width)
    return Classifiers(
        labels, list(features), breaks, scale, trees.of_lanes(of_all), width,
        [t.of_lanes(range(classes)) for t in rounds], bayes.of_run(0), settings, accuracy,
    )


# ---- regressors -----------------------------------------------------------------


REGRESSORS = ["decision_tree", "random_forest"]


@dataclass
class Regressors:
    """A regression tree and a random forest, with the error they had over the folds."""

    breaks: dict[str, list[float]]
    trees: Trees
    settings: Settings
    unit: float
    rmse: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with one prediction column per regressor."""
        base = named(rows, _row=F.struct(*rows.columns), bins=bins_of(self.breaks))
        return means_of(base, self.trees, 1 + self.settings.trees, "0", self.unit).select("_row.*", *REGRESSORS)


def means_of(rows: DataFrame, trees: Trees, width: int, run: str, unit: float) -> DataFrame:
    """Rows with the leaf mean of the single tree and the mean of the forest's leaf means in a run."""
    table = trees.table(rows.sparkSession, lambda s: [unit * s[1] / s[0] if s[0] else 0.0])
    lane = f"({run} * {width} + t)"
    leaf = f"coalesce(m_value[{lane}][{walk(lane, trees.depth)}][0], 0D)"
    single = f"aggregate(sequence(0, 0), 0D, (a, t) -> a + {leaf})"
    forest = f"aggregate(sequence(1, {width - 1}), 0D, (a, t) -> a + {leaf}) / {width - 1}"
    joined = rows.crossJoin(F.broadcast(table))
    return joined.select(*rows.columns, F.expr(single).alias("decision_tree"), F.expr(forest).alias("random_forest"))


def fit_regressors(
    train: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], folds: int, repeats: int, settings: Settings | None = None,
) -> Regressors:
    """Fit both regressors to all rows and to every fold of every repeat.

    ``rmse`` is the mean over the runs of the error on the fold left out. Rows without a target
    are left out; a missing feature lies in a bin of its own.
    """
    settings = settings or Settings()
    runs = Runs(folds, repeats)
    kept = train.filter(F.col(target).isNotNull())
    breaks = breaks_of(kept, features)
    widest = kept.agg(F.max(F.abs(F.col(target).cast("double")))).first()[0] or 1.0
    unit = widest / UNIT
    rows = named(
        kept, y=F.col(target).cast("double"), bins=bins_of(breaks),
        folds=folds_of(keys, folds, repeats, settings.seed), draws=draws_of(keys, settings.trees, settings.seed),
    )
    width = 1 + settings.trees
    rows = spread_out(rows.withColumn("units", F.round(F.col("y") / unit).cast("bigint")), runs.count * width, len(features))
    some = max(1, -(-len(features) // 3))
    trees = grow_lanes(
        rows.select("bins", "units", "folds", "draws"), runs.count * width, settings.depth,
        histograms.count_and_sum(runs.lanes(width)), 2, squares, first_sum,
        f"if(lane % {width} > 0, {some}, {len(features)})", settings.seed,
    )
    tested = means_of(rows.select("y", "bins", F.explode(F.expr(runs.held_out())).alias("run")), trees, width, "run", unit)
    per_run = tested.groupBy("run").agg(*[F.sqrt(F.avg(F.pow(F.col(m) - F.col("y"), 2))).alias(m) for m in REGRESSORS])
    means = per_run.agg(*[F.avg(m).alias(m) for m in REGRESSORS]).first()
    return Regressors(breaks, trees.of_lanes(range(width)), settings, unit, {m: float("nan") if means[m] is None else means[m] for m in REGRESSORS})
