"""The nearest class mean of every row, for a few classes or for very many.

A few classes are literals of one expression. Many classes are laid along a space-filling curve
and cut into blocks of bounded size, each with its bounding box. Every distinct point first meets
the block whose box is nearest; the distance found there rules out all boxes that lie further
away, and the point meets the ones that are left in one more join. The minimum is exact, the
number of steps does not depend on the number of classes, and equal rows travel once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.ordered import with_position
from stallwise.session import checkpointed

# Up to so many classes are written into the plan.
FEW = 64
# Classes in a block; with more than BOXES blocks the blocks grow instead.
BLOCK, BOXES = 512, 4096
# Bits of the curve, shared by the features.
CURVE_BITS = 60


def squared_distance(own: Sequence[Column], means: Sequence[Column]) -> Column:
    parts = [(a - b) * (a - b) for a, b in zip(own, means, strict=True)]
    return sum(parts[1:], parts[0])


def with_nearest(rows: DataFrame, means: DataFrame, features: Sequence[str], name: str = "pred_value") -> DataFrame:
    """Add the label with the closest mean from ``means`` (label, means); the first label wins a tie.

    A row with a missing feature gets null, as every row does when there are no classes; so
    does a NaN. A class with a missing mean is nobody's nearest.
    """
    known = means.filter(F.forall("means", lambda m: m.isNotNull() & ~F.isnan(m)))
    few = known.limit(FEW + 1).collect()  # at most FEW + 1 rows
    if len(few) > FEW:
        return with_nearest_of_many(rows, known, features, name)
    return rows.withColumn(name, nearest_label([(r["label"], r["means"]) for r in few], features))


def complete(features: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return out


def nearest_label(classes: Sequence[tuple[str, Sequence[float]]], features: Sequence[str]) -> Column:
    """The nearest of some classes as an expression without arrays."""
    if not classes:
        return F.lit(None).cast("string")
    own = [F.col(f).cast("double") for f in features]
    tried = [F.struct(squared_distance(own, [F.lit(m) for m in means]).alias("d"), F.lit(label).alias("label")) for label, means in classes]
    best = tried[0] if len(tried) == 1 else F.least(*tried)
    return F.when(complete(features), best["label"])


def curve_place(means: DataFrame, width: int) -> Column:
    """Place of a class on a Z-curve: the bits of its scaled means in turn, the highest first."""
    bits = max(1, CURVE_BITS // width)
    low, high = (means.agg(*[f(F.col("means")[i]).alias(f"v{i}") for i in range(width)]).first() for f in (F.min, F.max))
    place = F.lit(0).cast("bigint")
    cells = []
    for i in range(min(width, CURVE_BITS)):
        span = (high[i] - low[i]) or 1.0
        cells.append(F.floor((F.col("means")[i] - low[i]) / span * ((1 << bits) - 1)).cast("bigint"))
    for bit in range(bits - 1, -1, -1):
        for cell in cells:
            place = place * 2 + F.shiftright(cell, bit).bitwiseAND(F.lit(1))
    return place


def blocks_of(means: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(block, classes) and the one-row directory of all blocks' boxes."""
    number = means.count()
    size = max(BLOCK, -(-number // BOXES))
    placed = with_position(means.withColumn("_curve", curve_place(means, width)), ["_curve", "label"], "_place")
    blocks = (
        placed.groupBy(F.floor((F.col("_place") - 1) / size).cast("int").alias("block"))
        .agg(
            F.collect_list(F.struct("label", "means")).alias("classes"),  # at most ``size``
            F.array(*[F.min(F.col("means")[i]) for i in range(width)]).alias("low"),
            F.array(*[F.max(F.col("means")[i]) for i in range(width)]).alias("high"),
        )
    )
    blocks = checkpointed(blocks)
    # At most BOXES boxes.
    boxes = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "low", "high"))).alias("boxes"))
    return blocks.select("block", "classes"), boxes


def distance_to_box(own: Sequence[Column], box: Column) -> Column:
    """Squared distance to the nearest point of a box."""
    out = F.lit(0.0)
    for i, x in enumerate(own):
        gap = F.greatest(box["low"][i] - x, x - box["high"][i], F.lit(0.0))
        out = out + gap * gap
    return out


def closest_in(own: Sequence[Column], classes: str) -> Column:
    def tried(c: Column) -> Column:
        return F.struct(squared_distance(own, [c["means"][i] for i in range(len(own))]).alias("d"), c["label"].alias("label"))

    return F.array_min(F.transform(classes, tried))


def with_nearest_of_many(rows: DataFrame, means: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    width = len(features)
    names = [f"_x{i}" for i in range(width)]
    own = [F.col(n) for n in names]
    values = [F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]
    blocks, boxes = blocks_of(means, width)
    points = rows.filter(complete(features)).select(*values).distinct().crossJoin(F.broadcast(boxes))  # one row
    lower = F.transform("boxes", lambda b: F.struct(distance_to_box(own, b).alias("d"), b["block"].alias("block")))
    points = points.select(*names, lower.alias("_lower")).withColumn("block", F.array_min("_lower")["block"])
    home = checkpointed(points.join(blocks, "block").select(*names, "_lower", "block", closest_in(own, "classes").alias("_best")))
    # A box as far as the best so far can still hold an equal distance with a smaller label. Its
    # distance is added up in the same way as that of a class, from smaller parts.
    open_ = F.filter("_lower", lambda b: (b["d"] <= F.col("_best.d")) & (b["block"] != F.col("block")))
    more = (
        home.select(*names, F.explode(open_["block"]).alias("block"))
        .join(blocks, "block")
        .select(*names, closest_in(own, "classes").alias("_best"))
    )
    best = home.select(*names, "_best").unionByName(more).groupBy(*names).agg(F.min("_best").alias("_best"))
    found = best.select(*names, F.col("_best.label").alias(name))
    return rows.select("*", *values).join(found, names, "left").drop(*names)
