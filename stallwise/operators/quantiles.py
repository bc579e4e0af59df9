"""Exact quantiles (linear interpolation) without sorting a column or gathering a group.

One pass sketches every group, which puts each wanted rank between two values that only a few
ten-thousandths of the group lie between. A second pass counts what lies below, between and above
these values and keeps the values in between apart; only those are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.operators.joins import null_safe_join
from stallwise.session import checkpointed

OCTILES = [i / 8 for i in range(9)]
# The sketch's rank error is 1 / ACCURACY of the group; the bounds leave four times as much on either side.
ACCURACY = 10_000
# Groups of so few rows are ranked whole.
SMALL = 20_000


def probes_of(probs: Sequence[float]) -> list[float]:
    """What the sketch is asked: a little below and above every wanted share."""
    margin = 4 / ACCURACY
    return [min(1.0, max(0.0, p + m)) for p in probs for m in (-margin, margin)]


# Array of (low, high) around the wanted ranks of a group of ``n`` with the sketch's answers.
AROUND = """if(n <= {small}, array(struct(double('-infinity') AS low, double('infinity') AS high)),
    transform(sequence(0, size(_sketch) div 2 - 1), i -> struct(_sketch[2 * i] AS low, _sketch[2 * i + 1] AS high)))"""
KEPT = "exists(_between, b -> _v >= b.low AND _v <= b.high)"
ZONE = "size(filter(_between, b -> b.low <= _v)) + size(filter(_between, b -> b.high < _v))"
# The ranks that a share needs, of these the ones among the places _to - _n up to _to.
WANTED = """filter(array_distinct(flatten(transform({probs}, p -> array(
    struct(p AS _p, (n - 1) * p AS _h, floor((n - 1) * p) AS _rank), struct(p AS _p, (n - 1) * p AS _h, ceil((n - 1) * p) AS _rank))))),
    w -> w._rank >= _to - _n AND w._rank < _to)"""


def group_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with ``n`` and the array ``quantiles``.

    Missing values and NaN do not count; a group without a value has no row. ``df`` is read twice.
    """
    by = list(by)
    groups = by or ["_all"]
    source = df.select(*by, *([] if by else [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v"))
    source = source.filter("_v is not null and not isnan(_v)")
    sketched = source.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", probes_of(probs), ACCURACY).alias("_sketch")
    )
    sketched = sketched.select(*groups, "n", F.expr(AROUND.format(small=SMALL)).alias("_between"))

    # Zones follow each other by value; in each either all values are kept or none.
    counted = (
        null_safe_join(source, sketched, groups)
        .select(*groups, "n", F.expr(ZONE).alias("_zone"), F.when(F.expr(KEPT), F.col("_v")).alias("_v"))
        .groupBy(*groups, "n", "_zone", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy(*groups).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = (
        counted.groupBy(*groups, "_zone")
        .agg(F.sum("_n").alias("_size"))
        .select(*groups, "_zone", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*groups, "_zone").orderBy("_v")
    placed = null_safe_join(counted, zones, [*groups, "_zone"]).withColumn(
        "_to", F.col("_start") + F.sum("_n").over(inside)
    )
    shares = "array(" + ", ".join(f"double('{float(p)!r}')" for p in probs) + ")"
    hit = placed.select(*groups, "n", "_v", F.inline(F.expr(WANTED.format(probs=shares))))
    # Cannot happen while the sketch keeps its bound; a wrong value must not pass.
    lost = F.raise_error(F.lit("a quantile lies outside the sketch's bounds"))
    sure = F.when(F.col("_v").isNull(), lost.cast("double")).otherwise(F.col("_v"))
    one = hit.groupBy(*groups, "n", "_p", "_h").agg(F.min(sure).alias("_lo"), F.max(sure).alias("_hi"))
    one = one.withColumn(
        "_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    )
    out = one.groupBy(*groups, "n").agg(
        F.array_sort(F.collect_list(F.struct("_p", "_q"))).alias("_all_q")
    )
    return out.select(*by, "n", F.col("_all_q._q").alias("quantiles"))


def breaks(df: DataFrame, value: str, probs: Sequence[float] = OCTILES) -> list[float]:
    """Quantiles of a whole column as numbers; empty when there is no value."""
    found = group_quantiles(df, value, probs).first()
    return list(found["quantiles"]) if found else []


def with_group_median(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Add the median of ``value`` over the rows of the same group.

    Meant for summed tables: the rows are written once and read twice.
    """
    df = checkpointed(df)
    medians = group_quantiles(df, value, [0.5], by).select(
        *by, F.col("quantiles")[0].alias(name)
    )
    if by:
        return null_safe_join(df, medians, list(by), "left")
    found = medians.first()
    return df.withColumn(name, F.lit(found[name] if found else None).cast("double"))
