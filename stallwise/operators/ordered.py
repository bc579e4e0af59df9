"""Order-dependent steps that never put a whole key into one task.

The frames handled here have one row per key and instant, cut into segments
(for example days). A segment holds a bounded number of instants, so windows
run inside segments; what crosses a border is carried by a table with one row
per key and segment. Keys are not null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.operators.joins import join_shuffled
from stallwise.session import checkpointed


def with_neighbours(
    df: DataFrame, keys: Sequence[str], segment: str, at: str
) -> DataFrame:
    """Add ``previous`` and ``next``: the neighbouring instants of the same key.

    Only the first and last row of a segment have a neighbour in another, and that is the
    last or first row there: these rows alone are put in line per key.
    """
    inside = Window.partitionBy(*keys, segment).orderBy(at)
    across = Window.partitionBy(*keys).orderBy(at)
    rows = df.select(
        "*", F.lag(at).over(inside).alias("previous"), F.lead(at).over(inside).alias("next")
    )
    border = F.col("previous").isNull() | F.col("next").isNull()
    borders = rows.filter(border).select(
        *df.columns,
        F.coalesce("previous", F.lag(at).over(across)).alias("previous"),
        F.coalesce("next", F.lead(at).over(across)).alias("next"),
    )
    return rows.filter(~border).unionByName(borders)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    at: str,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values of a key: ``sums`` over the rows up to and with each row, the highest
    ``last`` of the rows before it and the lowest ``first`` of those after it.

    All of them take one pass inside segments, one table of segments and one join.
    """
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    forwards = (F.col, lambda c: F.col(c).desc())
    kinds = [(n, v, F.sum, 0, upto) for n, v in (sums or {}).items()]
    kinds += [(n, v, F.max, 0, before) for n, v in (last or {}).items()]
    kinds += [(n, v, F.min, 1, before) for n, v in (first or {}).items()]

    def window(by: Sequence[str], order: str, way: int, frame: tuple[int, int]):
        return Window.partitionBy(*by).orderBy(forwards[way](order)).rowsBetween(*frame)

    valued = df.select("*", *[v.alias(f"_v_{n}") for n, v, *_ in kinds])
    borders = valued.groupBy(*keys, segment).agg(*[f(f"_v_{n}").alias(f"_t_{n}") for n, _, f, *_ in kinds])
    borders = borders.select(
        *keys, segment, *[f(f"_t_{n}").over(window(keys, segment, way, before)).alias(f"_b_{n}") for n, _, f, way, _ in kinds]
    )
    rows = valued.select(
        "*", *[f(f"_v_{n}").over(window([*keys, segment], at, way, frame)).alias(f"_w_{n}") for n, _, f, way, frame in kinds]
    )
    joined = join_shuffled(rows, borders, [*keys, segment])

    def merged(n: str, f) -> Column:
        border, inside = F.col(f"_b_{n}"), F.col(f"_w_{n}")
        if f is F.sum:
            return F.coalesce(border, F.lit(0)) + inside
        return (F.greatest if f is F.max else F.least)(border, inside)

    return joined.select(*df.columns, *[merged(n, f).alias(n) for n, _, f, *_ in kinds])


def with_running_sums(
    df: DataFrame, keys: Sequence[str], segment: str, at: str, sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per name, the sum over all rows of the key up to and with the row."""
    return with_running(df, keys, segment, at, sums)


def with_extremes(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    at: str,
    last: Mapping[str, Column],
    first: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per name, the highest ``last`` of the rows before and the lowest ``first`` of those after."""
    return with_running(df, keys, segment, at, None, last, first)


def laid_out(df: DataFrame, order: Sequence) -> DataFrame:
    """Sort over the cluster and number the rows inside each sorted partition.

    ``_part`` numbers the partitions in sort order, ``_row`` the rows in one.
    The result is checkpointed: both numbers must not change between the passes
    that read them.
    """
    slot = F.monotonically_increasing_id()
    laid = checkpointed(df.orderBy(*order).withColumn("_slot", slot))
    return laid.select(
        *df.columns,
        F.shiftright("_slot", 33).alias("_part"),
        F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )


def with_position(df: DataFrame, order: Sequence, name: str = "id") -> DataFrame:
    """Add the 1-based place of every row in the given order."""
    laid = laid_out(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sorted partition, so the window and the broadcast are small.
    starts = (
        laid.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    return (
        laid.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row") + 1)
        .select(*df.columns, name)
    )
