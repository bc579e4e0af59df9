"""Filters, reshaping, set steps and keep-first rules shared by the jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.functions.texts import any_of
from stallwise.operators.joins import keep_matching, null_safe_join


def stalls(
    rows: DataFrame,
    names: Sequence[str],
    first_month: str | None = None,
    last_month: str | None = None,
    predicate: Column | None = None,
) -> DataFrame:
    """Rows whose booth or house number contains any of the names, by month."""
    pattern = any_of(names)
    found = rows.filter(F.col("booth_name").rlike(pattern) | F.col("house_no").rlike(pattern))
    if first_month is not None:
        found = found.filter(F.col("month_id") >= first_month)
    if last_month is not None:
        found = found.filter(F.col("month_id") <= last_month)
    if predicate is not None:
        found = found.filter(predicate)
    # All columns sort, so that one busy month can be spread over several tasks.
    return found.orderBy("month_id", *[c for c in found.columns if c != "month_id"])


def of_years(rows: DataFrame, years: Sequence[int]) -> DataFrame:
    return rows.filter(F.substring("month_id", 1, 4).isin([str(y) for y in years]))


def complete_rows(rows: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return rows.na.drop(subset=list(subset) if subset else None)


def complete_kinds(rows: DataFrame, subsets: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """:func:`complete_rows` of several subsets of columns (None: all) by ``kind``; ``rows`` are read once."""
    kinds = []
    for kind, subset in subsets.items():
        full = F.lit(True)
        for c in subset or rows.columns:
            value = F.col(c)
            full = full & value.isNotNull()
            if isinstance(rows.schema[c].dataType, (T.DoubleType, T.FloatType)):
                full = full & ~F.isnan(value)
        kinds.append(F.when(full, F.lit(kind)))
    found = rows.select("*", F.explode(F.array(*kinds)).alias("kind"))
    return found.filter("kind is not null")


def without_texts(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the text columns except the named ones."""
    return rows.select(
        *[f.name for f in rows.schema if f.name in keep or not isinstance(f.dataType, T.StringType)]
    )


def relabel(rows: DataFrame, column: str, labels: Mapping[int, int]) -> DataFrame:
    """Map labels in one step, so that swapped labels do not run into each other."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    mapped = F.try_element_at(F.create_map(*pairs), F.col(column))
    return rows.withColumn(column, F.coalesce(mapped, F.col(column)))


def split_cells(rows: DataFrame, columns: Sequence[str], sep: str = "/") -> DataFrame:
    """One row per part of "a/b" cells; several columns are split in step."""
    parts = [F.split(F.col(c), sep, -1).alias(c) for c in columns]
    split = rows.withColumn("_cell", F.explode_outer(F.arrays_zip(*parts)))
    return split.withColumns({c: F.col("_cell")[c] for c in columns}).drop("_cell")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, by the order columns and then by all others.

    A minimum over whole rows combines on the map side, so a key with very many
    copies does not gather in one task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    ranked = [c for c in order if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*ranked, *rest)).alias("_first"))
    return first.select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in rows.columns]
    )


def latest_per_key(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row with the highest ``by`` of every key; ties by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c != by]
    last = rows.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_last"))
    return last.select(
        *[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in rows.columns]
    )


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key value occurs more than once."""
    often = rows.groupBy(key).count().filter("count > 1")
    return keep_matching(rows, often, [key])


def not_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key value occurs once; missing keys count as one value."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter("_c = 1")
    return null_safe_join(rows, once, [key]).drop("_c")


def with_repeats(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Add whether the row's key value occurs more than once; missing keys count as one value."""
    often = rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias(name))
    return null_safe_join(rows, often, [key])


def month_index(rows: DataFrame, name: str = "month_no") -> DataFrame:
    """Add the ordinal number of the row's month among the months present."""
    # One row per calendar month: the window and the broadcast stay small.
    months = rows.select("month_id").filter("month_id is not null").distinct()
    numbered = months.select("month_id", F.row_number().over(Window.orderBy("month_id")).alias(name))
    return rows.join(F.broadcast(numbered), "month_id", "left")


def wide(
    rows: DataFrame, keys: Sequence[str], column: str, value: str, labels: Sequence[str]
) -> DataFrame:
    """Long to wide with known labels; an absent cell is null."""
    return rows.groupBy(*keys).pivot(column, list(labels)).agg(F.first(value))


def long(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, value: str
) -> DataFrame:
    return rows.unpivot(list(keys), list(columns), label, value)


def hash_split(
    rows: DataFrame, keys: Sequence[str], percent: int, seed: int = 666
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the keys; the same key always falls on the same side."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return rows.filter(slot < percent), rows.filter(slot >= percent)
