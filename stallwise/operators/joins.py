"""Join helpers.

Fact tables may have one key on a third of their rows. No side is marked for
broadcast here: adaptive execution knows the real size of a dimension when it joins
it, broadcasts a small one and splits the hot partitions of a shuffle join
(``stallwise.session``). Tables as long as the facts meet in :func:`join_shuffled`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.nullsafe import blank


def lookup(facts: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Facts with the columns of a dimension; a fact without an entry stays."""
    return facts.join(dim, on, "left")


def join_shuffled(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join of two tables that both grow with the facts; neither is ever broadcast.

    Before a stage has run, its size is guessed from the compressed files it reads, and an
    exploded or staged table would pass for a small one and go through the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which null keys match each other; left's keys are kept."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        same = left[c].eqNullSafe(renamed[f"_r_{c}"])
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def unique_on(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``dim``, or raise if a key value occurs twice."""
    if dim.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"more than one row per {list(keys)}")
    return dim


def keep_matching(rows: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(ids.select(*on).distinct(), list(on), "left_semi")


def keep_unmatched(rows: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(ids.select(*on).distinct(), list(on), "left_anti")


def match_any(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows matching on at least one of several column pairs, each match once.

    An OR of equalities would be a nested loop. Here both sides are read once and
    laid out as (pair, value) rows for one equi join, and a match counts for the first
    of its pairs. Missing and blank values match nothing. The columns of ``right`` must
    not share names with those of ``left``.
    """

    def sides(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        values = [
            F.struct(F.lit(i).alias("_pair"), F.col(c).cast("string").alias("_value"))
            for i, c in enumerate(columns)
        ]
        laid = rows.select(F.struct("*").alias(name), F.inline(F.array(*values)))
        return laid.filter(~blank(F.col("_value")))

    joined = sides(left, [a for a, _ in pairs], "_left").join(
        sides(right, [b for _, b in pairs], "_right"), ["_pair", "_value"]
    )
    earlier = F.lit(False)
    for i, (a, b) in enumerate(pairs):
        mine, other = F.col(f"_left.{a}"), F.col(f"_right.{b}")
        same = F.coalesce((mine == other) & ~blank(mine), F.lit(False))
        earlier = earlier | ((F.col("_pair") > i) & same)
    return joined.filter(~earlier).select("_left.*", "_right.*")
