"""Points in intervals by equi joins.

Whole numbers (microseconds) are cut into blocks of 1, 4, 16, ... An interval is the disjoint
union of a few blocks, and a point lies in one block per size. A point is in an
interval exactly when one block is shared, so containment becomes an equality
on (size, block): no range condition, no pair is tried in vain, and every pair
that does match is found once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 18  # largest block: 4**18 microseconds, most of a day


def blocks_of_interval(low: str, high: str) -> Column:
    """Array of (size, block) whose disjoint union is low..high.

    Empty when ``high`` is below ``low``. Per size the blocks in front of the
    first and behind the last larger block are taken, at most three each.
    """
    named = "n -> named_struct('size', k, 'block', n)"

    def first(k: str) -> str:
        return f"shiftright({low} + shiftleft(1L, 2 * ({k})) - 1, 2 * ({k}))"

    def after(k: str) -> str:
        return f"shiftright({high} + 1, 2 * ({k}))"

    begin, end = first("k"), after("k")
    inner_begin, inner_end = f"4 * {first('k + 1')}", f"4 * {after('k + 1')}"
    head_end = f"least({inner_begin}, {end})"
    edges = F.expr(
        f"""flatten(transform(sequence(0, {TOP - 1}), k -> concat(
              transform(if({begin} < {head_end}, sequence({begin}, {head_end} - 1), array()), {named}),
              transform(if({inner_begin} <= {inner_end} and {inner_end} < {end},
                           sequence({inner_end}, {end} - 1), array()), {named})
            )))"""
    )
    begin, end = first(str(TOP)), after(str(TOP))
    middle = F.expr(
        f"""transform(if({begin} < {end}, sequence({begin}, {end} - 1), array()),
                      n -> named_struct('size', {TOP}, 'block', n))"""
    )
    return F.when(F.expr(f"{low} <= {high}"), F.concat(edges, middle))


def blocks_of_point(at: str) -> Column:
    """Array of the (size, block) that hold one number."""
    return F.expr(
        f"transform(sequence(0, {TOP}), k -> "
        f"named_struct('size', k, 'block', shiftright({at}, 2 * k)))"
    )
