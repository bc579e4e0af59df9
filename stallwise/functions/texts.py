"""Text rules on columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallwise.functions.nullsafe import blank

# Fixed value: the pattern of a floor mark inside a booth description.
FLOOR_MARK = "([一-龥]|\\d)楼"
# Fixed value: the pattern a readable promotion start has to contain.
DAY_PATTERN = "[\\d]{4}-[\\d]{2}-[\\d]{2}"
# Fixed value: the prefix that completes a dealer number from the survey sheet.
DEALER_PREFIX = "00"
# Shop-name text and the lease that an order without a code belongs to.
LEASE_BY_SHOP_TEXT = {
    "波比": "0203010009980",
    "方太": "0203010009892",
    "Kids&Teen": "0203010010490",
    "玫瑰佳缘": "0203010010225",
    "圣象强化地板": "0203010010534",
    "法恩莎卫浴": "0203010010375",
    "家倍得": "0203010010149",
}
# Category text and the edited category that replaces it.
EDITED_CATEGORY = {
    "青少年家具/儿童家具/儿童家具/儿童家具/儿童家具/儿童家具": "青少年家具",
    "儿童家具/儿童家具/青少年家具/儿童家具/儿童家具/青少年家具/儿童家具/青少年家具": "青少年家具",
    "全屋定制/板木/实木/实木": "板木",
}


def prefixed(prefix: Column, value: Column) -> Column:
    """Prefix and value in one text; null if either is null."""
    return F.concat(prefix, value)


def zero_padded(prefix: Column, number: Column) -> Column:
    """Five-character numbers follow the prefix directly, others after a zero."""
    return F.when(F.length(number) == 5, F.concat(prefix, number)).otherwise(
        F.concat(prefix, F.lit("0"), number)
    )


def dealer_code(number: Column) -> Column:
    return F.concat(F.lit(DEALER_PREFIX), number.cast("string"))


def any_of(words: Iterable[str]) -> str:
    """Regular expression that finds any of the given words."""
    return "|".join(re.escape(w) for w in words)


def floor_mark(description: Column) -> Column:
    """The floor mark of a description, or null where there is none."""
    return F.regexp_substr(description, F.lit(FLOOR_MARK))


def lines(*values: Column) -> Column:
    """Texts below each other, nulls left out."""
    return F.concat_ws("\n", *values)


def contains_any(value: Column, words: Sequence[str]) -> Column:
    return value.rlike(any_of(words))


def filled_code(code: Column, shop_name: Column, rules: Mapping[str, str]) -> Column:
    """Replace a blank code by the code of the first rule found in the shop name.

    A null code stays null: such orders belong to no lease.
    """
    found = F.lit(None).cast("string")
    for text, lease in reversed(list(rules.items())):
        found = F.when(shop_name.contains(text), F.lit(lease)).otherwise(found)
    return F.when(code.isNotNull() & blank(code), F.coalesce(found, code)).otherwise(code)
