"""Small column helpers used by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(c: Column, rungs: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first rung (threshold, value) that ``c`` reaches; null counts as reaching none."""
    out = None
    for at, value in rungs:
        out = F.when(c >= at, value) if out is None else out.when(c >= at, value)
    return out.otherwise(otherwise)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def truthy(c: Column, kind: str) -> Column:
    """What a dynamic language takes for true: not null, 0, '' or false."""
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(c.cast("boolean"), F.lit(False))


def capped(c: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), c)


def ordinal(c: Column, members: Sequence[str]) -> Column:
    """The declaration position of an enum member, by which databases sort enums; null for others."""
    return F.when(c.isin(*members), F.array_position(F.array(*map(F.lit, members)), c))


def epoch_hours(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600
