"""Null-aware numeric expressions. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

YEAR = 365


def compounded(ret: Column) -> Column:
    """An aggregate: the compounded return; nulls are skipped, and none at all gives 0."""
    return F.coalesce(F.product(1 + ret), F.lit(1.0)) - 1


def growth(ret: Column, window: WindowSpec) -> Column:
    """The running product of 1 + ret; null where ret is null, though later rows go on from before."""
    return F.when(ret.isNotNull(), F.product(1 + ret).over(window))


def complete(value: Column, aggregate: Column, rows: int, window: WindowSpec) -> Column:
    """aggregate over window, or null where it holds fewer than `rows` values."""
    return F.when(F.count(value).over(window) == rows, aggregate.over(window))


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    """a / b, or `otherwise` where b is 0."""
    return F.when(b == 0, F.lit(otherwise)).otherwise(F.try_divide(a, b))
