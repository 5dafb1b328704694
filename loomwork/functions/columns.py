"""Column helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ratio(a, b) -> Column:
    """a / b as double; null if b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def finite(c: Column, nan=0.0, high=50.0, low=0.0) -> Column:
    """NaN, infinity and minus infinity replaced."""
    return F.when(F.isnan(c), nan).when(c == float("inf"), high).when(c == float("-inf"), low).otherwise(c)


def dot(a: str, b: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rolling(partition: list[str], order: str, size: int):
    """A positional window of size rows that ends at the row."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(-(size - 1), 0)


def grid(*axes: DataFrame) -> DataFrame:
    """The complete cross product of small axes (distinct topics, countries, years)."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def densify(df: DataFrame, axes: list[DataFrame], fill: dict[str, object]) -> DataFrame:
    """df left-joined to the product of axes, with missing values filled."""
    keys = [c for a in axes for c in a.columns]
    return grid(*axes).join(df, keys, "left").fillna(fill)


def rank_average(value: str, partition: list[str] | None = None, descending: bool = False) -> Column:
    """Mean rank of ties, nulls last."""
    w = Window.partitionBy(*(partition or []))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*(partition or []), value)) - 1) / 2
