"""Window operators over entity series.

Each runs on a table at entity x period grain, so one window partition is bounded by the
calendar however many raw rows an entity has. Ranks across entities live in ``ordering``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cleaning import latest  # noqa: F401  (W1 belongs to this family)
from .ordering import rank_in  # noqa: F401


def change(df: DataFrame, entity: str, order: list[str], rank: str, score: str) -> DataFrame:
    """Places gained (positive is better) and score gained since the entity's previous period."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({
        "rank_change": F.lag(rank).over(w) - F.col(rank),
        "score_change": F.col(score) - F.lag(score).over(w),
    })


def _year_before(c: str, entity: str, year: str, month: str | None, strict: bool) -> Column:
    w = Window.partitionBy(entity, *([month] if month else [])).orderBy(year)
    before = F.lag(c).over(w)
    return F.when(F.lag(year).over(w) == F.col(year) - 1, before) if strict else before


def yoy_diff(df: DataFrame, entity: str, year: str, month: str | None, c: str, out: str = "yoy_diff",
             strict: bool = False) -> DataFrame:
    """Difference to the previous stored year of the same month; ``strict`` needs adjacent years."""
    return df.withColumn(out, F.col(c) - _year_before(c, entity, year, month, strict))


def yoy_pct(df: DataFrame, entity: str, year: str, month: str | None, c: str, out: str = "yoy_pct",
            strict: bool = False) -> DataFrame:
    return df.withColumn(out, (F.try_divide(F.col(c), _year_before(c, entity, year, month, strict)) - 1) * 100)


def pct_change(df: DataFrame, keys: list[str], order: list[str], c: str, periods: int = 4,
               out: str = "pct_change") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, (F.try_divide(F.col(c), F.lag(c, periods).over(w)) - 1) * 100)


def simple_return(df: DataFrame, keys: list[str], order: list[str], price: str, out: str = "simple_return") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.try_divide(F.col(price), F.lag(price).over(w)) - 1)


def fill(df: DataFrame, keys: list[str], order: list[str], c: str, backward: bool = False, out: str | None = None) -> DataFrame:
    """Carry the last known value forward, and optionally the next one back to the start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    value = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if backward:
        value = F.coalesce(value, F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return df.withColumn(out or c, value)


def next_value(df: DataFrame, keys: list[str], order: list[str], c: str, out: str = "next_value") -> DataFrame:
    """Next stored value; the last row keeps its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(out, F.when(last, F.col(c)).otherwise(F.lead(c).over(w)))


def first_rise(df: DataFrame, keys: list[str], order: str, c: str, out: str = "first_rise") -> DataFrame:
    """First period whose value is above the one before; NULL where none is."""
    w = Window.partitionBy(*keys).orderBy(order)
    rises = df.withColumn("_up", F.col(c) > F.lag(c).over(w))
    return rises.groupBy(*keys).agg(F.min(F.when(F.col("_up"), F.col(order))).alias(out))
