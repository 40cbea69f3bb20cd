"""Business metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import composite_score, recommend, round_scaled


def green_index(df: DataFrame, veg: str, pollutant: str | None, sealing: str | None,
                weights=fv.GREEN_WEIGHTS, out: str = "green_index", bounds: dict | None = None) -> DataFrame:
    """Weighted, table-wide normalised index.

    A missing pollutant counts as the table's lowest value; missing vegetation gives NULL. One
    aggregate finds all bounds and reaches the rows as a scalar subquery; bounds that are known (``lo_`` and ``hi_`` of each
    column) save it.
    """
    terms = [c for c in (veg, pollutant, sealing) if c]
    if bounds is None:
        bounds = df.agg(F.struct(*[x for c in terms for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).alias("b")).scalar()
    else:
        bounds = {k: F.lit(v).cast("double") for k, v in bounds.items()}

    def norm(c, fill):
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        width = F.when(hi != lo, hi - lo).otherwise(F.lit(1.0))
        return ((F.coalesce(F.col(c), lo) if fill else F.col(c)) - lo) / width

    bad = [1.0 - norm(c, True) if c else F.lit(1.0) for c in (pollutant, sealing)]
    value = weights[0] * norm(veg, False) + weights[1] * bad[0] + weights[2] * bad[1]
    return df.withColumn(out, round_scaled(value, 6))


def natural_cover(df: DataFrame, cols: list[str], out: str = "natural_pct") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]))


def score(df: DataFrame, green: str, renewables: str, air: str, carbon: str) -> DataFrame:
    scored = df.withColumn("investment_score", composite_score(green, renewables, air, carbon))
    return scored.withColumn("investment_recommendation", recommend("investment_score"))


def flat_opportunities(df: DataFrame, slope: str, ticker: str, limit: float = 0.01) -> DataFrame:
    """Entities with a flat trend and a listed company."""
    return df.filter((F.abs(F.col(slope)) < limit) & F.col(ticker).isNotNull())


def flat_flag(df: DataFrame, slope: str, limit: float = 0.01, out: str = "turning_point_flag") -> DataFrame:
    return df.withColumn(out, (F.abs(F.col(slope)) < limit).cast("int"))
