"""Zonal statistics over pixel tables: (zone, ts, pixel, band values...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv


def _valid(value: str, lo: float | None, hi: float | None, nodata: float | None = None) -> Column:
    tests = [F.col(value).isNotNull()]
    if lo is not None:
        tests.append(F.col(value) >= lo)
    if hi is not None:
        tests.append(F.col(value) <= hi)
    if nodata is not None:
        tests.append(F.col(value) != nodata)
    return reduce(lambda a, b: a & b, tests)


def zonal_mean(pixels: DataFrame, zone: list[str], value: str, lo: float = 0, hi: float = 100,
               nodata: float | None = 255, out: str = "zonal_mean") -> DataFrame:
    v = F.when(_valid(value, lo, hi, nodata), F.col(value))
    return pixels.groupBy(*zone).agg(F.avg(v).alias(out), F.count(v).alias("n_valid"))


def zonal_mean_std(pixels: DataFrame, zone: list[str], value: str, lo: float = -1, hi: float = 1) -> DataFrame:
    v = F.when(_valid(value, lo, hi), F.col(value))
    return pixels.groupBy(*zone).agg(F.avg(v).alias("zonal_mean"), F.stddev_pop(v).alias("zonal_std"))


def qa_mask(pixels: DataFrame, qa: str, bits: list[int] = fv.CLOUD_BITS) -> DataFrame:
    """Only pixels with none of the quality bits set."""
    return pixels.filter(F.col(qa).bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0)


def median_composite(pixels: DataFrame, zone: list[str], period: list[str], pixel: str, value: str) -> DataFrame:
    """Median over time for each pixel, then mean and population std over a zone's pixels.

    A pixel's values in a period are as many as its scenes, so each median is one bounded aggregate.
    """
    per = pixels.groupBy(*zone, *period, pixel).agg(F.median(value).alias("_median"))
    return per.groupBy(*zone, *period).agg(
        F.avg("_median").alias("zonal_mean"), F.stddev_pop("_median").alias("zonal_std"), F.count("_median").alias("n_pixels"))


def masked_mean(pixels: DataFrame, zone: list[str], period: list[str], pixel: str, value: str, predicate: Column) -> DataFrame:
    """Mean over time for each unmasked pixel, then over the zone."""
    per = pixels.filter(predicate).groupBy(*zone, *period, pixel).agg(F.avg(value).alias("_m"))
    return per.groupBy(*zone, *period).agg(F.avg("_m").alias("masked_mean"))


def class_percent(pixels: DataFrame, zone: list[str], cls: str, classes: list) -> DataFrame:
    """Percent of a zone's pixels in each class; a class that does not occur is 0."""
    shares = [(F.count_if(F.col(cls) == k) / F.count(cls) * 100).alias(f"pct_{k}") for k in classes]
    return pixels.groupBy(*zone).agg(*shares)
