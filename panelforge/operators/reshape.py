"""Wide/long reshaping, fan-outs, grids and calendars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import date_key, norm_code, to_int, to_number
from .cleaning import pick_column


def year_columns(columns: list[str], pattern: str = r"(19|20)\d{2}") -> list[str]:
    return [c for c in columns if re.fullmatch(pattern, c.strip())]


def wide_to_long(df: DataFrame, id_cols: list[str], value_cols: list[str], name: str = "name",
                 value: str = "value") -> DataFrame:
    """One row per id and value column; NULL values are dropped."""
    flat = df.unpivot([F.col(f"`{c}`") for c in id_cols], [F.col(f"`{c}`") for c in value_cols], name, value)
    return flat.filter(F.col(value).isNotNull())


def split_dims(df: DataFrame, header_col: str) -> DataFrame:
    r"""``freq,unit,geo\time`` to one column per dimension named in the header."""
    dims = [d.strip() for d in header_col.split("\\")[0].split(",") if d.strip()]
    parts = F.split(F.col(f"`{header_col}`"), ",")
    columns = [F.trim(F.get(parts, F.lit(i))).alias(d) for i, d in enumerate(dims)]
    return df.select(*columns, *[F.col(f"`{c}`") for c in df.columns if c != header_col])


def sdmx_to_long(df: DataFrame, region_hint: str) -> DataFrame:
    """Compound-header statistical file to (dims…, region, year, value)."""
    years = year_columns(df.columns)
    flat = split_dims(df, df.columns[0])
    region = pick_column(flat.columns, [region_hint, "metroreg", "geo"])
    if region is None or not years:
        raise ValueError("no region dimension or no year columns")
    dims = [c for c in flat.columns if c not in years]
    # The raw header may carry blanks around the year.
    value_cols = [c for c in df.columns if c in years]
    long = wide_to_long(flat, dims, value_cols, "year", "value")
    out = long.withColumns({"year": to_int("year"), "value": to_number("value")}).withColumnRenamed(region, "region")
    return out.dropna(subset=["region", "year", "value"])


def normalise_layout(df: DataFrame, geo: list[str] = fv.GEO_COLUMNS, time: list[str] = fv.TIME_COLUMNS,
                     value: list[str] = fv.VALUE_COLUMNS) -> DataFrame:
    """Wide (three or more year columns) or long file to (geo, time, value)."""
    years = year_columns(df.columns)
    geo_col = pick_column(df.columns, geo)
    if geo_col is None:
        raise ValueError("no geography column")
    if len(years) >= 3:
        flat = wide_to_long(df.select(geo_col, *[F.col(f"`{y}`").cast("string").alias(y) for y in years]), [geo_col], years, "time", "value")
        time_col, value_col = "time", "value"
    else:
        flat, time_col, value_col = df, pick_column(df.columns, time), pick_column(df.columns, value)
        if time_col is None or value_col is None:
            raise ValueError("no time or value column")
    out = flat.select(
        norm_code(geo_col).alias("geo"), to_int(time_col).alias("time"),
        F.col(value_col).try_cast("double").alias("value"),
    )
    return out.dropna()


def emissions_to_long(df: DataFrame, code_col: str, year_regex: str = r"Y_(\d{4})") -> DataFrame:
    """Year-column sheet with one row per code and sector to one total per code and year."""
    cols = [c for c in df.columns if re.fullmatch(year_regex, c)]
    long = wide_to_long(df.select(code_col, *[F.col(c).cast("string").alias(c) for c in cols]), [code_col], cols, "y", "v")
    amount = F.regexp_replace("v", ",", ".").try_cast("double")
    return (
        long.select(code_col, to_int("y").alias("year"), amount.alias("v"))
        .groupBy(code_col, "year").agg(F.sum("v").alias("value"))
    )


def long_to_wide(df: DataFrame, key: str, c: str, value: str, domain: list) -> DataFrame:
    """One column per value of a stated domain; missing ones are NULL."""
    return df.groupBy(key).pivot(c, list(domain)).agg(F.avg(value))


def fan_out(df: DataFrame, members: DataFrame, group_col: str) -> DataFrame:
    """Give a group's row to each of its members."""
    return df.join(members, group_col, "inner")


def fan_months(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def complete_grid(df: DataFrame, keys: list[str], domains: dict[str, tuple[int, int]]) -> DataFrame:
    """All keys x stated integer ranges, with the given rows joined on."""
    grid = df.select(*keys).distinct()
    for name, (lo, hi) in domains.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return grid.join(df, keys + list(domains), "left")


def calendar(spark, start_year: int, end_year: int, grain: str = "month", satellite_from: int = 2004,
             early_sensor_until: int = 2018, wide: bool = False) -> DataFrame:
    """Month (or day) calendar keyed YYYYMM; the wide form adds week and weekday columns."""
    step = {"month": "interval 1 month", "day": "interval 1 day"}[grain]
    days = spark.range(1).select(F.explode(F.expr(
        f"sequence(date'{start_year}-01-01', date'{end_year}-12-31', {step})")).alias("full_date"))
    y, m = F.year("full_date"), F.month("full_date")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    narrow = {
        "date_sk": date_key(y, m), "year": y, "month": m,
        "month_name": F.date_format("full_date", "MMMM"),
        "quarter": F.quarter("full_date"), "semester": F.when(m <= 6, 1).otherwise(2),
        "is_leap_year": leap, "is_satellite_era": y >= satellite_from,
        "is_early_sensor_era": y < early_sensor_until,
    }
    iso = F.weekday("full_date") + 1
    extra = {
        "week_of_year": F.weekofyear("full_date"), "day_of_month": F.dayofmonth("full_date"),
        "day_of_week": iso, "day_name": F.date_format("full_date", "EEEE"),
        "is_weekend": iso >= 6, "fiscal_year": y,
    }
    chosen = {**narrow, **extra} if wide else narrow
    return days.select("full_date", *[e.alias(n) for n, e in chosen.items()])
