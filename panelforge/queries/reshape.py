"""Wide/long, fan-outs, grids, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, reshape as op
from ..operators.ordered_sets import stack
from .registry import ctes, query

YEARS = list(range(1995, 2002))


def wide(t, suffix=""):
    """Country x year sheet with one text column per year."""
    a = t.annual()
    cells = [F.max(F.when(F.col("year") == y, F.concat(F.format_string("%.2f", "amount"), F.lit(suffix)))).alias(str(y)) for y in YEARS]
    return a.groupBy("country").agg(*cells)


LONG = ctes("annual", "SELECT country, year, round(amount, 2) AS value FROM annual")


@query("wide_to_long", "R1", "country:s year:i value:d2", LONG)
def _(t):
    return op.wide_to_long(wide(t), ["country"], [str(y) for y in YEARS], "year", "value")


@query("split_dimensions", "R2", "freq:s unit:s geo:s v:d2", ctes("annual", "SELECT 'A' AS freq, 'EUR_HAB' AS unit, country AS geo, round(amount, 2) AS v FROM annual WHERE year = 1999"))
def _(t):
    head = "freq,unit,geo\\time"
    raw = wide(t).select(F.concat(F.lit("A,EUR_HAB, "), F.col("country")).alias(head), F.col("1999").alias("v"))
    return op.split_dims(raw, head).filter(F.col("v").isNotNull())


@query("statistics_to_long", "R3", "freq:s unit:s region:s year:i value:d2", ctes("annual", "SELECT 'A' AS freq, 'NR' AS unit, country AS region, year, round(amount, 2) AS value FROM annual"))
def _(t):
    raw = wide(t, " p").select(F.concat(F.lit("A,NR,"), F.col("country")).alias("freq,unit,geo\\TIME_PERIOD"), *[F.coalesce(F.col(str(y)), F.lit(":")).alias(str(y)) for y in YEARS])
    return op.sdmx_to_long(raw, "geo")


@query("layout_wide", "R4", "geo:s time:i value:d2", ctes("annual", "SELECT upper(country) AS geo, year AS time, round(amount, 2) AS value FROM annual"))
def _(t):
    return op.normalise_layout(wide(t))


@query("layout_long", "R4", "geo:s time:i value:d4", ctes("annual", "SELECT country AS geo, year AS time, gdp AS value FROM annual"))
def _(t):
    return op.normalise_layout(t.annual().select(F.lower("country").alias("Country"), F.col("year").cast("string").alias("TIME_PERIOD"), F.col("gdp").cast("string").alias("OBS_VALUE")))


@query("emissions_to_long", "R5", "country:s year:i value:d2", ctes("priorities", "SELECT country, year, sum(amount) AS value FROM priorities GROUP BY 1, 2"))
def _(t):
    p = t.priorities()
    cells = [F.max(F.when(F.col("year") == y, F.regexp_replace(F.format_string("%.2f", "amount"), r"\.", ","))).alias(f"Y_{y}") for y in YEARS]
    return op.emissions_to_long(p.groupBy("country", "priority").agg(*cells), "country")


@query("long_to_wide", "R6", "country:s y1995:d4 y1998:d4 y2003:d4", ctes("annual", """
    SELECT country, max(gdp) FILTER (year = 1995) AS y1995, max(gdp) FILTER (year = 1998) AS y1998, CAST(NULL AS DOUBLE) AS y2003 FROM annual GROUP BY 1"""))
def _(t):
    w = op.long_to_wide(t.annual(), "country", "year", "gdp", [1995, 1998, 2003])
    return w.toDF("country", "y1995", "y1998", "y2003")


@query("country_fan_out", "R7", "city_code:s year:i gdp:d4", ctes("annual cities", "SELECT city_code, year, gdp FROM annual JOIN cities ON country = country_code"))
def _(t):
    return op.fan_out(t.annual(), t.cities().withColumnRenamed("country_code", "country"), "country")


@query("month_fan_out", "R8", "country:s year:i month:i gdp:d4", ctes("annual", "SELECT country, year, CAST(m AS INTEGER) AS month, gdp FROM annual, range(1, 13) AS r(m)"))
def _(t):
    return op.fan_months(t.annual())


@query("completed_grid", "R9", "entity:l year:i month:i veg:d8", ctes("panel", """
    SELECT e.entity, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, veg FROM (SELECT DISTINCT entity FROM panel) e, range(1994, 2003) AS a(y), range(1, 13) AS b(m)
    LEFT JOIN panel p ON p.entity = e.entity AND p.year = y AND p.month = m"""))
def _(t):
    return op.complete_grid(t.panel(), ["entity"], {"year": (1994, 2002), "month": (1, 12)})


@query("calendar_months_on_orders", "R10", "date_sk:i year:i month:i month_name:s quarter:i semester:i is_leap_year:b is_satellite_era:b is_early_sensor_era:b n_orders:l", """
    SELECT year(d) * 100 + month(d) AS date_sk, year(d) AS year, month(d) AS month, monthname(d) AS month_name, quarter(d) AS quarter,
        CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS semester, (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS is_leap_year,
        year(d) >= 1998 AS is_satellite_era, year(d) < 2000 AS is_early_sensor_era, count(o_orderkey) AS n_orders
    FROM generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) AS g(d)
    LEFT JOIN orders ON date_trunc('month', o_orderdate) = d GROUP BY d""")
def _(t):
    cal = op.calendar(t.spark, 1995, 2001, satellite_from=1998, early_sensor_until=2000)
    n = t("orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("date_sk")).agg(F.count(F.lit(1)).alias("n_orders"))
    return cal.join(n, "date_sk", "left").fillna(0, ["n_orders"])


@query("calendar_days_wide_on_orders", "R10", "full_date:date date_sk:i week_of_year:i day_of_month:i day_of_week:i day_name:s is_weekend:b fiscal_year:i n_orders:l", """
    SELECT CAST(d AS DATE) AS full_date, year(d) * 100 + month(d) AS date_sk, weekofyear(d) AS week_of_year, day(d) AS day_of_month, isodow(d) AS day_of_week,
        dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend, year(d) AS fiscal_year, count(o_orderkey) AS n_orders
    FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS g(d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d GROUP BY d""")
def _(t):
    cal = op.calendar(t.spark, 1995, 2001, "day", wide=True)
    n = t("orders").groupBy(F.to_date("o_orderdate").alias("full_date")).agg(F.count(F.lit(1)).alias("n_orders"))
    return cal.join(n, "full_date", "left").fillna(0, ["n_orders"])


@query("number_rows", "R11", "sk:l city_code:s", ctes("cities", "SELECT 100 + row_number() OVER (ORDER BY city_code) AS sk, city_code FROM cities"))
def _(t):
    return ordering.number_rows(t.cities(), ["city_code"], 101)


@query("number_rows_all_orders", "R11", "sk:l o_orderkey:l", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS sk, o_orderkey FROM orders")
def _(t):
    return ordering.number_rows(t("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])


@query("reshape_round_trip", "R1 R6 T7", "country:s year:i value:d4", ctes("annual", "SELECT country, year, gdp AS value FROM annual"))
def _(t):
    w = op.long_to_wide(t.annual(), "country", "year", "gdp", YEARS)
    return stack([op.wide_to_long(w, ["country"], [str(y) for y in YEARS], "year", "value")])
