"""Interpolation, fills, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as fn
from ..operators import imputation as op
from .registry import ctes, query

KEY = "entity:l year:i month:i"
# Annual series with holes: whole years are missing for some countries.
GAPPY = {"gappy": "SELECT country, year, gdp, n FROM annual WHERE (CAST(substr(country, 2) AS INTEGER) + year) % 3 <> 0"}


def gappy(t):
    return t.annual().filter((F.substring("country", 2, 9).cast("int") + F.col("year")) % 3 != 0).select("country", "year", "gdp", "n")


@query("annual_to_monthly_line", "I1", "country:s year:i month:i monthly:d4", ctes("annual", """
    SELECT country, year, CAST(m AS INTEGER) AS month, gdp + (coalesce(nxt, gdp) - gdp) * (m - 1) / 12.0 AS monthly
    FROM (SELECT *, lead(gdp) OVER (PARTITION BY country ORDER BY year) AS nxt FROM gappy), range(1, 13) AS r(m)""", **GAPPY))
def _(t):
    return op.interp_monthly(gappy(t), "country", "year", "gdp")


BRIDGE = """g AS (SELECT c.country, CAST(y AS INTEGER) AS year, gdp FROM (SELECT DISTINCT country FROM gappy) c, range(1993, 2004) AS r(y) LEFT JOIN gappy a ON a.country = c.country AND a.year = y),
    s AS (SELECT *, last_value(CASE WHEN gdp IS NOT NULL THEN year END IGNORE NULLS) OVER f AS y0, last_value(gdp IGNORE NULLS) OVER f AS v0,
        first_value(CASE WHEN gdp IS NOT NULL THEN year END IGNORE NULLS) OVER b AS y1, first_value(gdp IGNORE NULLS) OVER b AS v1 FROM g
        WINDOW f AS (PARTITION BY country ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY country ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def bridge(body):
    head = ctes("annual", "", **GAPPY).rstrip()
    return f"{head}, {BRIDGE} {body}"


@query("grid_interpolation_held_ends", "I2", "country:s year:i gdp:d4", bridge(
    "SELECT country, year, CASE WHEN y0 = y1 THEN v0 WHEN y0 IS NULL THEN v1 WHEN y1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (year - y0) / (y1 - y0) END AS gdp FROM s"))
def _(t):
    return op.interp_grid(gappy(t), "country", "year", "gdp", 1993, 2003)


@query("interior_interpolation", "I3", "country:s year:i gdp:d4", bridge(
    "SELECT country, year, CASE WHEN y0 = y1 THEN v0 ELSE v0 + (v1 - v0) * (year - y0) / (y1 - y0) END AS gdp FROM s"))
def _(t):
    grid = gappy(t).select("country").distinct().withColumn("year", F.explode(F.sequence(F.lit(1993), F.lit(2003))))
    return op.interp_interior(gappy(t), grid, "country", "year", "gdp")


@query("nearest_year_fill", "I7", "country:s year:i gdp:d4", bridge(
    "SELECT country, year, CASE WHEN y0 IS NOT NULL AND (y1 IS NULL OR year - y0 <= y1 - year) THEN v0 ELSE v1 END AS gdp FROM s"))
def _(t):
    grid = gappy(t).select("country").distinct().withColumn("year", F.explode(F.sequence(F.lit(1993), F.lit(2003))))
    return op.impute_nearest_year(gappy(t), grid, "country", "year", "gdp")


@query("group_mean_fill", "I4", f"{KEY} veg:d8", ctes("holed", "SELECT entity, year, month, coalesce(veg, avg(veg) OVER (PARTITION BY entity, year)) AS veg FROM holed"))
def _(t):
    return op.impute_group_mean(t.holed(), ["entity", "year"], ["veg"])


@query("base_year_fill", "I5", "entity:l year:i seal:d8", ctes("entity_year", """
    SELECT entity, year, coalesce(x, max(x) FILTER (year = 1998) OVER (PARTITION BY entity)) AS seal FROM (SELECT entity, year, CASE WHEN year IN (1998, 2000) THEN seal END AS x FROM entity_year)"""))
def _(t):
    ey = t.holed().groupBy("entity", "year").agg(F.avg("seal").alias("seal")).withColumn("seal", F.when(F.col("year").isin(1998, 2000), F.col("seal")))
    return op.impute_base_year(ey, "entity", "year", 1998, ["seal"])


@query("median_fill", "I6", f"{KEY} veg:d8 empty:d8", ctes("holed", "SELECT entity, year, month, coalesce(veg, (SELECT median(veg) FROM holed)) AS veg, 0.0 AS empty FROM holed"))
def _(t):
    return op.impute_median(t.holed().withColumn("empty", F.lit(None).cast("double")), ["veg", "empty"])


@query("group_median_fill", "I6 I19", f"{KEY} veg:d8", ctes("holed", """
    SELECT entity, h.year, month, coalesce(veg, m.med, 0) AS veg FROM holed h LEFT JOIN (SELECT year, median(veg) AS med FROM holed GROUP BY 1) m ON m.year = h.year"""))
def _(t):
    return op.impute_median(t.holed(), ["veg"], ["year"])


@query("second_sensor_fill", "I8", f"{KEY} veg:d8", ctes("holed panel", """
    SELECT h.entity, h.year, h.month, CASE WHEN h.veg IS NULL AND h.year < 1999 THEN p.veg ELSE h.veg END AS veg FROM holed h LEFT JOIN panel p USING (entity, year, month)"""))
def _(t):
    return op.fill_from(t.holed().select("entity", "year", "month", "veg"), t.panel(), ["entity", "year", "month"], "veg", F.col("year") < 1999)


def lights(t):
    p = t.panel()
    old = p.filter("year <= 1998").select("entity", "year", "month", F.col("pol").alias("ntl"), F.lit("DMSP").alias("sensor"))
    new = p.filter("year >= 1997 AND entity % 9 <> 0").select("entity", "year", "month", F.col("seal").alias("ntl"), F.lit("VIIRS").alias("sensor"))
    return old.unionByName(new)


@query("sensor_harmonisation", "I9 G8", f"{KEY} ntl:d6 sensor:s", ctes("panel", """
    SELECT a.entity, year, CAST(m AS INTEGER) AS month, ntl * coalesce(CASE WHEN o > 0 AND n <> 0 THEN n / o END, 3.5) AS ntl, 'DMSP' AS sensor FROM
        (SELECT entity, year, avg(pol) AS ntl FROM panel WHERE year <= 1998 GROUP BY 1, 2) a
        LEFT JOIN (SELECT entity, avg(pol) FILTER (year BETWEEN 1997 AND 1998) AS o, avg(seal) FILTER (year BETWEEN 1997 AND 1998 AND entity % 9 <> 0) AS n FROM panel GROUP BY 1) r ON r.entity = a.entity,
        range(1, 13) AS x(m) UNION ALL SELECT entity, year, month, seal, 'VIIRS' FROM panel WHERE year >= 1997 AND entity % 9 <> 0"""))
def _(t):
    return op.harmonise_sensors(lights(t), "entity", "year", "month", "ntl", "sensor", "DMSP", "VIIRS", [1997, 1998])


INDEX_VALUES = ", ".join(f"({m}, {w})" for m, w in fv.CARBON_MONTH_INDEX.items())


@query("seasonal_disaggregation", "I10", "country:s year:i month:i gdp:d2", ctes("annual", f"SELECT country, year, m AS month, round(gdp * w, 4) AS gdp FROM annual, (VALUES {INDEX_VALUES}) AS i(m, w)"))
def _(t):
    return op.disaggregate(t.annual(), "gdp")


@query("series_cascade", "I11", "country:s year:i gdp:d4 source:s", ctes("annual", """
    SELECT country, year, gdp, CASE WHEN country < 'N14' THEN 'METRO' WHEN country < 'N2' THEN 'REGION' ELSE 'NATIONAL' END AS source FROM annual
    WHERE (country < 'N14' AND year > 1997) OR (country >= 'N14' AND country < 'N2' AND year < 2000) OR country >= 'N2'"""))
def _(t):
    a = t.annual().select("country", "year", "gdp")
    frames = [("METRO", a.filter("country < 'N14' AND year > 1997")), ("REGION", a.filter("country < 'N2' AND year < 2000")), ("NATIONAL", a)]
    return op.cascade_series(frames, "country")


@query("cell_cascade", "I12", "country:s year:i gdp:d4 source:s", ctes("annual", """
    SELECT country, year, CASE WHEN country < 'N14' AND year > 1997 THEN gdp WHEN country < 'N2' THEN gdp * 2 END AS gdp,
        CASE WHEN country < 'N14' AND year > 1997 THEN 'OWN' WHEN country < 'N2' THEN 'OTHER' END AS source FROM annual"""))
def _(t):
    a = t.annual().select("country", "year", "gdp")
    other = a.filter("country < 'N2'").withColumn("gdp", F.col("gdp") * 2)
    return op.cascade_cells([("OWN", a.filter("country < 'N14' AND year > 1997")), ("OTHER", other)], ["country", "year"], "gdp", base=a)


@query("missing_reason", "I13 I15", f"{KEY} price:d4 reason:s", ctes("holed", """
    SELECT entity, year, month, CASE WHEN year >= 1998 AND veg IS NOT NULL THEN price END AS price,
        CASE WHEN year < 1998 THEN 'NO_MARKET' WHEN veg IS NULL THEN 'MISSING' END AS reason FROM holed"""))
def _(t):
    df = t.holed().withColumn("price", F.when(F.col("veg").isNotNull(), F.col("price")))
    df = df.withColumn("price", fn.valid_from("price", "year", 1998))
    return df.withColumn("reason", fn.missing_reason("price", "year", 1998))


@query("parse_any_date", "I14", "k:l d:date", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(
        k % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise("n/a")
    return t("orders").select(k.alias("k"), fn.parse_any_date(text, ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]).alias("d"))


@query("preferred_category", "I16", "o_orderkey:l o_orderpriority:s", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(t):
    return op.prefer_category(t("orders"), "o_orderpriority", ["0-NONE", "2-HIGH", "1-URGENT"])


@query("first_non_empty_source", "I17", "c_custkey:l", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return op.first_non_empty([c.filter("c_mktsegment = 'NOWHERE'"), c.filter("c_mktsegment = 'BUILDING'"), c])


@query("station_country_blend", "I18", "entity:l year:i month:i v:d4 source:s", ctes("holed cities annual", """
    SELECT entity, year, month, veg AS v, 'STATION' AS source FROM holed WHERE veg IS NOT NULL UNION ALL
    SELECT city_sk, year, CAST(m AS INTEGER), gdp, 'COUNTRY' FROM cities JOIN annual ON country = country_code, range(1, 13) AS r(m)
    WHERE (city_sk, year, m) NOT IN (SELECT (entity, year, CAST(month AS BIGINT)) FROM holed WHERE veg IS NOT NULL)"""))
def _(t):
    own = t.holed().filter("veg IS NOT NULL").select("entity", "year", "month", F.col("veg").alias("v"))
    country = t.annual().select("country", "year", F.col("gdp").alias("v"))
    members = t.cities().select(F.col("city_sk").alias("entity"), F.col("country_code").alias("country"))
    return op.blend(own, country, members, "entity", "country", ["entity", "year", "month"], "v")


@query("coverage_gate", "I20", f"{KEY}", ctes("holed", "SELECT entity, year, month FROM (SELECT *, count(veg) OVER (PARTITION BY entity, year) AS k FROM holed) WHERE k >= 10"))
def _(t):
    return op.coverage_gate(t.holed(), "entity", "year", "veg", 10)


@query("cluster_median_fill", "I19", "entity:l year:i seal:d6", ctes("holed cities", """
    SELECT entity, h.year, avg(coalesce(seal, med, 0)) AS seal FROM holed h JOIN cities ON entity = city_sk
    LEFT JOIN (SELECT country_code AS c, median(seal) AS med FROM holed JOIN cities ON entity = city_sk GROUP BY 1) m ON c = country_code GROUP BY 1, 2"""))
def _(t):
    df = t.holed().select("entity", "year", "seal").join(t.cities().select(F.col("city_sk").alias("entity"), "country_code"), "entity")
    return op.impute_median(df, ["seal"], ["country_code"]).groupBy("entity", "year").agg(F.avg("seal").alias("seal"))

