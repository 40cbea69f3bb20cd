"""Zonal statistics, coordinates and stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import crawl, geo as op
from .registry import ctes, query

# A pixel is a line of an order: zone = supplier, value = quantity, bands = discount and tax.
QA = "CAST(l_partkey % 32 AS INTEGER)"


def pixels(t):
    l = t("lineitem")
    return l.select(
        F.col("l_suppkey").alias("zone"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_linenumber").alias("cls"),
        (F.col("l_partkey") % 8).alias("pixel"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("nir"), F.col("l_tax").alias("red"),
        (F.col("l_partkey") % 32).cast("int").alias("qa"))


@query("masked_zonal_mean", "G1", "zone:l zonal_mean:d10 n_valid:l", """
    SELECT l_suppkey AS zone, avg(l_quantity) FILTER (l_quantity >= 3 AND l_quantity <= 45 AND l_quantity <> 7) AS zonal_mean,
        count(*) FILTER (l_quantity >= 3 AND l_quantity <= 45 AND l_quantity <> 7) AS n_valid FROM lineitem GROUP BY 1""")
def _(t):
    return op.zonal_mean(pixels(t), ["zone"], "value", 3, 45, 7)


@query("zonal_mean_and_std", "G2", "zone:l year:i zonal_mean:d10 zonal_std:d6", """
    SELECT l_suppkey AS zone, year(l_shipdate) AS year, avg(l_discount) FILTER (l_discount BETWEEN 0.01 AND 0.09) AS zonal_mean,
        stddev_pop(l_discount) FILTER (l_discount BETWEEN 0.01 AND 0.09) AS zonal_std FROM lineitem GROUP BY 1, 2""")
def _(t):
    return op.zonal_mean_std(pixels(t), ["zone", "year"], "nir", 0.01, 0.09)


@query("quality_bit_mask", "G3", "zone:l n:l", f"SELECT l_suppkey AS zone, count(*) AS n FROM lineitem WHERE ({QA} & 26) = 0 GROUP BY 1")
def _(t):
    return op.qa_mask(pixels(t), "qa").groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query("normalised_difference", "G4", "zone:l ndvi:d6 n:l", """
    SELECT l_suppkey AS zone, avg(CASE WHEN x + y <> 0 THEN (x - y) / (x + y) END) AS ndvi, count(CASE WHEN x + y <> 0 THEN 1 END) AS n
    FROM (SELECT l_suppkey, l_discount * 2.0 + 0.001 AS x, l_tax * 2.0 + 0.001 AS y FROM lineitem) GROUP BY 1""")
def _(t):
    df = pixels(t).withColumn("v", fn.norm_diff("nir", "red", 2.0, 0.001))
    return df.groupBy("zone").agg(F.avg("v").alias("ndvi"), F.count("v").alias("n"))


@query("median_composite", "G5", "zone:l year:i zonal_mean:d6 zonal_std:d6 n_pixels:l", """
    SELECT zone, year, avg(m) AS zonal_mean, stddev_pop(m) AS zonal_std, count(*) AS n_pixels FROM (
        SELECT l_suppkey AS zone, year(l_shipdate) AS year, l_partkey % 8 AS pixel, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return op.median_composite(pixels(t), ["zone"], ["year"], "pixel", "value")


@query("masked_temporal_mean", "G6", "zone:l year:i month:i masked_mean:d6", """
    SELECT zone, year, month, avg(m) AS masked_mean FROM (SELECT l_suppkey AS zone, year(l_shipdate) AS year, month(l_shipdate) AS month, l_partkey % 8 AS pixel, avg(l_quantity) AS m
        FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def _(t):
    return op.masked_mean(pixels(t), ["zone"], ["year", "month"], "pixel", "value", F.col("nir") < 0.05)


@query("class_percent", "G7", "zone:l pct_1:d6 pct_2:d6 pct_9:d6", """
    SELECT l_suppkey AS zone, count(*) FILTER (l_linenumber = 1) * 100.0 / count(*) AS pct_1, count(*) FILTER (l_linenumber = 2) * 100.0 / count(*) AS pct_2, 0.0 AS pct_9 FROM lineitem GROUP BY 1""")
def _(t):
    return op.class_percent(pixels(t), ["zone"], "cls", [1, 2, 9])


@query("sensor_by_year", "G8", "year:i sensor:s n:l", """
    SELECT year(l_shipdate) AS year, CASE WHEN year(l_shipdate) < 1997 THEN 'L5' WHEN year(l_shipdate) < 2000 THEN 'L8' ELSE 'S2' END AS sensor, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    df = pixels(t).withColumn("sensor", fn.pick_sensor("year", [(1997, "L5"), (2000, "L8")], "S2"))
    return df.groupBy("year", "sensor").agg(F.count(F.lit(1)).alias("n"))


@query("haversine_distance", "G9", "city_sk:l km:d4", ctes("cities", """
    SELECT city_sk, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT city_sk, pow(sin(radians(lat - 40.4) / 2), 2) + cos(radians(40.4)) * cos(radians(lat)) * pow(sin(radians(lon + 3.7) / 2), 2) AS h FROM cities)"""))
def _(t):
    return t.cities().select("city_sk", fn.haversine_km(F.lit(40.4), F.lit(-3.7), "lat", "lon").alias("km"))


@query("mercator_box", "G10", "city_sk:l xmin:l ymin:l xmax:l ymax:l", ctes("cities", """
    SELECT city_sk, trunc(x - 12000) AS xmin, trunc(y - 12000) AS ymin, trunc(x + 12000) AS xmax, trunc(y + 12000) AS ymax
    FROM (SELECT city_sk, radians(lon) * 6378137.0 AS x, ln(tan((90 + lat) * pi() / 360)) * 6378137.0 AS y FROM cities)"""))
def _(t):
    return t.cities().select("city_sk", *[e.alias(n) for n, e in fn.mercator_bbox("lat", "lon", 12).items()])


# ---- pages ------------------------------------------------------------------

HREF = """(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""
LINKS = f"""SELECT page_id, url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{HREF}', 2)) AS body FROM pages"""


@query("page_links", "C1", "page_id:l href:s title:s", f"""
    SELECT page_id, trim(href) AS href, trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM ({LINKS}) WHERE regexp_matches(href, '^/')""")
def _(t):
    return crawl.extract_links(t("pages"), "page_id", "url", "html", "^/")


# The pages hold links from the root only. Their ids give each page one of six forms of the same targets.
FORMS = """CASE page_id % 6 WHEN 1 THEN substr(href, 2) WHEN 2 THEN '//cdn.example.org' || href WHEN 3 THEN 'https://other.example.org' || href
    WHEN 4 THEN '?q=' || substr(href, 2) WHEN 5 THEN '#' || substr(href, 2) ELSE href END"""


@query("absolute_links", "C2", "link_url:s", f"""
    SELECT DISTINCT CASE page_id % 6 WHEN 1 THEN folder || h WHEN 2 THEN scheme || h WHEN 3 THEN h WHEN 4 THEN page || h
        WHEN 5 THEN regexp_replace(url, '#.*$', '') || h ELSE site || h END AS link_url
    FROM (SELECT *, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) AS scheme, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1) AS site,
            CASE WHEN regexp_matches(page, '^[^:]+://[^/]+$') THEN page || '/' ELSE regexp_replace(page, '[^/]*$', '') END AS folder
        FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS page, {FORMS} AS h FROM (SELECT page_id, url, trim(href) AS href FROM ({LINKS}) WHERE starts_with(trim(href), '/'))))""")
def _(t):
    links = crawl.extract_links(t("pages"), "page_id", "url", "html", r"^\s*/")
    return crawl.absolute_urls(links.withColumn("href", F.expr(FORMS)), "url")
