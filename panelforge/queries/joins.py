"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as op
from .registry import ctes, query

KEYS = ["entity", "year", "month"]


@query("attach_monthly_sides", "J1", "entity:l year:i month:i veg:d8 pol:d8 seal:d8", ctes("holed", """
    SELECT b.entity, b.year, b.month, b.veg, p.pol, s.seal FROM holed b LEFT JOIN (SELECT * FROM holed WHERE year < 2000) p USING (entity, year, month)
    LEFT JOIN (SELECT * FROM holed WHERE month <= 6) s USING (entity, year, month)"""))
def _(t):
    h = t.holed()
    return op.attach(h.select(*KEYS, "veg"), [h.filter("year < 2000").select(*KEYS, "pol"), h.filter("month <= 6").select(*KEYS, "seal")], KEYS)


@query("attach_annual_side", "J2", "entity:l year:i month:i veg:d8 seal_year:d8", ctes("holed entity_year", """
    SELECT h.entity, h.year, month, h.veg, e.seal AS seal_year FROM holed h LEFT JOIN entity_year e USING (entity, year)"""))
def _(t):
    yearly = t.holed().groupBy("entity", "year").agg(F.avg("seal").alias("seal_year"))
    return op.attach(t.holed().select(*KEYS, "veg"), [yearly], ["entity", "year"])


@query("attach_country_side", "J3", "entity:l year:i month:i country:s gdp:d4", ctes("panel cities annual", """
    SELECT entity, panel.year, month, country_code AS country, gdp FROM panel JOIN cities ON entity = city_sk LEFT JOIN annual a ON a.country = country_code AND a.year = panel.year"""))
def _(t):
    base = t.panel().join(t.cities().select(F.col("city_sk").alias("entity"), F.col("country_code").alias("country")), "entity")
    return op.attach_group(base, t.annual().select("country", "year", "gdp"), ["country", "year"])


@query("join_part_and_whole", "J4", "country:s year:i urgent:d2 total:d2", ctes("priorities annual", """
    SELECT country, year, p.amount AS urgent, a.amount AS total FROM priorities p JOIN annual a USING (country, year) WHERE priority = '1-URGENT'"""))
def _(t):
    urgent = t.priorities().filter("priority = '1-URGENT'").select("country", "year", F.col("amount").alias("urgent"))
    return op.join_inner(urgent, t.annual().select("country", "year", F.col("amount").alias("total")), ["country", "year"])


@query("outer_panel", "J5", "country:s year:i a:d2 b:d2 c:d2", ctes("priorities", """
    SELECT country, year, max(amount) FILTER (priority = '1-URGENT' AND year < 1998) AS a, max(amount) FILTER (priority = '2-HIGH' AND year > 1996) AS b,
        max(amount) FILTER (priority = '5-LOW' AND year <> 1997) AS c FROM priorities
    WHERE (priority = '1-URGENT' AND year < 1998) OR (priority = '2-HIGH' AND year > 1996) OR (priority = '5-LOW' AND year <> 1997) GROUP BY 1, 2"""))
def _(t):
    p = t.priorities()
    frame = lambda name, cond, out: p.filter(F.col("priority") == name).filter(cond).select("country", "year", F.col("amount").alias(out))
    return op.outer_panel([frame("1-URGENT", "year < 1998", "a"), frame("2-HIGH", "year > 1996", "b"), frame("5-LOW", "year <> 1997", "c")], ["country", "year"])


@query("first_available_source", "J6", "country:s year:i amount:d2 source:s", ctes("priorities", """
    SELECT country, year, coalesce(a, b, c) AS amount, CASE WHEN a IS NOT NULL THEN 'A' WHEN b IS NOT NULL THEN 'B' ELSE 'C' END AS source FROM (
        SELECT country, year, max(amount) FILTER (priority = '1-URGENT' AND year < 1998) AS a, max(amount) FILTER (priority = '2-HIGH' AND year > 1996 AND year < 2000) AS b,
        max(amount) FILTER (priority = '5-LOW') AS c FROM priorities GROUP BY 1, 2) WHERE coalesce(a, b, c) IS NOT NULL"""))
def _(t):
    p = t.priorities()
    pick = lambda name, cond: p.filter(F.col("priority") == name).filter(cond)
    frames = [("A", pick("1-URGENT", "year < 1998")), ("B", pick("2-HIGH", "year > 1996 AND year < 2000")), ("C", pick("5-LOW", "true"))]
    return op.first_available(frames, ["country", "year"], "amount")


@query("prefix_join", "J7", "code:s country:s year:i gdp:d4", ctes("annual", """
    SELECT code, country, year, gdp FROM (VALUES ('N1'), ('N12'), ('N2'), ('N77')) AS m(code) LEFT JOIN annual ON starts_with(country, code)"""))
def _(t):
    codes = t.lookup([("N1",), ("N12",), ("N2",), ("N77",)], "code string")
    return op.prefix_join(codes, t.annual(), "code", "country", [2, 3])


@query("keep_members", "J8", "o_orderkey:l o_custkey:l", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    keep = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return op.keep_members(t("orders"), keep, ["o_custkey"])


@query("fill_uncovered_keys", "J9", "entity:l year:i month:i v:d8 source:s", ctes("holed", """
    SELECT entity, year, month, CASE WHEN veg IS NULL THEN pol ELSE veg END AS v, CASE WHEN veg IS NULL THEN 'fallback' ELSE 'primary' END AS source FROM holed"""))
def _(t):
    h = t.holed()
    own = h.filter("veg IS NOT NULL").select(*KEYS, F.col("veg").alias("v"), F.lit("primary").alias("source"))
    return op.fill_uncovered(own, h.select(*KEYS, F.col("pol").alias("v"), F.lit("fallback").alias("source")), KEYS)


def history(t):
    """Two versions per part: the first by size band until 1998-06, the second by brand since."""
    p = t("part")
    old = p.select(F.col("p_partkey").alias("part"), F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")).alias("band"),
                   F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit("1998-05-31").cast("date").alias("valid_to"), F.lit(False).alias("is_current"))
    new = p.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("band"),
                   F.lit("1998-06-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    return old.unionByName(new)


@query("join_current_version", "J10", "l_orderkey:l part:l band:s", "SELECT l_orderkey, l_partkey AS part, p_brand AS band FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    return op.join_current(t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part")), history(t), ["part"])


@query("join_version_valid_at", "J11", "l_orderkey:l part:l d:date band:s", """
    SELECT l_orderkey, l_partkey AS part, CAST(l_shipdate AS DATE) AS d, CASE WHEN CAST(l_shipdate AS DATE) <= DATE '1998-05-31' THEN 'S' || (p_size % 5) ELSE p_brand END AS band
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(t):
    fact = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("d"))
    return op.join_valid_at(fact, history(t), ["part"], "d")


@query("join_version_hot_key", "J11", "l_orderkey:l l_linenumber:i part:l d:date band:s", """
    WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_partkey END AS part, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    v AS (SELECT 0 AS part, CAST(DATE '1992-03-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS lo, CASE WHEN m % 20 <> 7 THEN CAST(DATE '1992-03-01' + to_months(CAST(m AS INTEGER)) AS DATE) + 44 END AS hi, 'm' || m AS band FROM range(84) AS r(m)
        UNION ALL SELECT p_partkey, DATE '1995-01-01', NULL, p_brand FROM part)
    SELECT l_orderkey, l_linenumber, f.part, d, band FROM f LEFT JOIN v ON v.part = f.part AND d >= lo AND (hi IS NULL OR d <= hi)""")
def _(t):
    """One key holds half of the rows and has overlapping monthly versions, some without an end."""
    part = F.when(F.col("l_partkey") % 2 == 0, F.lit(0)).otherwise(F.col("l_partkey")).cast("long")
    fact = t("lineitem").select("l_orderkey", "l_linenumber", part.alias("part"), F.to_date("l_shipdate").alias("d"))
    m = t.spark.range(84).select(F.col("id").cast("int").alias("m"))
    start = F.add_months(F.lit("1992-03-01").cast("date"), F.col("m"))
    many = m.select(F.lit(0).cast("long").alias("part"), start.alias("valid_from"), F.when(F.col("m") % 20 != 7, F.date_add(start, 44)).alias("valid_to"),
                    F.concat(F.lit("m"), "m").alias("band"))
    one = t("part").select(F.col("p_partkey").cast("long").alias("part"), F.lit("1995-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                           F.col("p_brand").alias("band"))
    return op.join_valid_at(fact, many.unionByName(one), ["part"], "d")


def stations(t):
    c = t("customer")
    k = F.col("c_custkey")
    return c.select(k.alias("point"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("country_code"),
                    (k % 600 / 10.0).alias("lat"), (k % 1190 / 10.0 + 0.05).alias("lon"))


@query("nearest_site_within_radius", "J12 G9", "point:l site:l distance_km:d6", ctes("cities", """
    SELECT point, site, d AS distance_km FROM (SELECT point, site, d, row_number() OVER (PARTITION BY point ORDER BY d, site) AS r FROM (
        SELECT c_custkey AS point, city_sk AS site, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (
            SELECT c_custkey, city_sk, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2) AS h
            FROM (SELECT c_custkey, c_nationkey, c_custkey % 600 / 10.0 AS plat, c_custkey % 1190 / 10.0 + 0.05 AS plon FROM customer) JOIN cities ON country_code = 'N' || c_nationkey))
        WHERE d <= 1500) WHERE r = 1"""))
def _(t):
    sites = t.cities().select(F.col("city_sk").alias("site"), "country_code", "lat", "lon")
    return op.nearest_within(stations(t), sites, "country_code", 1500)


@query("entity_else_group_value", "J13", "entity:l year:i country:s v:d4", ctes("entity_year cities annual", """
    SELECT entity, e.year, country_code AS country, coalesce(CASE WHEN entity % 2 = 0 THEN veg END, gdp) AS v FROM entity_year e JOIN cities ON entity = city_sk
    LEFT JOIN annual a ON a.country = country_code AND a.year = e.year"""))
def _(t):
    ey = t.holed().groupBy("entity", "year").agg(F.avg("veg").alias("v"))
    base = ey.select("entity", "year").join(t.cities().select(F.col("city_sk").alias("entity"), F.col("country_code").alias("country")), "entity")
    own = ey.withColumn("v", F.when(F.col("entity") % 2 == 0, F.col("v")))
    return op.entity_else_group(base, own, t.annual().select("country", "year", F.col("gdp").alias("v")), ["entity", "year"], ["country", "year"], "v")


@query("proxy_country_fill", "J14", "country:s year:i gdp:d4", ctes("annual", """
    SELECT h.country, h.year, coalesce(h.gdp, p.gdp) AS gdp FROM h LEFT JOIN (SELECT m.country, year, avg(gdp) AS gdp FROM (VALUES ('N3', 'N1'), ('N3', 'N2'), ('N4', 'N5')) AS m(country, proxy)
        JOIN h ON h.country = proxy GROUP BY 1, 2) p ON p.country = h.country AND p.year = h.year""",
    h="SELECT country, year, CASE WHEN country NOT IN ('N3', 'N4', 'N6') THEN gdp END AS gdp FROM annual"))
def _(t):
    proxies = t.lookup([("N3", "N1"), ("N3", "N2"), ("N4", "N5")], "country string, proxy string")
    df = t.annual().select("country", "year", F.when(~F.col("country").isin("N3", "N4", "N6"), F.col("gdp")).alias("gdp"))
    return op.proxy_fill(df, ["gdp"], proxies, "country", "year")


@query("group_statistic_on_rows", "J15", "entity:l year:i month:i veg:d8 veg_mean:d8", ctes("holed", "SELECT entity, year, month, veg, avg(veg) OVER (PARTITION BY entity, year) AS veg_mean FROM holed"))
def _(t):
    return op.with_group_stat(t.holed(), ["entity", "year"], {"veg_mean": F.avg("veg")})


@query("fact_with_two_histories", "J16", "l_orderkey:l part:l s_name:s band:s valid_from:date", """
    SELECT l_orderkey, l_partkey AS part, s_name, band, valid_from FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN (
        SELECT p_partkey, 'S' || (p_size % 5) AS band, DATE '1990-01-01' AS valid_from FROM part UNION ALL SELECT p_partkey, p_brand, DATE '1998-06-01' FROM part) ON l_partkey = p_partkey""")
def _(t):
    fact = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s_suppkey"))
    return op.history_view(fact, t("supplier"), ["s_suppkey"], history(t), ["part"])
