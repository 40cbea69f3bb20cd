"""Windows, ranks, ordering, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ordered_sets as sets, ordering, windows as op
from .registry import ctes, query

KEY = "entity:l year:i month:i"


def rounded(t):
    return t.panel().withColumn("score", F.round("veg", 6))


ROUNDED = {"rounded": "SELECT *, round(veg, 6) AS score FROM panel"}


@query("latest_row", "W1", "entity:l year:i month:i veg:d8", ctes("panel", """
    SELECT entity, year, month, veg FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, month DESC) AS r FROM panel) WHERE r = 1"""))
def _(t):
    return op.latest(t.panel().select("entity", "year", "month", "veg"), ["entity"], ["year", "month"])


@query("latest_order_per_customer", "W1 X13", "o_custkey:l o_orderkey:l", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def _(t):
    return op.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("rank_in_month", "W2", f"{KEY} rank:i", ctes("panel", "SELECT entity, year, month, rank() OVER (PARTITION BY year, month ORDER BY score DESC) AS rank FROM rounded", **ROUNDED))
def _(t):
    return ordering.rank_in(rounded(t), ["year", "month"], "score")


@query("rank_in_month_and_group", "W3", "entity:l year:i month:i rank:i", ctes("panel cities", """
    SELECT entity, year, month, rank() OVER (PARTITION BY year, month, country_code ORDER BY score DESC) AS rank FROM rounded JOIN cities ON entity = city_sk""", **ROUNDED))
def _(t):
    df = rounded(t).join(t.cities(), F.col("entity") == F.col("city_sk"))
    return ordering.rank_in(df, ["year", "month", "country_code"], "score")


@query("rank_all_lines", "W2", "l_orderkey:l l_linenumber:i l_partkey:l l_extendedprice:d2 rank:i", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS rank FROM lineitem""")
def _(t):
    return ordering.rank_in(t("lineitem"), ["l_returnflag"], "l_extendedprice")


@query("rank_and_score_change", "W4", f"{KEY} rank_change:i score_change:d6", ctes("panel", """
    SELECT entity, year, month, lag(rk) OVER w - rk AS rank_change, score - lag(score) OVER w AS score_change
    FROM (SELECT *, rank() OVER (PARTITION BY year, month ORDER BY score DESC) AS rk FROM rounded) WINDOW w AS (PARTITION BY entity ORDER BY year, month)""", **ROUNDED))
def _(t):
    return op.change(ordering.rank_in(rounded(t), ["year", "month"], "score", "rk"), "entity", ["year", "month"], "rk", "score")


@query("year_on_year_difference", "W5", f"{KEY} yoy_diff:d8 strict:d8", ctes("holed", """
    SELECT entity, year, month, veg - lag(veg) OVER w AS yoy_diff, CASE WHEN lag(year) OVER w = year - 1 THEN veg - lag(veg) OVER w END AS strict
    FROM holed WINDOW w AS (PARTITION BY entity, month ORDER BY year)"""))
def _(t):
    return op.yoy_diff(op.yoy_diff(t.holed(), "entity", "year", "month", "veg"), "entity", "year", "month", "veg", "strict", strict=True)


@query("year_on_year_percent", "W6", f"{KEY} yoy_pct:d6", ctes("panel", """
    SELECT entity, year, month, (price / nullif(lag(price) OVER (PARTITION BY entity, month ORDER BY year), 0) - 1) * 100 AS yoy_pct FROM panel"""))
def _(t):
    return op.yoy_pct(t.panel(), "entity", "year", "month", "price")


@query("percent_change_four_periods", "W7", "country:s year:i quarter:i pct_change:d6", """
    SELECT country, year, quarter, (v / nullif(lag(v, 4) OVER (PARTITION BY country ORDER BY year, quarter), 0) - 1) * 100 AS pct_change
    FROM (SELECT 'N' || c_nationkey AS country, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(o_totalprice) AS v
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""")
def _(t):
    q = t.orders_by("year", "month").groupBy("country", "year", F.ceil(F.col("month") / 3).alias("quarter")).agg(F.sum("amount").alias("v"))
    return op.pct_change(q, ["country"], ["year", "quarter"], "v", 4)


@query("simple_return", "W8", "ticker:l date:date simple_return:d8", ctes("prices", """
    SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS simple_return FROM prices"""))
def _(t):
    return op.simple_return(t.prices(), ["ticker"], ["date"], "close")


@query("forward_fill", "W9 I19", f"{KEY} veg_f:d8 veg_fb:d8", ctes("holed", """
    SELECT entity, year, month, last_value(veg IGNORE NULLS) OVER f AS veg_f, coalesce(last_value(veg IGNORE NULLS) OVER f, first_value(veg IGNORE NULLS) OVER b) AS veg_fb FROM holed
    WINDOW f AS (PARTITION BY entity ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY entity ORDER BY year, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def _(t):
    order = ["year", "month"]
    return op.fill(op.fill(t.holed(), ["entity"], order, "veg", out="veg_f"), ["entity"], order, "veg", backward=True, out="veg_fb")


@query("next_value", "W10", "country:s year:i gdp:d4 next_value:d4", ctes("annual", """
    SELECT country, year, gdp, lead(gdp, 1, gdp) OVER (PARTITION BY country ORDER BY year) AS next_value FROM annual"""))
def _(t):
    return op.next_value(t.annual(), ["country"], ["year"], "gdp")


@query("first_rise", "W11", "country:s first_rise:i", ctes("annual", """
    SELECT country, min(year) FILTER (gdp > p) AS first_rise FROM (SELECT *, lag(gdp) OVER (PARTITION BY country ORDER BY year) AS p FROM annual) GROUP BY 1"""))
def _(t):
    return op.first_rise(t.annual(), ["country"], "year", "gdp")


# ---- ordering and sets ------------------------------------------------------

@query("sorted_rows", "T1", "country:s year:i gdp:d4", ctes("annual", "SELECT country, year, gdp FROM annual ORDER BY country, year DESC"))
def _(t):
    return sets.order(t.annual(), ["country", F.desc("year")])


@query("sorted_nulls_last", "T2", f"{KEY} veg:d8", ctes("holed", "SELECT entity, year, month, veg FROM holed ORDER BY veg DESC NULLS LAST, entity, year, month"))
def _(t):
    return sets.order_nulls_last(t.holed(), "veg", ["entity", "year", "month"])


@query("top_orders", "T3", "o_orderkey:l o_totalprice:d2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return sets.top_k(t("orders"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@query("top_and_bottom_countries", "T4 T7", "side:s country:s value:d4", ctes("annual", """
    (SELECT 'top' AS side, country, avg(gdp) AS value FROM annual GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5) UNION ALL
    (SELECT 'bottom', country, avg(gdp) FROM annual GROUP BY 2 ORDER BY 3, 2 LIMIT 5)"""))
def _(t):
    top = sets.top_k_of(t.annual(), ["country"], F.avg("gdp"), 5).withColumn("side", F.lit("top"))
    low = sets.top_k_of(t.annual(), ["country"], F.avg("gdp"), 5, largest=False).withColumn("side", F.lit("bottom"))
    return sets.stack([top, low])


@query("extreme_rows", "T5", "year:i max_country:s max_gdp:d4 min_country:s min_gdp:d4", ctes("annual", """
    SELECT year, arg_max(country, gdp) AS max_country, max(gdp) AS max_gdp, arg_min(country, gdp) AS min_country, min(gdp) AS min_gdp FROM annual GROUP BY 1"""))
def _(t):
    return sets.arg_extreme(t.annual(), "gdp", ["country"], ["country"], ["year"])


@query("last_period", "T6", f"{KEY} veg:d8", ctes("panel", "SELECT entity, year, month, veg FROM panel WHERE (year, month) = (SELECT (max(year * 100 + month) // 100, max(year * 100 + month) % 100) FROM panel)"))
def _(t):
    return sets.last_period(t.panel(), "year", "month")


@query("union_by_name", "T7", "key:l name:s balance:d2", """
    SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return sets.stack([c, t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))])


@query("distinct_rows", "T8", "year:i o_orderpriority:s", "SELECT DISTINCT year(o_orderdate) AS year, o_orderpriority FROM orders")
def _(t):
    return sets.distinct(t("orders").withColumn("year", F.year("o_orderdate")), ["year", "o_orderpriority"])


@query("key_difference", "T9", "c_custkey:l", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.minus_keys(t("customer"), urgent, ["c_custkey"])


@query("seeded_sample", "T10", "o_orderkey:l o_totalprice:d2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def _(t):
    return sets.hash_sample(t("orders"), ["o_orderkey"], 100, seed=42)

