"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..functions.scalars import annualise
from .registry import ctes, query


@query("group_mean_monthly_to_annual", "A1", "entity:l year:i veg:d8 pol:d8 seal:d8", ctes("entity_year", "SELECT entity, year, veg, pol, seal FROM entity_year"))
def _(t):
    return op.group_mean(t.holed(), ["entity", "year"], ["veg", "pol", "seal"])


@query("group_sum_zero_rule", "A2", "entity:l month:i kept:d8 blank:d8", ctes("holed", """
    SELECT entity, month, coalesce(sum(veg), 0) AS kept, nullif(coalesce(sum(veg), 0), 0) AS blank FROM holed GROUP BY 1, 2"""))
def _(t):
    keys = ["entity", "month"]
    kept = op.group_sum0(t.holed(), keys, "veg", zero_as_null=False).withColumnRenamed("veg", "kept")
    return kept.join(op.group_sum0(t.holed(), keys, "veg").withColumnRenamed("veg", "blank"), keys)


@query("group_mean_and_sum", "A3", "entity:l year:i seal:d8 pol:d8", ctes("holed", "SELECT entity, year, avg(seal) AS seal, sum(pol) AS pol FROM holed GROUP BY 1, 2"))
def _(t):
    return op.group_mixed(t.holed(), ["entity", "year"], {"seal": "mean", "pol": "sum"})


@query("group_profile", "A4", "o_orderpriority:s n_rows:l n_ids:l total:d2 per_row:d4 per_id:d4 log_total:d8", """
    SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_ids, sum(o_totalprice) AS total, sum(o_totalprice) / count(*) AS per_row,
        sum(o_totalprice) / count(DISTINCT o_custkey) AS per_id, ln(1 + sum(o_totalprice)) AS log_total FROM orders GROUP BY 1""")
def _(t):
    return op.group_profile(t("orders"), ["o_orderpriority"], "o_custkey", "o_totalprice")


@query("market_panel", "A5", "country_code:s year:i n_tickers:l avg_price:d6 avg_volatility:d8", ctes("market", """
    SELECT country_code, year, count(DISTINCT ticker) AS n_tickers, avg(close_price) AS avg_price, avg(monthly_volatility) AS avg_volatility FROM market GROUP BY 1, 2"""))
def _(t):
    return op.market_panel(t.market(), "country_code", "year", "ticker", {"close_price": "avg_price", "monthly_volatility": "avg_volatility"},
                           ["close_price", "monthly_volatility"])


@query("conditional_tally", "A6", "year:i high:l low:l blank:l", ctes("holed", """
    SELECT year, count(*) FILTER (veg > 0.05) AS high, count(*) FILTER (veg <= 0.04) AS low, count(*) FILTER (veg IS NULL) AS blank FROM holed GROUP BY 1"""))
def _(t):
    veg = F.col("veg")
    return op.tally(t.holed(), ["year"], {"high": veg > 0.05, "low": veg <= 0.04, "blank": veg.isNull()})


@query("distinct_ordered_concat", "A7", "country_code:s year:i tickers:s", ctes("market", """
    SELECT country_code, year, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM market GROUP BY 1, 2"""))
def _(t):
    return op.concat_distinct(t.market(), ["country_code", "year"], "ticker", ",", "tickers")


@query("distinct_values_list", "A8", "p_type:s n:i joined:s", """
    SELECT p_type, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS joined FROM part GROUP BY 1""")
def _(t):
    df = op.collect_distinct(t("part"), ["p_type"], "p_brand", "brands")
    return df.select("p_type", F.size("brands").alias("n"), F.array_join("brands", "|").alias("joined"))


@query("conditional_mean", "A9", "entity:l recent:d8", ctes("holed", "SELECT entity, avg(veg) FILTER (year >= 1998) AS recent FROM holed GROUP BY 1"))
def _(t):
    return op.mean_where(t.holed(), ["entity"], "veg", F.col("year") >= 1998, "recent")


@query("prefix_mean", "A10", "prefix:s year:i gdp:d4", ctes("annual", "SELECT substr(country, 1, 2) AS prefix, year, avg(gdp) AS gdp FROM annual GROUP BY 1, 2"))
def _(t):
    return op.prefix_mean(t.annual(), "country", 2, "year", "gdp")


@query("daily_to_monthly_market", "A11 W8", "ticker:l year:i month:i sessions:l close_price:d6 monthly_return:d8 monthly_volatility:d8 volume_avg:d6", ctes("prices", """
    SELECT ticker, year(date) AS year, month(date) AS month, count(*) AS sessions, avg(close) AS close_price, arg_max(close, date) / arg_min(close, date) - 1 AS monthly_return,
        stddev_samp(r) * sqrt(21.0) AS monthly_volatility, avg(volume) AS volume_avg
    FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM prices) GROUP BY 1, 2, 3 HAVING count(*) >= 15"""))
def _(t):
    return op.ohlc_monthly(t.prices())


@query("annual_volatility", "A12", "ticker:s year:i vol:d8", ctes("market", "SELECT ticker, year, avg(monthly_volatility) * sqrt(12.0) AS vol FROM market GROUP BY 1, 2"))
def _(t):
    return op.group_mean(t.market(), ["ticker", "year"], ["monthly_volatility"]).withColumn("vol", annualise("monthly_volatility"))


@query("hourly_readings_to_city", "A13", "city:l year:i month:i value:d8 n_stations:l", """
    SELECT city, year, month, avg(m) AS value, count(*) AS n_stations FROM (SELECT user_id % 10 AS city, user_id, year(ts) AS year, month(ts) AS month, avg(value) AS m
        FROM events WHERE event_type <> 'error' AND value >= 0 GROUP BY ALL) GROUP BY 1, 2, 3""")
def _(t):
    e = t("events").withColumn("city", F.col("user_id") % 10)
    return op.reduce_readings(e, "user_id", "city", "ts", "value", (F.col("event_type") != "error") & (F.col("value") >= 0))


@query("share_of_total", "A14", "country:s year:i share:d6", ctes("priorities", """
    SELECT country, year, sum(amount) FILTER (priority IN ('1-URGENT', '2-HIGH')) / sum(amount) * 100 AS share FROM priorities GROUP BY 1, 2 HAVING count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) > 0"""))
def _(t):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return op.share(t.priorities(), ["country", "year"], "priority", names[:2], names, "amount")


@query("minmax_scaling", "A15", "entity:l year:i month:i veg01:d8 flat:d8", ctes("holed", """
    SELECT entity, year, month, (veg - min(veg) OVER ()) / (max(veg) OVER () - min(veg) OVER ()) AS veg01, CAST(NULL AS DOUBLE) AS flat FROM holed"""))
def _(t):
    return op.minmax(op.minmax(t.holed(), "veg", "veg01").withColumn("one", F.lit(1.0)), "one", "flat")


@query("group_median", "A16", "country:s median:d4", ctes("annual", "SELECT country, median(gdp) AS median FROM annual GROUP BY 1"))
def _(t):
    return op.median(t.annual(), "gdp", ["country"])


@query("column_medians", "A16", "column:s median:d6", """
    SELECT 'l_discount' AS "column", median(l_discount) AS median FROM lineitem UNION ALL SELECT 'l_extendedprice', median(l_extendedprice) FROM lineitem""")
def _(t):
    return op.column_medians(t("lineitem"), ["l_discount", "l_extendedprice"])


@query("iqr_outliers", "A17", "o_orderkey:l outlier_flag:i", """
    SELECT o_orderkey, CAST(o_totalprice < q[1] - 0.5 * (q[2] - q[1]) OR o_totalprice > q[2] + 0.5 * (q[2] - q[1]) AS INTEGER) AS outlier_flag
    FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders)""")
def _(t):
    return op.iqr_flags(t("orders"), "o_totalprice", 0.5)


@query("group_slope", "A18", "entity:l slope:d8", ctes("entity_year", """
    SELECT entity, coalesce(CASE WHEN regr_count(veg, year) >= 3 THEN regr_slope(veg, year) END, 0) AS slope FROM entity_year GROUP BY 1"""))
def _(t):
    return op.slope(op.group_mean(t.holed(), ["entity", "year"], ["veg"]), ["entity"], "year", "veg", 3, 0.0)


@query("collapse_panel", "A19", "entity:l year:i veg:d8 pol:d8 month:i", ctes("holed", "SELECT entity, year, avg(veg) AS veg, avg(pol) AS pol, max(month) AS month FROM holed GROUP BY 1, 2"))
def _(t):
    return op.collapse_panel(t.holed(), ["entity", "year"], ["veg", "pol"], ["month"])


@query("trace_counts", "A20", "label:s n_rows:l first_year:i last_year:i", ctes("panel", "SELECT 'panel' AS label, count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year FROM panel"))
def _(t):
    return op.trace(t.panel(), "panel")
