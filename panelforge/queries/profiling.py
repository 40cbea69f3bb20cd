"""Exploratory profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling as op
from ..operators.cleaning import dedupe
from .registry import ctes, query


@query("describe_columns", "E1", "column:s count:l mean:d6 std:d6 min:d6 q1:d6 median:d6 q3:d6 max:d6", """
    SELECT 'l_quantity' AS "column", count(l_quantity) AS "count", avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS "min", quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median,
        quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS "max" FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), avg(l_extendedprice), stddev_samp(l_extendedprice), min(l_extendedprice), quantile_cont(l_extendedprice, 0.25), median(l_extendedprice),
        quantile_cont(l_extendedprice, 0.75), max(l_extendedprice) FROM lineitem""")
def _(t):
    return op.describe(t("lineitem"), ["l_quantity", "l_extendedprice"])


@query("sample_moments", "E2", "column:s skewness:d6 kurtosis:d6", """
    SELECT 'l_quantity' AS "column", skewness(l_quantity) AS skewness, kurtosis(l_quantity) AS kurtosis FROM lineitem
    UNION ALL SELECT 'l_extendedprice', skewness(l_extendedprice), kurtosis(l_extendedprice) FROM lineitem""")
def _(t):
    return op.moments(t("lineitem"), ["l_quantity", "l_extendedprice"])


MISS = " UNION ALL ".join(f"SELECT {{k}} '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER ({c} IS NULL) * 100.0 / count(*) AS pct_missing FROM holed {{g}}" for c in ("veg", "pol", "seal"))


@query("missing_values", "E3", "column:s n_missing:l pct_missing:d6", ctes("holed", MISS.format(k="", g="")))
def _(t):
    return op.missing(t.holed(), ["veg", "pol", "seal"])


@query("missing_values_by_year", "E3", "year:i column:s n_missing:l pct_missing:d6", ctes("holed", MISS.format(k="year,", g="GROUP BY year")))
def _(t):
    return op.missing(t.holed(), ["veg", "pol", "seal"], "year")


@query("coverage_histogram", "E4", "months_present:l n_groups:l share:d8 is_complete:b", ctes("holed", """
    SELECT k AS months_present, count(*) AS n_groups, count(*) / sum(count(*)) OVER () AS share, k >= 12 AS is_complete FROM (SELECT entity, year, count(veg) AS k FROM holed GROUP BY 1, 2) GROUP BY k"""))
def _(t):
    return op.coverage(t.holed(), "entity", "year", "veg")


@query("panel_balance", "E5", "entity:l n_years:l is_complete:b", ctes("holed", """
    SELECT entity, count(DISTINCT year) AS n_years, count(DISTINCT year) = (SELECT count(DISTINCT year) FROM holed WHERE pol IS NOT NULL) AS is_complete FROM holed WHERE pol IS NOT NULL GROUP BY 1"""))
def _(t):
    return op.balance(t.holed(), "entity", "year", "pol")


@query("seasonality_profile", "E6", "month:i mean:d8 std:d8", ctes("holed", "SELECT month, avg(veg) AS mean, stddev_samp(veg) AS std FROM holed GROUP BY 1"))
def _(t):
    return op.seasonality(t.holed(), "month", "veg")


@query("yearly_profile", "E7", "year:i mean:d8 median:d8 std:d8", ctes("holed", "SELECT year, avg(veg) AS mean, median(veg) AS median, stddev_samp(veg) AS std FROM holed GROUP BY 1"))
def _(t):
    return op.yearly(t.holed(), "year", "veg")


@query("pearson_pairs", "E8", "a:s b:s pearson:d8", """
    SELECT * FROM (SELECT 'price' AS a, 'discount' AS b, corr(l_extendedprice, l_discount) AS pearson FROM lineitem UNION ALL SELECT 'price', 'saving', corr(l_extendedprice, l_extendedprice * l_discount) FROM lineitem
        UNION ALL SELECT 'discount', 'saving', corr(l_discount, l_extendedprice * l_discount) FROM lineitem) WHERE abs(pearson) >= 0.1""")
def _(t):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    df = t("lineitem").select(price.alias("price"), discount.alias("discount"), (price * discount).alias("saving"))
    return op.correlations(df, ["price", "discount", "saving"])


@query("pearson_matrix", "E8", "a:s b:s pearson:d8", ctes("holed", """
    SELECT 'veg' AS a, 'pol' AS b, corr(veg, pol) AS pearson FROM holed UNION ALL SELECT 'veg', 'seal', corr(veg, seal) FROM holed UNION ALL SELECT 'pol', 'seal', corr(pol, seal) FROM holed"""))
def _(t):
    return op.correlations(t.holed(), ["veg", "pol", "seal"], 0.0)


@query("spearman", "E9", "spearman:d8", """
    SELECT corr(ra, rb) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)""")
def _(t):
    return op.spearman(t("lineitem"), "l_quantity", "l_extendedprice")


@query("trend_line", "E10", "entity:l slope:d8 intercept:d5", ctes("entity_year", "SELECT entity, regr_slope(veg, year) AS slope, regr_intercept(veg, year) AS intercept FROM entity_year GROUP BY 1"))
def _(t):
    return op.trend_line(t.holed().groupBy("entity", "year").agg(F.avg("veg").alias("veg")), "year", "veg", ["entity"])


@query("tail_clipping", "E11", "o_orderkey:l o_totalprice_outside:i o_totalprice_clipped:d4", """
    SELECT o_orderkey, CAST(o_totalprice < q[1] OR o_totalprice > q[2] AS INTEGER) AS o_totalprice_outside, least(greatest(o_totalprice, q[1]), q[2]) AS o_totalprice_clipped
    FROM orders, (SELECT quantile_cont(o_totalprice, [0.01, 0.99]) AS q FROM orders)""")
def _(t):
    return op.tails(t("orders"), ["o_totalprice"])


@query("value_counts", "E12", "l_returnflag:s n_rows:l", "SELECT l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY 1")
def _(t):
    return op.value_counts(t("lineitem"), "l_returnflag")


@query("group_shares", "E13", "l_returnflag:s l_linestatus:s n_rows:l pct:d6", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag) AS pct FROM lineitem GROUP BY 1, 2")
def _(t):
    return op.group_shares(t("lineitem"), "l_returnflag", "l_linestatus")


@query("composition", "E14", "year:i veg:d8 pol:d8 n_above:l", ctes("holed", "SELECT year, avg(veg) AS veg, avg(pol) AS pol, count(*) FILTER (coalesce(veg, 0) + coalesce(pol, 0) > 0.1) AS n_above FROM holed GROUP BY 1"))
def _(t):
    return op.composition(t.holed(), "year", ["veg", "pol"], 0.1)


@query("one_row_per_group", "E15 P15", "year:i mean:d4", """
    SELECT year, avg(o_totalprice) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY o_orderkey) AS r FROM (SELECT *, year(o_orderdate) AS year FROM orders)) WHERE r = 1 GROUP BY 1""")
def _(t):
    o = t("orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    return dedupe(o, ["o_custkey", "year"], ["o_orderkey"]).groupBy("year").agg(F.avg("o_totalprice").alias("mean"))


@query("group_spread", "E16", "year:i mean_spread:d8 n_rows:l", ctes("holed", "SELECT year, avg(seal - veg) AS mean_spread, count(*) AS n_rows FROM holed GROUP BY 1"))
def _(t):
    return op.spread(t.holed(), "seal", "veg", "year")


@query("above_group_median", "E17", "entity:l year:i month:i above_median:b", ctes("holed", """
    SELECT entity, h.year, month, veg > med AS above_median FROM (SELECT *, round(veg, 9) AS v FROM holed) h LEFT JOIN (SELECT year, median(veg) AS med FROM holed GROUP BY 1) m ON m.year = h.year"""))
def _(t):
    return op.vs_median(t.holed(), "year", "veg")
