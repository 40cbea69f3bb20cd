"""Business metrics, facts and the ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import metrics as op
from ..plans import facts
from .registry import ctes, query

CITY_MONTH = "city_sk:l year:i month:i"


@query("green_index", "B1 A15", f"{CITY_MONTH} green_index:d5", ctes("env", "SELECT city_sk, year, month, green_index FROM env"))
def _(t):
    return t.env()


@query("natural_cover", "B2", "entity:l year:i month:i natural_pct:d6", ctes("holed", "SELECT entity, year, month, coalesce(veg, 0) + coalesce(pol, 0) + coalesce(seal, 0) AS natural_pct FROM holed"))
def _(t):
    return op.natural_cover(t.holed(), ["veg", "pol", "seal"])


@query("composite_score", "B3 B4", f"{CITY_MONTH} investment_score:d2 investment_recommendation:s", ctes("gold", "SELECT city_sk, year, month, investment_score, investment_recommendation FROM gold"))
def _(t):
    return t.gold()


@query("recommendation_labels", "B4", "k:l label:s", """
    SELECT o_orderkey AS k, CASE WHEN o_totalprice / 5000 >= 75 THEN 'STRONG_BUY' WHEN o_totalprice / 5000 >= 55 THEN 'BUY' WHEN o_totalprice / 5000 >= 35 THEN 'HOLD' ELSE 'AVOID' END AS label FROM orders""")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("k"), fn.recommend(F.col("o_totalprice") / 5000).alias("label"))


@query("phase_aware_score", "B5", f"{CITY_MONTH} score:d2", ctes("gold", """
    SELECT city_sk, year, month, round((coalesce(green_index, 0) * 50 + coalesce(CASE WHEN month <= 6 THEN 0.8 END, 0.5) * 30 + CASE turning_point_phase WHEN 'TURNING' THEN 20 WHEN 'RECUPERANDO' THEN 15 ELSE 0 END), 8) AS score FROM gold"""))
def _(t):
    df = t.gold().withColumn("conf", F.when(F.col("month") <= 6, F.lit(0.8)))
    return df.withColumn("score", fn.phase_score("green_index", "conf", "turning_point_phase"))


@query("gold_fact", "B6", f"{CITY_MONTH} city_code:s country_code:s green_index:d5 gdp_monthly:d4 renewables_pct:d6 ets_price_eur:d6 fin_tickers:s fin_close_price_avg:d4 ndvi_trend_slope:d8 "
       "investment_score:d2 investment_recommendation:s turning_point_phase:s", ctes("gold", "SELECT * FROM gold"))
def _(t):
    return t.gold()


@query("ranking_table", "B7 W2 W3 W4 P25", f"{CITY_MONTH} rank_position:i rank_within_country:i rank_change:i score_change:d2 top_ticker:s", ctes("ranked", "SELECT * FROM ranked"))
def _(t):
    return t.ranked()


@query("phase_labels", "B8", f"{CITY_MONTH} turning_point_phase:s", ctes("gold", "SELECT city_sk, year, month, turning_point_phase FROM gold"))
def _(t):
    return t.gold()


@query("slope_bins", "B9", f"{CITY_MONTH} phase:s", ctes("env", """
    SELECT city_sk, year, month, CASE WHEN x <= -0.005 THEN 'DEGRADANDO' WHEN x <= 0.005 THEN 'TURNING' WHEN x > 0.005 THEN 'RECUPERANDO' END AS phase FROM (SELECT *, round(ndvi_yoy_change, 9) AS x FROM env)"""))
def _(t):
    return t.env().withColumn("phase", fn.bin_slope(F.round("ndvi_yoy_change", 9), 0.005))


@query("flat_opportunities", "B10", f"{CITY_MONTH} flag:i", ctes("gold", "SELECT city_sk, year, month, 1 AS flag FROM gold WHERE abs(ndvi_trend_slope) < 0.0002 AND fin_tickers IS NOT NULL"))
def _(t):
    return op.flat_flag(op.flat_opportunities(t.gold(), "ndvi_trend_slope", "fin_tickers", 0.0002), "ndvi_trend_slope", 0.0002, "flag")


@query("policy_fact", "B11 R9 I3", "country_code:s year:i month:i date_sk:i eps_index:d2 co2_kt:d2 investeu_total_eur:d2", ctes("policy", "SELECT * FROM policy"))
def _(t):
    return t.policy()


@query("economic_fact", "B12 I1 W6", "city_sk:l city_code:s year:i month:i date_sk:i gdp_monthly:d4 ln_gdp:d8 population:l renewables_pct:d6 ets_price_eur:d6 co2_kt:d2 gdp_growth_rate:d3",
       ctes("economy", "SELECT * FROM economy"))
def _(t):
    return t.economy()


@query("economic_fact_tourism", "B12 J13", "city_sk:l year:i month:i tourism_nights:d4", ctes("economy panel cities", """
    SELECT e.city_sk, e.year, e.month, coalesce(o.price, s.price) AS tourism_nights FROM economy e LEFT JOIN own o ON o.entity = e.city_sk AND o.year = e.year AND o.month = e.month
    LEFT JOIN (SELECT country_code, year, month, arg_min(price, city_code) AS price FROM own GROUP BY 1, 2, 3) s ON s.country_code = e.country_code AND s.year = e.year AND s.month = e.month""",
    own="SELECT panel.*, city_code, country_code FROM panel JOIN cities ON entity = city_sk WHERE entity % 4 <> 0"))
def _(t):
    """Cities that report no nights take those of their country."""
    t.stage("panel")
    own = t.panel().filter("entity % 4 <> 0").join(t.cities().withColumnRenamed("city_sk", "entity"), "entity")
    return t.economy(tourism=own.select("city_code", "country_code", "year", "month", F.col("price").alias("tourism_nights")))


@query("gold_fact_policy", "B6 B11", "city_sk:l year:i month:i investment_score:d2 eps_index:d2 co2_kt:d2 investeu_total_eur:d2", ctes("gold policy", """
    SELECT city_sk, g.year, g.month, investment_score, eps_index, co2_kt, investeu_total_eur FROM gold g LEFT JOIN policy p ON p.country_code = g.country_code AND p.year = g.year AND p.month = g.month"""))
def _(t):
    return t.gold(policy=t.policy().drop("date_sk"))


@query("environmental_fact", "B13 J1 J2 I8 I9 D6", "city_sk:l year:i month:i date_sk:i ndvi_mean:d8 no2_mean:d8 imperviousness_mean:d6 ntl_mean:d6 ndvi_yoy_change:d8 green_index:d5 wc_natural_pct:d6", ctes("holed panel cities", """
    SELECT city_sk, year, month, year * 100 + month AS date_sk, veg AS ndvi_mean, pol AS no2_mean, seal AS imperviousness_mean, ntl_mean, veg - lag(veg) OVER (PARTITION BY city_sk, month ORDER BY year) AS ndvi_yoy_change,
        round(0.5 * (veg - v0) / (v1 - v0) + 0.3 * (1 - (coalesce(pol, p0) - p0) / (p1 - p0)) + 0.2 * (1 - (coalesce(seal, s0) - s0) / (s1 - s0)), 6) AS green_index, coalesce(tree, 0) AS wc_natural_pct
    FROM j, (SELECT min(veg) v0, max(veg) v1, min(pol) p0, max(pol) p1, min(seal) s0, max(seal) s1 FROM j)""",
    old="""SELECT entity, year, avg(pol) AS o FROM panel WHERE year <= 1998 GROUP BY 1, 2""",
    ratio="""SELECT entity, avg(pol) FILTER (year BETWEEN 1997 AND 1998) AS o, avg(seal) FILTER (year BETWEEN 1997 AND 1998) AS n FROM panel GROUP BY 1""",
    j="""SELECT h.entity AS city_sk, h.year, h.month, CASE WHEN h.veg IS NULL AND h.year < 1999 THEN x.veg ELSE h.veg END AS veg, h.pol, w.seal, w.tree,
        CASE WHEN h.year >= 1997 THEN x.seal ELSE old.o * coalesce(CASE WHEN ratio.o > 0 AND ratio.n <> 0 THEN ratio.n / ratio.o END, 3.5) END AS ntl_mean
        FROM holed h JOIN cities ON h.entity = cities.city_sk LEFT JOIN panel x ON x.entity = h.entity AND x.year = h.year AND x.month = h.month
        LEFT JOIN (SELECT entity, year, avg(seal) AS seal, avg(price) AS tree FROM holed GROUP BY 1, 2) w ON w.entity = h.entity AND w.year = h.year
        LEFT JOIN old ON old.entity = h.entity AND old.year = h.year LEFT JOIN ratio ON ratio.entity = h.entity"""))
def _(t):
    t.stage("panel")
    code = t.cities().select(F.col("city_sk").alias("entity"), "city_code")
    h, p = t.holed().join(code, "entity"), t.panel().join(code, "entity")
    key = ["city_code", "year", "month"]
    annual = h.groupBy("city_code", "year").agg(F.avg("seal").alias("imperviousness_mean"), F.avg("price").alias("wc_tree_pct"))
    old = p.filter("year <= 1998").select(*key, F.col("pol").alias("ntl_mean"), F.lit("DMSP").alias("ntl_source"))
    new = p.filter("year >= 1997").select(*key, F.col("seal").alias("ntl_mean"), F.lit("VIIRS").alias("ntl_source"))
    return facts.environmental_fact(
        h.select(*key, F.col("veg").alias("ndvi_mean")), t.cities().select("city_code", "city_sk"), [h.select(*key, F.col("pol").alias("no2_mean"))], [annual],
        p.select(*key, F.col("veg").alias("ndvi_mean")), old.unionByName(new), gap_before=1999,
        overlap=(1997, 1998), unique_sides=True, store=t.keep)


@query("market_fact", "B14 J10", "company_sk:l year:i month:i date_sk:i close_price:d4", ctes("market", """
    SELECT CAST(regexp_extract(ticker, '(\\d+)', 1) AS BIGINT) AS company_sk, year, CASE WHEN year = 1996 THEN 1 ELSE month END AS month, year * 100 + CASE WHEN year = 1996 THEN 1 ELSE month END AS date_sk, close_price
    FROM market WHERE ticker <> 'Brand#7'"""))
def _(t):
    m = t.market().withColumn("month", F.when(F.col("year") != 1996, F.col("month")))
    number = F.regexp_extract("ticker", r"(\d+)", 1).cast("long")
    companies = t("part").select(F.col("p_brand").alias("ticker")).distinct().select("ticker", number.alias("company_sk"), (F.col("ticker") != "Brand#7").alias("is_current"))
    return facts.market_fact(m, companies)


@query("market_by_country", "B6 A7 X4", "country_code:s year:i month:i fin_tickers:s fin_close_price_avg:d4 fin_monthly_volatility:d8 fin_annual_volatility:d8", ctes("market", """
    SELECT country_code, year, month, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS fin_tickers, avg(close_price) AS fin_close_price_avg, avg(monthly_volatility) AS fin_monthly_volatility,
        avg(monthly_volatility) * sqrt(12.0) AS fin_annual_volatility FROM market GROUP BY 1, 2, 3"""))
def _(t):
    m = t.market().withColumn("company_sk", F.regexp_extract("ticker", r"(\d+)", 1).cast("long"))
    companies = t("part").select(F.col("p_brand").alias("ticker")).distinct().withColumns({
        "company_sk": F.regexp_extract("ticker", r"(\d+)", 1).cast("long"), "is_current": F.lit(True)}).withColumn(
        "country_code", F.concat(F.lit("N"), (F.col("company_sk") % 25).cast("string")))
    return facts.market_by_country(m.drop("country_code", "ticker"), companies)


@query("master_panel", "B15 A3 A8 A12 A18", "city_code:s year:i ndvi_mean:d8 no2_mean:d8 temp_mean_c:d6 precip_total_m:d6 ndvi_slope:d8 co2_kt:d2 close_price:d6 annual_volatility:d8 n_tickers:i imperviousness:d6 eps_index:d6 investeu_total_eur:d4", ctes("holed cities annual market", """
    SELECT c.city_code, y.year, y.veg AS ndvi_mean, y.pol AS no2_mean, y.temp AS temp_mean_c, y.rain AS precip_total_m, s.slope AS ndvi_slope, a.amount AS co2_kt, f.close_price, f.vol AS annual_volatility, f.k AS n_tickers, x.imperviousness, x.eps_index, x.investeu_total_eur
    FROM (SELECT entity, year, avg(veg) AS veg, avg(pol) AS pol, avg(seal) AS temp, sum(seal) AS rain FROM holed GROUP BY 1, 2) y JOIN cities c ON c.city_sk = y.entity
    LEFT JOIN (SELECT entity, coalesce(CASE WHEN regr_count(v, year) >= 3 THEN regr_slope(v, year) END, 0) AS slope FROM (SELECT entity, year, avg(veg) AS v FROM holed GROUP BY 1, 2) GROUP BY 1) s ON s.entity = y.entity
    LEFT JOIN annual a ON a.country = c.country_code AND a.year = y.year
    LEFT JOIN (SELECT country_code, year, avg(close_price) AS close_price, avg(monthly_volatility) * sqrt(12.0) AS vol, count(DISTINCT ticker) AS k FROM market GROUP BY 1, 2) f ON f.country_code = c.country_code AND f.year = y.year
    LEFT JOIN (SELECT entity, year, max(seal) FILTER (year >= 1994) AS imperviousness, max(pol) FILTER (year < 1998) AS eps_index, max(price) FILTER (entity % 3 = 0) AS investeu_total_eur
        FROM holed GROUP BY 1, 2) x ON x.entity = y.entity AND x.year = y.year"""))
def _(t):
    t.stage("panel")
    h = t.holed().join(t.cities().select(F.col("city_sk").alias("entity"), "city_code"), "entity")
    pick = lambda *cols: h.select("city_code", "year", *[F.col(c).alias(n) for c, n in cols])
    top = lambda c, name, kept: h.filter(kept).groupBy("city_code", "year").agg(F.max(c).alias(name))
    co2 = t.annual().select(F.col("country").alias("country_code"), "year", F.col("amount").alias("co2_kt"))
    df = facts.master_panel(pick(("veg", "ndvi_mean")), t.market(), no2=pick(("pol", "no2_mean")),
                            climate=pick(("seal", "temp_mean_c"), ("seal", "precip_total_m")), emissions=co2,
                            sealing=top("seal", "imperviousness", "year >= 1994"), policy=top("pol", "eps_index", "year < 1998"),
                            investment=top("price", "investeu_total_eur", "entity % 3 = 0"))
    return df.withColumn("n_tickers", F.size("tickers"))
