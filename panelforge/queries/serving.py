"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.models import forecast
from ..plans import serving as op
from ..plans.maintained import MaintainedGold
from ..streaming.storage import listing
from .models import FORECAST, seasonal
from .registry import ctes, query

RANK = "city_code:s country_code:s year:i month:i rank_position:i investment_score:d2"


def last_month(table, name):
    year, month = table.latest()
    return getattr(table, name)().filter((F.col("year") == year) & (F.col("month") == month))


@query("maintained_gold", "B6 V1", "city_sk:l year:i month:i city_code:s country_code:s green_index:d5 gdp_monthly:d4 renewables_pct:d6 ets_price_eur:d6 fin_tickers:s fin_close_price_avg:d4 ndvi_trend_slope:d8 "
       "investment_score:d2 investment_recommendation:s turning_point_phase:s", ctes("gold", "SELECT * FROM gold"))
def _(t):
    """The stored gold table; a call builds it, or refreshes the months that changed."""
    return t.maintained().gold()


@query("maintained_gold_refresh", "B6 V1", "n_months:l n_rewritten:l n_untouched:l n_repeat:l", ctes("panel", """
    SELECT n AS n_months, k AS n_rewritten, n - k AS n_untouched, 0 AS n_repeat FROM (SELECT count(*) AS n, count(*) FILTER (month = 7 AND year >= 1998) AS k
        FROM (SELECT DISTINCT year, month FROM panel))"""))
def _(t):
    """One month of the vegetation is corrected: how many months are rewritten, how many keep their files, and what a repeat rewrites."""
    table = MaintainedGold(t.spark, t.scratch("refreshed"))
    silver = t.silver()
    build = lambda s: lambda months: t.gold_parts(s, months)
    table.refresh(silver, build(silver), t.levels())
    before = listing(t.spark, f"{table.path}/parts")
    month = (F.col("year") == 1998) & (F.col("month") == 7)
    new = silver | {"panel": silver["panel"].withColumn("veg", F.when(month, F.col("veg") * 1.01).otherwise(F.col("veg")))}
    rewritten = table.refresh(new, build(new), t.levels())
    months = lambda files: {tuple(f.split("/")[-3:-1]) for f, _, _ in files if "/part-" in f}
    kept = months(before) - months(set(before) - set(listing(t.spark, f"{table.path}/parts")))
    repeat = table.refresh(new, build(new), t.levels())
    return t.lookup([(len(table.manifest["periods"]), len(rewritten), len(kept), len(repeat))],
                    "n_months long, n_rewritten long, n_untouched long, n_repeat long")


@query("ranking_page_latest", "V1 T3 T6", RANK, ctes("ranked", "SELECT * FROM ranked WHERE year = (SELECT max(year) FROM ranked) ORDER BY rank_position, month, city_code LIMIT 50"))
def _(t):
    table = t.maintained()
    return op.ranking_page(table.ranked(), table.latest()[0])


@query("ranking_page_country", "V1", RANK, ctes("ranked", "SELECT * FROM ranked WHERE year = 1999 AND country_code = 'N8' ORDER BY rank_position, month, city_code LIMIT 1000"))
def _(t):
    return op.ranking_page(t.maintained().ranked(), 1999, "n8", 1000)


@query("entity_detail", "V2 T1", "city_code:s year:i month:i green_index:d5 trend:d8", ctes("gold cities", """
    SELECT city_code, year, month, green_index, ndvi_yoy_change AS trend FROM gold WHERE city_code = (SELECT min(city_code) FROM cities) ORDER BY year, month"""))
def _(t):
    gold = t.maintained().gold()
    first = t.cities().agg(F.min("city_code").alias("c")).first()["c"]
    results = gold.filter(F.col("city_code") == first).select("city_sk", "year", "month", F.col("ndvi_yoy_change").alias("trend"))
    return op.entity_detail(gold, results, first)


@query("turning_opportunities", "V3 T2", "city_code:s country_code:s year:i month:i investment_score:d2 gap_to_turning:d4", ctes("gold", "SELECT * FROM gold WHERE turning_point_phase = 'TURNING' AND year = 2000"))
def _(t):
    return op.opportunities(t.maintained().gold(), 2000)


@query("turning_opportunities_latest", "V3 T6", "city_code:s year:i month:i investment_score:d2", ctes("gold", "SELECT * FROM gold WHERE turning_point_phase = 'TURNING' AND year = (SELECT max(year) FROM gold)"))
def _(t):
    table = t.maintained()
    return op.opportunities(table.gold(), table.latest()[0])


@query("cluster_summary", "V4 T6", "cluster_id:i estimation_year:i beta1:d8 beta2:d8 turning_point:d4 r_squared:d8 n_cities:l", ctes("parameters", "SELECT * FROM parameters WHERE estimation_year = (SELECT max(estimation_year) FROM parameters)"))
def _(t):
    return op.cluster_summary(t.parameters())


@query("available_years", "V5 T8", "year:i", ctes("panel", "SELECT DISTINCT year FROM panel ORDER BY year DESC"))
def _(t):
    return op.years(t.panel())


@query("countries_with_cities", "V6", "country_code:s country_name:s n_cities:l", ctes("cities panel", """
    SELECT country_code, country_name, count(DISTINCT city_code) AS n_cities FROM panel JOIN cities ON entity = city_sk GROUP BY 1, 2"""))
def _(t):
    return op.countries(t.panel().join(t.cities(), F.col("entity") == F.col("city_sk")))


@query("executive_summary", "V7 A6", "year:i total_cities:l total_countries:l avg_green_index:d4 avg_investment_score:d2 cities_turning:l cities_recovering:l cities_degrading:l strong_buy:l buy:l hold:l avoid:l", ctes("gold", """
    SELECT year, count(DISTINCT city_code) AS total_cities, count(DISTINCT country_code) AS total_countries, round(avg(green_index), 10) AS avg_green_index, round(avg(investment_score), 8) AS avg_investment_score,
        count(*) FILTER (turning_point_phase = 'TURNING') AS cities_turning, count(*) FILTER (turning_point_phase = 'RECUPERANDO') AS cities_recovering, count(*) FILTER (turning_point_phase = 'DEGRADANDO') AS cities_degrading,
        count(*) FILTER (investment_recommendation = 'STRONG_BUY') AS strong_buy, count(*) FILTER (investment_recommendation = 'BUY') AS buy, count(*) FILTER (investment_recommendation = 'HOLD') AS hold,
        count(*) FILTER (investment_recommendation = 'AVOID') AS avoid FROM gold WHERE year = (SELECT max(year) FROM gold) GROUP BY 1"""))
def _(t):
    table = t.maintained()
    return op.summary(table.gold().filter(F.col("year") == table.latest()[0]))


@query("map_view", "V8 T6 J4", "city_code:s year:i month:i lat:d4 lon:d4 investment_score:d2", ctes("gold cities", """
    SELECT g.city_code, year, month, c.lat, c.lon, investment_score FROM gold g JOIN cities c ON c.city_sk = g.city_sk WHERE year * 100 + month = (SELECT max(year * 100 + month) FROM gold)"""))
def _(t):
    return op.map_view(last_month(t.maintained(), "gold"), t.cities())


@query("top_20_cities", "V9 T3 T6", f"{RANK} rank_change:i top_ticker:s", ctes("ranked", "SELECT * FROM ranked WHERE year * 100 + month = (SELECT max(year * 100 + month) FROM ranked) ORDER BY rank_position, city_code LIMIT 20"))
def _(t):
    return op.top20(last_month(t.maintained(), "ranked"))


@query("phase_distribution", "V10", "year:i month:i country_code:s turning_point_phase:s n_cities:l avg_score:d2 avg_green_index:d4", ctes("gold", """
    SELECT year, month, country_code, country_name, turning_point_phase, count(*) AS n_cities, round(avg(investment_score), 8) AS avg_score, round(avg(green_index), 10) AS avg_green_index FROM gold GROUP BY 1, 2, 3, 4, 5"""))
def _(t):
    return op.phase_distribution(t.maintained().gold())


@query("cluster_history", "V11 J16", "city_code:s year:i month:i cluster_sk:i valid_from:date", ctes("panel cities", """
    SELECT city_code, year, month, s_nationkey % 5 AS cluster_sk, DATE '2010-01-01' AS valid_from FROM panel JOIN cities ON entity = city_sk JOIN supplier ON s_suppkey = entity"""))
def _(t):
    zone = t("supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") % 5).alias("cluster_sk"))
    fact = t.panel().join(zone, "entity").withColumnRenamed("entity", "city_sk")
    cluster = t("region").select(F.col("r_regionkey").alias("cluster_sk"), F.lit("2010-01-01").cast("date").alias("valid_from"), F.col("r_name").alias("shape"))
    return op.cluster_history(fact, t.cities(), cluster)


@query("kpi_checks", "V12", "positive_share:d8 cities_scored:l cities_forecast:l clusters_in_range:l clusters_explained:l turning_point_ok:b phases_ok:b fit_ok:b score_ok:b forecast_ok:b", ctes("gold parameters holed", """
    SELECT *, clusters_in_range >= 1 AS turning_point_ok, positive_share > 0.1 AS phases_ok, clusters_explained >= 1 AS fit_ok, cities_scored >= 200 AS score_ok, cities_forecast >= 100 AS forecast_ok FROM (
        SELECT avg(CAST(turning_point_phase IN ('TURNING', 'RECUPERANDO') AS INTEGER)) AS positive_share, count(DISTINCT city_sk) FILTER (investment_score IS NOT NULL) AS cities_scored,
            (SELECT count(DISTINCT entity) FROM fc WHERE ahead = 12 AND forecast IS NOT NULL) AS cities_forecast FROM gold),
        (SELECT count(*) FILTER (beta2 < 0 AND turning_point BETWEEN 15000 AND 80000) AS clusters_in_range, count(*) FILTER (r_squared > 0.10) AS clusters_explained FROM parameters)""", **FORECAST))
def _(t):
    year = forecast.forecast(seasonal(t), "entity", [1]).select(F.col("entity").alias("city_sk"), F.col("forecast").alias("forecast_1y"))
    return op.kpi_checks(t.maintained().gold().join(year, "city_sk", "left"), t.parameters())
