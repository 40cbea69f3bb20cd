"""Serving queries over the gold fact and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import stable_round
from ..operators.joins import history_view
from ..operators.ordered_sets import last_period, order_nulls_last, top_k


def _year(df: DataFrame, year: int | None) -> DataFrame:
    return df.filter(F.col("year") == year) if year is not None else last_period(df, "year")


def ranking_page(rank: DataFrame, year: int | None = None, country: str | None = None, limit: int = 50) -> DataFrame:
    """Ranking of a year (the latest by default), best first."""
    df = _year(rank, year)
    df = df.filter(F.col("country_code") == country.upper()) if country else df
    return top_k(df, ["rank_position", "month", "city_code"], limit)


def entity_detail(fact: DataFrame, results: DataFrame, code: str, year: int | None = None) -> DataFrame:
    """All months of one entity with its model results."""
    df = fact.filter(F.col("city_code") == code)
    df = df.filter(F.col("year") == year) if year is not None else df
    return df.join(results, ["city_sk", "year", "month"], "left").orderBy("year", "month")


def opportunities(fact: DataFrame, year: int | None = None, country: str | None = None) -> DataFrame:
    df = _year(fact, year).filter(F.col("turning_point_phase") == fv.TURNING)
    df = df.filter(F.col("country_code") == country.upper()) if country else df
    return order_nulls_last(df, "investment_score", ["city_code", "month"])


def cluster_summary(params: DataFrame) -> DataFrame:
    return last_period(params, "estimation_year").orderBy("cluster_id")


def years(fact: DataFrame) -> DataFrame:
    return fact.select("year").distinct().orderBy(F.desc("year"))


def countries(fact: DataFrame) -> DataFrame:
    cities = fact.select("country_code", "country_name", "city_code").distinct()
    return cities.groupBy("country_code", "country_name").agg(F.count("city_code").alias("n_cities")).orderBy("country_code")


def summary(fact: DataFrame) -> DataFrame:
    """Executive summary of the latest year in one row.

    Rows are reduced to one per city first, so distinct counts need no wide shuffle.
    """
    labels = {"cities_turning": fv.TURNING, "cities_recovering": fv.RECOVERING, "cities_degrading": fv.DEGRADING}
    advice = {"strong_buy": "STRONG_BUY", "buy": "BUY", "hold": "HOLD", "avoid": "AVOID"}
    counts = {n: ("turning_point_phase", v) for n, v in labels.items()} | {n: ("investment_recommendation", v) for n, v in advice.items()}
    per = _year(fact, None).groupBy("city_code", "country_code", "year").agg(
        F.sum("green_index").alias("_g"), F.count("green_index").alias("_gn"), F.sum("investment_score").alias("_s"),
        F.count("investment_score").alias("_sn"), *[F.count_if(F.col(c) == v).alias(n) for n, (c, v) in counts.items()])
    return per.groupBy("year").agg(
        F.countDistinct("city_code").alias("total_cities"), F.countDistinct("country_code").alias("total_countries"),
        stable_round(F.sum("_g") / F.sum("_gn"), 4).alias("avg_green_index"), stable_round(F.sum("_s") / F.sum("_sn"), 2).alias("avg_investment_score"),
        *[F.sum(n).alias(n) for n in counts])


def map_view(fact: DataFrame, city: DataFrame) -> DataFrame:
    """Latest month with coordinates."""
    return last_period(fact, "year", "month").join(city.select("city_sk", "lat", "lon"), "city_sk", "inner")


def top20(rank: DataFrame) -> DataFrame:
    return top_k(last_period(rank, "year", "month"), ["rank_position", "city_code"], 20)


def phase_distribution(fact: DataFrame) -> DataFrame:
    keys = ["year", "month", "country_code", "country_name", "turning_point_phase"]
    known = fact.filter(F.col("turning_point_phase").isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cities"), stable_round(F.avg("investment_score"), 2).alias("avg_score"),
        stable_round(F.avg("green_index"), 4).alias("avg_green_index"))


def cluster_history(fact: DataFrame, city: DataFrame, cluster: DataFrame) -> DataFrame:
    """Every month of a city with the cluster version it was assigned."""
    return history_view(fact, city, ["city_sk"], cluster, ["cluster_sk"])


def kpi_checks(fact: DataFrame, params: DataFrame, low: float = 15000, high: float = 80000, positive: float = 0.10,
               r2: float = 0.10, scored: int = 200, forecasted: int = 100) -> DataFrame:
    """One row of acceptance figures and whether each is met."""
    fit = params.agg(F.struct(
        F.count_if((F.col("beta2") < 0) & F.col("turning_point").between(low, high)).alias("in_range"),
        F.count_if(F.col("r_squared") > r2).alias("explained")).alias("s")).scalar()
    per = fact.groupBy("city_sk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("turning_point_phase").isin(fv.TURNING, fv.RECOVERING)).alias("p"),
        F.count("investment_score").alias("s"), F.count("forecast_1y").alias("f"))
    out = per.agg(
        (F.sum("p") / F.sum("n")).alias("positive_share"), F.count_if(F.col("s") > 0).alias("cities_scored"),
        F.count_if(F.col("f") > 0).alias("cities_forecast"))
    return out.withColumns({
        "clusters_in_range": fit["in_range"], "clusters_explained": fit["explained"],
        "turning_point_ok": fit["in_range"] >= 1, "phases_ok": F.col("positive_share") > positive, "fit_ok": fit["explained"] >= 1,
        "score_ok": F.col("cities_scored") >= scored, "forecast_ok": F.col("cities_forecast") >= forecasted})
