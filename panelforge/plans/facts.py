"""Facts of the star schema, the wide gold fact, its ranking and the annual master panel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import annualise, date_key, first_token, guarded_log, valid_from
from ..operators.aggregates import collect_distinct, concat_distinct, group_mean, group_mixed, slope
from ..operators.dimensional import placeholders, to_surrogate
from ..operators.imputation import fill_from, harmonise_sensors, interp_interior, interp_monthly
from ..operators.joins import attach, attach_group, entity_else_group, join_current
from ..operators.metrics import green_index, natural_cover, score
from ..operators.ordering import rank_in
from ..operators.reshape import fan_months
from ..operators.windows import change, yoy_diff, yoy_pct

MONTHLY = ["city_code", "year", "month"]


def environmental_fact(base: DataFrame, cities: DataFrame, monthly: list[DataFrame] = (), annual: list[DataFrame] = (),
                       old_vegetation: DataFrame | None = None, lights: DataFrame | None = None, gap_before: int = 2004,
                       overlap: tuple[int, ...] = (2012, 2013), unique_sides: bool = False,
                       store: Callable[[DataFrame], DataFrame] = DataFrame.checkpoint, unmatched: Observation | None = None) -> DataFrame:
    """City-month environment: monthly sides on the full key, annual sides repeated, gaps filled
    from the old sensor, light sensors harmonised, index and yearly change derived.

    The index needs the table's bounds before its rows, so the joined table is stored once (by
    ``store``, a checkpoint by default) and then read twice. ``unique_sides`` says that every side
    already holds one row per key, which saves the step that makes it so. ``unmatched`` receives, once the result has been
    computed, ``n_dropped``: the rows whose city is unknown.
    """
    df = attach(base, list(monthly), MONTHLY, not unique_sides)
    df = attach(df, list(annual), ["city_code", "year"], not unique_sides)
    if old_vegetation is not None:
        df = fill_from(df, old_vegetation, MONTHLY, "ndvi_mean", F.col("year") < gap_before)
    if lights is not None:
        one = harmonise_sensors(lights, "city_code", "year", "month", "ntl_mean", "ntl_source", "DMSP", "VIIRS", list(overlap))
        # A month both sensors cover takes the new one.
        best = one.groupBy(*MONTHLY).agg(F.max_by("ntl_mean", F.struct(F.col("ntl_source") == "VIIRS", "ntl_mean")).alias("ntl_mean"))
        df = df.join(best, MONTHLY, "left")
    df = store(df)
    df = yoy_diff(df, "city_code", "year", "month", "ndvi_mean", "ndvi_yoy_change")
    has = set(df.columns)
    df = green_index(df, "ndvi_mean", "no2_mean" if "no2_mean" in has else None,
                     "imperviousness_mean" if "imperviousness_mean" in has else None)
    cover = [c for c in ("wc_tree_pct", "wc_shrub_pct", "wc_grass_pct", "wc_water_pct") if c in has]
    if cover:
        df = natural_cover(df, cover, "wc_natural_pct")
    df = df.withColumn("date_sk", date_key("year", "month"))
    if unmatched is None:
        return to_surrogate(df, cities, "city_code", "city_sk")[0]
    placed = df.join(cities.select("city_code", "city_sk"), "city_code", "left")
    return placed.observe(unmatched, F.count_if(F.col("city_sk").isNull()).alias("n_dropped")).filter(F.col("city_sk").isNotNull())


def _by_group_time(df: DataFrame, side: DataFrame, group: list[str], value: str, unique: bool) -> DataFrame:
    """Monthly value of a group; rows without a month serve the whole year.

    A side known to be unique holds months only, or no month column at all.
    """
    if "month" not in side.columns:
        return attach_group(df, side.select(*group, "year", value), [*group, "year"], not unique)
    if unique:
        return attach(df, [side.select(*group, "year", "month", value)], [*group, "year", "month"], False)
    exact = side.filter(F.col("month").isNotNull()).select(*group, "year", "month", F.col(value).alias("_m"))
    whole = side.filter(F.col("month").isNull()).select(*group, "year", F.col(value).alias("_y"))
    out = attach(attach(df, [exact], [*group, "year", "month"]), [whole], [*group, "year"])
    return out.withColumn(value, F.coalesce("_m", "_y")).drop("_m", "_y")


def economic_fact(gdp: DataFrame, cities: DataFrame, population: DataFrame | None = None, renewables: DataFrame | None = None,
                  tourism: DataFrame | None = None, tourism_country: DataFrame | None = None, carbon: DataFrame | None = None,
                  co2: DataFrame | None = None, carbon_start: int = fv.CARBON_MARKET_START, unique_sides: bool = False) -> DataFrame:
    """City-month economy. ``gdp`` is (city_code, year, gdp); ``cities`` maps city to country and key.

    ``unique_sides``: every side holds one row per key, monthly sides with their month.
    """
    base = gdp.join(cities.select("city_code", "country_code", "city_sk"), "city_code", "inner")
    df = interp_monthly(base, "city_code", "year", "gdp", "gdp_monthly").drop("gdp")
    ln = guarded_log("gdp_monthly")
    df = df.withColumns({"ln_gdp": ln, "ln_gdp_sq": ln * ln, "date_sk": date_key("year", "month")})
    if population is not None:
        df = attach(df, [population], ["city_code", "year"], not unique_sides)
    if renewables is not None:
        df = _by_group_time(df, renewables, ["country_code"], "renewables_pct", unique_sides)
    if tourism is not None:
        # Without a country table, the first listed city speaks for its country.
        shared = tourism_country if tourism_country is not None else tourism.groupBy("country_code", "year", "month").agg(
            F.min_by("tourism_nights", "city_code").alias("tourism_nights"))
        df = entity_else_group(df, tourism, shared, MONTHLY, ["country_code", "year", "month"], "tourism_nights")
    if carbon is not None:
        df = _by_group_time(df, carbon, [], "ets_price_eur", unique_sides)
        df = df.withColumn("ets_price_eur", valid_from("ets_price_eur", "year", carbon_start))
    if co2 is not None:
        df = attach_group(df, co2, ["country_code", "year"], not unique_sides)
    df = yoy_pct(df, "city_code", "year", "month", "gdp_monthly", "gdp_growth_rate")
    return df.withColumn("gdp_growth_rate", F.round("gdp_growth_rate", 4))


def policy_fact(constants: DataFrame, interpolated: DataFrame, counted: DataFrame, value: str = "co2_kt") -> DataFrame:
    """Country-month policy on the grid of all countries and years any source knows.

    ``constants`` and ``counted`` are repeated over the year, ``value`` of ``interpolated`` is
    bridged linearly between its known years.
    """
    keys = ["country_code", "year"]
    seen = reduce(lambda a, b: a.unionByName(b), [d.select(*keys) for d in (constants, interpolated, counted)]).dropna()
    years = seen.agg(F.array_sort(F.collect_set("year")).alias("y")).scalar()  # a handful of calendar years
    grid = seen.select("country_code").distinct().withColumn("year", F.explode(years))
    bridged = interp_interior(interpolated.groupBy(*keys).agg(F.max(value).alias(value)), grid, "country_code", "year", value)
    out = attach(bridged, [constants, counted], keys)
    return fan_months(out).withColumn("date_sk", date_key("year", "month"))


def market_fact(monthly: DataFrame, companies: DataFrame) -> DataFrame:
    """Company-month market rows of current companies; a missing month counts as January."""
    df = monthly.withColumn("month", F.coalesce(F.col("month"), F.lit(1))) if "month" in monthly.columns else monthly.withColumn("month", F.lit(1))
    current = companies.filter("is_current").select("ticker", "company_sk")
    return df.join(current, "ticker", "inner").withColumn("date_sk", date_key("year", "month"))


def market_by_country(market: DataFrame, companies: DataFrame) -> DataFrame:
    """Tickers and means per country-month."""
    keys = ["country_code", "year", "month"]
    rows = join_current(market, companies.select("company_sk", "is_current", "country_code", F.col("ticker").alias("_ticker")), ["company_sk"])
    sums = rows.groupBy(*keys).agg(F.avg("close_price").alias("fin_close_price_avg"), F.avg("monthly_volatility").alias("fin_monthly_volatility"))
    out = sums.join(concat_distinct(rows, keys, "_ticker", ",", "fin_tickers"), keys, "left")
    return out.withColumn("fin_annual_volatility", annualise("fin_monthly_volatility"))


def gold_fact(env: DataFrame, city: DataFrame, eco: DataFrame | None = None, policy: DataFrame | None = None,
              market: DataFrame | None = None, veg: str = "ndvi_mean", unique_sides: bool = False) -> DataFrame:
    """Wide fact per city-month with trend, score and recommendation."""
    trend = slope(env.filter(F.col(veg).isNotNull()), ["city_sk"], "year", veg, 2, None, "ndvi_trend_slope")
    df = env.join(trend, "city_sk", "left").join(city, "city_sk", "left")
    if eco is not None:
        df = attach(df, [eco], ["city_sk", "year", "month"], not unique_sides)
    for side in (policy, market):
        if side is not None:
            df = attach_group(df, side, ["country_code", "year", "month"], not unique_sides)
    optional = {c: F.lit(None).cast("double") for c in ("renewables_pct", "pm25_mean", "ets_price_eur")}
    df = placeholders(df, {**optional, "fin_tickers": F.lit(None).cast("string")})
    df = score(df, "green_index", "renewables_pct", "pm25_mean", "ets_price_eur")
    return placeholders(df, {
        "turning_point_phase": F.lit("PENDING"), "phase_confidence": F.lit(None).cast("double"),
        "cluster_id": F.lit(None).cast("int"), "gap_to_turning": F.lit(None).cast("double"),
    })


def ranking(fact: DataFrame, entity: str = "city_sk", group: str = "country_code", measure: str = "investment_score") -> DataFrame:
    """Rank per month and per month and country, movement, first listed ticker.

    ``fact`` is read several times: pass the stored gold table, not the plan that builds it.
    """
    df = rank_in(fact, ["year", "month"], measure, "rank_position")
    df = rank_in(df, ["year", "month", group], measure, "rank_within_country", source=fact)
    df = change(df, entity, ["year", "month"], "rank_position", measure)
    return df.withColumn("top_ticker", first_token("fin_tickers", 20)) if "fin_tickers" in df.columns else df


def master_panel(vegetation: DataFrame, market: DataFrame, sealing: DataFrame | None = None, no2: DataFrame | None = None,
                 climate: DataFrame | None = None, emissions: DataFrame | None = None, policy: DataFrame | None = None,
                 investment: DataFrame | None = None) -> DataFrame:
    """Annual city panel. Monthly inputs are reduced first; market figures come from the country.

    ``market`` is (country_code, year, ticker, close_price, monthly_volatility); ``policy`` and
    ``investment`` are keyed by city and year, ``emissions`` by country and year.
    """
    key = ["city_code", "year"]
    df = group_mean(vegetation, key, ["ndvi_mean"])
    if no2 is not None:
        df = df.join(group_mean(no2, key, ["no2_mean"]), key, "left")
    if sealing is not None:
        df = attach(df, [sealing], key)
    if climate is not None:
        df = df.join(group_mixed(climate, key, {"temp_mean_c": "mean", "precip_total_m": "sum"}), key, "left")
    trend = slope(df, ["city_code"], "year", "ndvi_mean", 3, 0.0, "ndvi_slope")
    df = df.join(trend, "city_code", "left").withColumn("country_code", F.element_at(F.split("city_code", "_"), -1))
    for side in (policy, investment):
        if side is not None:
            df = attach(df, [side], key)
    if emissions is not None:
        df = attach_group(df, emissions, ["country_code", "year"])
    by = ["country_code", "year"]
    fin = market.groupBy(*by).agg(F.avg("close_price").alias("close_price"), F.avg("monthly_volatility").alias("_vol"))
    fin = fin.join(collect_distinct(market, by, "ticker", "tickers"), by, "left").withColumn("annual_volatility", annualise("_vol")).drop("_vol")
    return df.join(fin, by, "left")
