"""Per-entity trend and multiplicative yearly pattern, fitted for all entities in one shuffle.

The published pipeline uses a Bayesian library per entity. Here are two models. ``fit_seasonal`` is a least-squares line times
the mean ratio of each calendar month, in closed form. ``fit_changepoints`` is a line whose slope changes at a few of many
candidate months (an absolute-value penalty keeps the others at nothing) times yearly waves. An entity's months are gathered into one
array, bounded by the calendar, and everything after that is one row per entity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..windows import first_rise

Z95 = 1.96


def series(df: DataFrame, entity: str, year: str, month: str, value: str, min_len: int = 24) -> DataFrame:
    """(entity, ds, t, month, y) of entities with at least ``min_len`` known months; t counts months."""
    known = df.filter(F.col(value).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    return known.filter(F.col("_n") >= min_len).select(
        entity, F.make_date(F.col(year), F.col(month), F.lit(1)).alias("ds"),
        (F.col(year) * 12 + F.col(month) - 1).cast("double").alias("t"), F.col(month).alias("month"), F.col(value).alias("y"))


def _mean(values: Column) -> Column:
    """Mean of an array; null where it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _gathered(s: DataFrame, entity: str) -> DataFrame:
    """One row per entity: its months in order, and what bounds need of their spread."""
    return s.groupBy(entity).agg(
        F.sort_array(F.collect_list(F.struct("ds", "t", F.col("month").cast("int").alias("month"), F.col("y").cast("double").alias("y")))).alias("points"),
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_t"), F.regr_sxx("y", "t").alias("sxx"),
        F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row: a generator keeps the planner from repeating them inside the lambdas that use them."""
    held = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.withColumns({n: F.col("_once")[n] for n in columns}).drop("_once")


def fit_seasonal(s: DataFrame, entity: str) -> DataFrame:
    """One row per entity: line, twelve month ratios, spread of the residuals, and its months with trend, season and fitted value.

    A month ratio is the mean of y over trend; ratios are scaled to average 1 over the entity's months.
    """
    line = _gathered(s, entity)
    trend = lambda p: F.col("intercept") + F.col("slope") * p["t"]
    ratio = F.filter(F.transform("points", lambda p: F.struct(p["month"].alias("m"), F.try_divide(p["y"], trend(p)).alias("r"))), lambda x: x["r"].isNotNull())
    by_month = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: _mean(F.transform(F.filter("_ratios", lambda x: x["m"] == m), lambda x: x["r"])))
    known = F.filter("_raw", lambda r: r.isNotNull())
    fit = _once(_once(_once(line, _ratios=ratio), _raw=by_month), _level=_mean(known))
    fit = _once(fit, seasons=F.transform("_raw", lambda r: F.coalesce(F.try_divide(r, F.col("_level")), F.lit(1.0))))
    season = lambda p: F.get("seasons", p["month"] - 1)
    fit = _once(fit, points=F.transform("points", lambda p: F.struct(
        p["ds"].alias("ds"), p["y"].alias("y"), trend(p).alias("trend"), season(p).alias("season"), (trend(p) * season(p)).alias("fitted"))))
    errors = F.transform("points", lambda p: p["y"] - p["fitted"])
    fit = _once(_once(fit, _errors=errors), _bias=_mean(F.col("_errors")))
    square = F.aggregate("_errors", F.lit(0.0), lambda a, e: a + (e - F.col("_bias")) * (e - F.col("_bias")))
    return fit.withColumn("sigma", F.sqrt(F.try_divide(square, F.col("n") - 1))).drop("_ratios", "_raw", "_level", "_errors", "_bias")


def components(fit: DataFrame, entity: str) -> DataFrame:
    """In-sample trend, seasonality (as a share of trend) and fitted value per month."""
    return fit.select(entity, F.inline("points")).select(entity, "ds", "trend", (F.col("season") - 1).alias("seasonality"), "fitted", "y")


def mape(fit: DataFrame, entity: str, floor: float = 0.05) -> DataFrame:
    errors = F.transform("points", lambda p: F.abs(p["y"] - p["fitted"]) / F.greatest(p["y"], F.lit(floor)))
    return fit.select(entity, (_mean(errors) * 100).alias("mape"))


def _months_ahead(fit: DataFrame, months_ahead: int) -> DataFrame:
    ds = F.add_months("last_ds", F.col("ahead"))
    grid = fit.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(months_ahead)))).withColumn("ds", ds)
    return grid.withColumn("t", (F.year("ds") * 12 + F.month("ds") - 1).cast("double"))


def _leverage() -> Column:
    """Share of the residual variance that a value off the line has, its own and that of the fitted line."""
    return 1 + 1 / F.col("n") + F.coalesce(F.try_divide((F.col("t") - F.col("mean_t")) * (F.col("t") - F.col("mean_t")), F.col("sxx")), F.lit(0.0))


def future(fit: DataFrame, entity: str, months_ahead: int = 120) -> DataFrame:
    """The months after each entity's last one, with trend, forecast and the standard error of the forecast."""
    grid = _months_ahead(fit.drop("points"), months_ahead)
    trend = F.col("intercept") + F.col("slope") * F.col("t")
    season = F.coalesce(F.get("seasons", F.month("ds") - 1), F.lit(1.0))
    return grid.select(entity, "ahead", "ds", trend.alias("trend"), (trend * season).alias("forecast"), (F.col("sigma") * F.sqrt(_leverage())).alias("error"))


def forecast(fit: DataFrame, entity: str, horizons: list[int] = (1, 3, 5, 10), level: float = Z95, ahead=future) -> DataFrame:
    """Forecast and bounds at horizons in years, counted from each entity's last month; bounds widen with the horizon."""
    f = ahead(fit, entity, max(horizons) * 12).filter(F.col("ahead").isin([h * 12 for h in horizons]))
    return f.select(
        entity, (F.col("ahead") / 12).cast("int").alias("horizon_years"), "ds", "forecast",
        (F.col("forecast") - level * F.col("error")).alias("lower"), (F.col("forecast") + level * F.col("error")).alias("upper"))


def turning_year(future_rows: DataFrame, entity: str) -> DataFrame:
    """First future year whose mean trend is above the year before."""
    annual = future_rows.groupBy(entity, F.year("ds").alias("year")).agg(F.avg("trend").alias("trend"))
    return first_rise(annual, [entity], "year", "trend", "turning_year")


# ---- changepoints ----------------------------------------------------------------------

_FIT = "struct<first:double,span:double,top:double,level:double,rise:double,knots:array<double>,deltas:array<double>,waves:array<double>,sigma:double,rounds:int,trend:array<double>,season:array<double>>"


def _solve(gram, right, theta, shrink, bend, sweeps: int, tolerance: float):
    """Coordinate descent on normal equations of many entities at once: ``bend`` is the absolute-value penalty of each coefficient.

    Entities lie along the last axis here, so that a step is a few operations on long vectors.
    """
    gram, right, now, bend = (np.ascontiguousarray(np.moveaxis(x, 0, -1)) for x in (gram, right, theta, bend))
    own, held = np.einsum("ppe->pe", gram).copy(), np.empty_like(now)
    diagonal = own + shrink.T
    free, divisor = diagonal > 1e-12, np.maximum(diagonal, 1e-12)
    for _ in range(sweeps):
        before = now.copy()
        for p in range(len(gram)):
            rest = right[p] - np.multiply(gram[p], now, out=held).sum(axis=0) + own[p] * now[p]
            now[p] = np.copysign(np.maximum(np.abs(rest) - bend[p], 0), rest) / divisor[p] * free[p]
        if np.abs(now - before).max(initial=0.0) < tolerance:
            break
    return np.ascontiguousarray(now.T)


def fit_many(series_of: list[tuple], changepoints: int, order: int, tau: float | None, season_scale: float, knots: list[float] | None,
             rounds: int = 20, sweeps: int = 300, tolerance: float = 1e-7) -> list[dict]:
    """Fit (t, y) arrays together: trend given the waves, waves given the trend, until neither moves.

    Scaled as the model is stated: time to 0..1, values by their largest absolute value, the candidates spread over the first four fifths.
    Without ``tau`` nothing is penalised and the trend is plain least squares.
    """
    e, long = len(series_of), max(len(t) for t, _ in series_of)
    known, u, y = np.zeros((e, long)), np.zeros((e, long)), np.zeros((e, long))
    first, span, top = np.zeros(e), np.ones(e), np.ones(e)
    places: list[np.ndarray] = []
    for i, (t, v) in enumerate(series_of):
        n = len(t)
        first[i], span[i], top[i] = t[0], max(t[-1] - t[0], 1.0), np.abs(v).max() or 1.0
        known[i, :n], u[i, :n], y[i, :n] = 1, (t - t[0]) / span[i], v / top[i]
        if knots is None:
            size = int(n * 0.8)
            at = np.unique(np.linspace(0, size - 1, min(changepoints, max(size - 1, 0)) + 1).round().astype(int)[1:])
            places.append(u[i, at])
        else:
            s = (np.array(knots, float) - t[0]) / span[i]
            places.append(s[(s > 0) & (s < 1)])
    most = max((len(s) for s in places), default=0)
    s = np.full((e, most), np.inf)
    for i, p in enumerate(places):
        s[i, :len(p)] = p
    base = np.concatenate([np.ones((e, long, 1)), u[:, :, None], np.maximum(u[:, :, None] - s[:, None, :], 0)], axis=2) * known[:, :, None]
    months = np.zeros((e, long))
    for i, (t, _) in enumerate(series_of):
        months[i, :len(t)] = t
    wave = np.stack([f(2 * np.pi * k * months / 12) for k in range(1, order + 1) for f in (np.sin, np.cos)], axis=2) if order else np.zeros((e, long, 0))
    n = known.sum(axis=1)
    theta, beta, sigma = np.zeros((e, 2 + most)), np.zeros((e, 2 * order)), np.full(e, 0.1)
    trend, season = np.zeros((e, long)), np.ones((e, long))
    used = 0
    for used in range(1, rounds + 1):
        before = np.concatenate([theta, beta], axis=1)
        b = base * (1 + (wave * beta[:, None, :]).sum(axis=2))[:, :, None]
        gram, right = b.transpose(0, 2, 1) @ b, (b * y[:, :, None]).sum(axis=1)
        if tau is None:
            theta = np.stack([np.linalg.lstsq(g, r, rcond=None)[0] for g, r in zip(gram, right)])
        else:
            variance = (sigma ** 2)[:, None]
            shrink = np.concatenate([np.repeat(variance / 25, 2, axis=1), np.zeros((e, most))], axis=1)
            bend = np.concatenate([np.zeros((e, 2)), np.repeat(variance / tau, most, axis=1)], axis=1)
            if used == 1:  # from the plain line
                line = np.linalg.solve(gram[:, :2, :2] + 1e-9 * np.eye(2), right[:, :2, None])[:, :, 0]
                theta[:, :2] = line
            theta = _solve(gram, right, theta, shrink, bend, sweeps, tolerance)
        trend = (base * theta[:, None, :]).sum(axis=2)
        if order:
            c = wave * trend[:, :, None]
            ridge = np.maximum(sigma ** 2 / season_scale ** 2, 1e-9)[:, None, None] * np.eye(2 * order)
            off = (c * ((y - trend) * known)[:, :, None]).sum(axis=1)
            beta = np.linalg.solve(c.transpose(0, 2, 1) @ c + ridge, off[:, :, None])[:, :, 0]
        season = 1 + (wave * beta[:, None, :]).sum(axis=2)
        left = (y - trend * season) * known
        sigma = np.sqrt(np.maximum((left ** 2).sum(axis=1) / n, 1e-12))
        if np.abs(np.concatenate([theta, beta], axis=1) - before).max(initial=0.0) < 1e-5:
            break
    return [{
        "first": float(first[i]), "span": float(span[i]), "top": float(top[i]), "level": float(theta[i, 0]), "rise": float(theta[i, 1]),
        "knots": places[i].tolist(), "deltas": theta[i, 2:2 + len(places[i])].tolist(), "waves": beta[i].tolist(), "sigma": float(sigma[i]), "rounds": used,
        "trend": top[i] * trend[i, :len(t)], "season": season[i, :len(t)],
    } for i, (t, _) in enumerate(series_of)]


def fit_changepoints(s: DataFrame, entity: str, changepoints: int = 25, order: int = 10, tau: float | None = 0.05, season_scale: float = 5.0,
                     knots: list[float] | None = None, together: int = 256) -> DataFrame:
    """One row per entity: the fitted model as struct ``m`` and its months with trend, season and fitted value.

    ``changepoints`` candidates lie in the first four fifths of the months (or at the months ``knots``, counted as t); ``tau`` scales the
    penalty of slope changes, ``season_scale`` that of the waves; ``together`` entities are fitted at once. An entity of one month has a
    level only.
    """
    @F.arrow_udf(_FIT)
    def fitted(points: pa.Array) -> pa.Array:
        # Columns stay Arrow buffers: a Python object for every month of a batch of entities held gigabytes.
        flat, out = points.flatten(), []
        t, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("t", "y"))
        ends = np.cumsum(points.value_lengths().to_numpy(zero_copy_only=False))
        rows = list(zip(np.split(t, ends[:-1]), np.split(y, ends[:-1]))) if len(ends) else []
        for i in range(0, len(rows), together):
            out += fit_many(rows[i:i + together], changepoints, order, tau, season_scale, knots)
        lists = pa.list_(pa.float64())
        return pa.array(out, pa.struct([*[(c, pa.float64()) for c in ("first", "span", "top", "level", "rise")], *[
            (c, lists) for c in ("knots", "deltas", "waves")], ("sigma", pa.float64()), ("rounds", pa.int32()), ("trend", lists), ("season", lists)]))

    # The fit hands over trend and season of its months: summing knots and waves anew for each month took longer than the fit.
    fit = _once(_gathered(s, entity).drop("slope", "intercept"), m=fitted("points"))
    months = F.transform("points", lambda p, i: F.struct(
        p["ds"].alias("ds"), p["y"].alias("y"), F.get(F.col("m")["trend"], i).alias("trend"), F.get(F.col("m")["season"], i).alias("season"),
        (F.get(F.col("m")["trend"], i) * F.get(F.col("m")["season"], i)).alias("fitted")))
    return fit.withColumn("points", months).withColumn("m", F.col("m").dropFields("trend", "season"))


def _trend(t: Column) -> Column:
    """Trend of the model ``m`` at month ``t``."""
    m = F.col("m")
    u = (t - m["first"]) / m["span"]
    bends = F.zip_with(m["knots"], m["deltas"], lambda s, d: d * F.greatest(u - s, F.lit(0.0)))
    return m["top"] * (m["level"] + m["rise"] * u + F.aggregate(bends, F.lit(0.0), lambda a, x: a + x))


def _waves(t: Column) -> Column:
    """Seasonal share of the model ``m`` at month ``t``: sines at even places, cosines at odd ones."""
    turn = lambda i: 2 * math.pi / 12 * (F.floor(i / 2) + 1) * t
    parts = F.transform(F.col("m")["waves"], lambda b, i: b * F.when(i % 2 == 0, F.sin(turn(i))).otherwise(F.cos(turn(i))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def changepoint_future(fit: DataFrame, entity: str, months_ahead: int = 120) -> DataFrame:
    """The months after each entity's last one, with trend, forecast and its standard error.

    The slope may go on changing as it did: as many changes per unit of time as there were candidates, with the mean absolute
    change as their scale. Their summed effect a time h after the last month has variance 2/3 (rate) (scale)^2 h^3, which is what widens
    the bounds most; the spread of the residuals and that of the fitted line are added.
    """
    m = F.col("m")
    grid = _months_ahead(fit.drop("points"), months_ahead).withColumn("_trend", _trend(F.col("t"))).withColumn("_season", 1 + _waves(F.col("t")))
    h = (F.col("t") - m["first"]) / m["span"] - 1
    scale = F.coalesce(_mean(F.transform(m["deltas"], lambda d: F.abs(d))), F.lit(0.0))
    drift = 2 / 3 * F.size(m["knots"]) * scale * scale * h * h * h * F.col("_season") * F.col("_season")
    error = m["top"] * F.sqrt(m["sigma"] * m["sigma"] * _leverage() + drift)
    return grid.select(entity, "ahead", "ds", F.col("_trend").alias("trend"), (F.col("_trend") * F.col("_season")).alias("forecast"), error.alias("error"))
