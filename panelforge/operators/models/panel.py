"""Two-way fixed-effects quadratic panel regression, all groups at once, without iteration.

Entity effects are eliminated by aggregation. What remains is one linear system per group over its periods (the Schur
complement of the entity block), of a calendar's size however many entities there are; it is summed from the entities'
distinct sets of periods and solved once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ...functions.scalars import col
from ...streaming.storage import stored


def log_floor(c, floor: float = 1e-6) -> Column:
    return F.log(F.greatest(col(c), F.lit(floor)))


def _complement(batches):
    """Rows (group, periods with their counts, number of entities) to the sums (group, t, u, s) of c c' / n, added up within a task."""
    places: dict[object, dict[object, int]] = {}
    sums: dict[object, np.ndarray] = {}
    kinds = None
    for batch in batches:
        kinds = batch.column(0).type, batch.column(1).type.value_type.field("t").type
        for group, cells, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at = places.setdefault(group, {})
            index = [at.setdefault(c["t"], len(at)) for c in cells]
            held = sums.get(group)
            if held is None or len(held) < len(at):
                grown = np.zeros((2 * len(at), 2 * len(at)))
                if held is not None:
                    grown[:len(held), :len(held)] = held
                held = sums[group] = grown
            c = np.array([x["c"] for x in cells], float)
            held[np.ix_(index, index)] += np.outer(c, c) * (n / c.sum())
    for group, held in sums.items():
        times = list(places[group])
        i, j = np.nonzero(held[:len(times), :len(times)])
        yield pa.RecordBatch.from_arrays([
            pa.array([group] * len(i), kinds[0]), pa.array([times[k] for k in i], kinds[1]), pa.array([times[k] for k in j], kinds[1]), pa.array(held[i, j])],
            ["g", "t", "u", "s"])


def time_effects(centred: DataFrame, group: str, entity: str, time: str, cols: list[str]) -> DataFrame:
    """(group, time, ``_t_`` effects) of columns that are free of entity means: the least-norm solution of each group's system."""
    g, t = (centred.schema[c].dataType.simpleString() for c in (group, time))
    cells = centred.groupBy(group, entity, time).agg(F.count(F.lit(1)).alias("c")).groupBy(group, entity).agg(
        F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "c"))).alias("cells"))  # a calendar's length
    patterns = cells.groupBy(F.col(group).alias("g"), "cells").agg(F.count(F.lit(1)).alias("n"))
    shared = patterns.mapInArrow(_complement, f"g {g}, t {t}, u {t}, s double").groupBy("g", "t", "u").agg((-F.sum("s")).alias("s"))
    side = centred.groupBy(F.col(group).alias("g"), F.col(time).alias("t")).agg(
        F.count(F.lit(1)).cast("double").alias("s"), *[F.sum(c).alias(f"_t_{c}") for c in cols])
    names = [f"_t_{c}" for c in cols]
    rows = side.withColumn("u", F.lit(None).cast(t)).select("g", "t", "u", "s", *names).unionByName(
        shared.select("g", "t", "u", "s", *[F.lit(None).cast("double").alias(c) for c in names]))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf[pdf["u"].isna()].sort_values("t")
        place = {v: i for i, v in enumerate(right["t"])}
        a = np.diag(right["s"].to_numpy(float))
        pairs = pdf[pdf["u"].notna()]
        np.add.at(a, (pairs["t"].map(place).to_numpy(), pairs["u"].map(place).to_numpy()), pairs["s"].to_numpy())
        effects = np.linalg.lstsq(a, right[names].to_numpy(float), rcond=1e-12)[0]
        return pd.DataFrame({"g": right["g"], "t": right["t"]} | {c: effects[:, i] for i, c in enumerate(names)})

    found = rows.groupBy("g").applyInPandas(solved, f"g {g}, t {t}, " + ", ".join(f"{c} double" for c in names))
    return found.withColumnsRenamed({"g": group, "t": time})


def within(df: DataFrame, group: str, entity: str, time: str, cols: list[str]) -> DataFrame:
    """Rows with entity and time effects taken out of ``cols``, exactly, in a fixed number of passes.

    Entity means use a window: one entity holds one row per period. A panel of parts that share no period, and periods
    that share no entity, are solved as well; a group of one period keeps nothing.
    """
    by_entity = Window.partitionBy(group, entity)
    centre = lambda d: d.withColumns({c: F.col(c) - F.avg(c).over(by_entity) for c in cols})
    centred = stored(centre(df), "centred")
    effects = stored(time_effects(centred, group, entity, time, cols), "effects")
    out = centred.join(effects, [group, time]).withColumns({c: F.col(c) - F.col(f"_t_{c}") for c in cols})
    return stored(centre(out.drop(*[f"_t_{c}" for c in cols])), "within")


def panel_fe(df: DataFrame, entity: str, time: str, y: str, x: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Fit ``y ~ x + x^2`` with entity and time effects in each group.

    Returns (one row per group: beta1, beta2, alpha, counts; rows with within-residuals).
    """
    base = df.select(
        F.col(group), F.col(entity), F.col(time), F.col(y).alias("_y0"), F.col(x).alias("_x0"),
        (F.col(x) * F.col(x)).alias("_q0"),
    ).dropna().withColumns({"_y": F.col("_y0"), "_x": F.col("_x0"), "_q": F.col("_q0")})
    w = within(base, group, entity, time, ["_y", "_x", "_q"])
    sizes = w.groupBy(group, entity).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(F.count(F.lit(1)).alias("n_entities"))
    times = w.groupBy(group, time).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg(F.count(F.lit(1)).alias("n_periods"))
    s = w.groupBy(group).agg(
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_x") * F.col("_q")).alias("_xq"),
        F.sum(F.col("_q") * F.col("_q")).alias("_qq"), F.sum(F.col("_x") * F.col("_y")).alias("_xy"),
        F.sum(F.col("_q") * F.col("_y")).alias("_qy"), F.sum(F.col("_y") * F.col("_y")).alias("sst"),
        F.count(F.lit(1)).alias("n_obs"), F.avg("_y0").alias("_my"), F.avg("_x0").alias("_mx"), F.avg("_q0").alias("_mq"),
    )
    det = F.col("_xx") * F.col("_qq") - F.col("_xq") * F.col("_xq")
    # No slope where x and x^2 are collinear or nothing but rounding is left of x after demeaning.
    moves = F.col("_xx") > 1e-18 * F.col("n_obs") * (1 + F.col("_mx") * F.col("_mx"))
    det = F.when(moves & (det > 1e-12 * F.col("_xx") * F.col("_qq")), det)
    b1 = F.try_divide(F.col("_xy") * F.col("_qq") - F.col("_qy") * F.col("_xq"), det)
    b2 = F.try_divide(F.col("_qy") * F.col("_xx") - F.col("_xy") * F.col("_xq"), det)
    fit = s.withColumns({"beta1": b1, "beta2": b2}).withColumn(
        "alpha", F.col("_my") - F.col("beta1") * F.col("_mx") - F.col("beta2") * F.col("_mq"))
    fit = fit.join(sizes, group).join(times, group)
    betas = fit.select(group, "beta1", "beta2")
    residuals = w.join(betas, group).withColumn(
        "_e", F.col("_y") - F.col("beta1") * F.col("_x") - F.col("beta2") * F.col("_q")).drop("beta1", "beta2")
    return fit, residuals


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps up."""
    z = x + 8
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def student_p(t: Column, freedom: Column, terms: int = 200) -> Column:
    """Two-sided p-value of Student's t: the regularised incomplete beta function at n / (n + t^2), by its continued fraction.

    The fraction converges fast left of the mean of the beta distribution; right of it the complement is taken.
    """
    n = freedom.cast("double")
    x = n / (n + t * t)

    def beta(x, a, b):
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
        tiny = 1e-300
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

        def turn(s, num):
            d = 1 / safe(1 + num * s["d"])
            c = safe(1 + num / s["c"])
            return c, d, s["h"] * c * d

        def step(s, m):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            c, d, h = turn(s, even)
            half = {"c": c, "d": d, "h": h}
            c, d, h = turn(half, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
            return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

        d0 = 1 / safe(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        return front * F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), start, step)["h"]

    half = F.lit(0.5)
    left = x < (n / 2 + 1) / (n / 2 + 2.5)
    value = F.when(x >= 1, 1.0).when(left, beta(x, n / 2, half)).otherwise(1 - beta(1 - x, half, n / 2))
    return F.when(freedom > 0, value)


def panel_fe_se(fit: DataFrame, residuals: DataFrame, group: str, entity: str) -> DataFrame:
    """Entity-clustered standard errors, t and p (Student's t with the residual degrees of freedom) of both slopes."""
    score = residuals.groupBy(group, entity).agg(
        F.sum(F.col("_x") * F.col("_e")).alias("u"), F.sum(F.col("_q") * F.col("_e")).alias("v"), F.sum(F.col("_e") * F.col("_e")).alias("ee"))
    meat = score.groupBy(group).agg(
        F.sum(F.col("u") * F.col("u")).alias("_uu"), F.sum(F.col("u") * F.col("v")).alias("_uv"), F.sum(F.col("v") * F.col("v")).alias("_vv"), F.sum("ee").alias("_ee"))
    # With two entities the scores vanish but for rounding: there is no clustered error to speak of.
    told = (F.col("_uu") > 1e-20 * F.col("_xx") * F.col("_ee")) & (F.col("_vv") > 1e-20 * F.col("_qq") * F.col("_ee"))
    det = F.col("_xx") * F.col("_qq") - F.col("_xq") * F.col("_xq")
    a, b, c = F.try_divide(F.col("_qq"), det), F.try_divide(-F.col("_xq"), det), F.try_divide(F.col("_xx"), det)
    df_left = F.col("n_obs") - (F.col("n_entities") + F.col("n_periods") - 1) - 2
    scale = F.when((df_left > 0) & told, F.col("n_obs") / df_left)
    v1 = scale * (a * a * F.col("_uu") + 2 * a * b * F.col("_uv") + b * b * F.col("_vv"))
    v2 = scale * (b * b * F.col("_uu") + 2 * b * c * F.col("_uv") + c * c * F.col("_vv"))
    out = fit.join(meat, group).withColumns({"beta1_se": F.sqrt(v1), "beta2_se": F.sqrt(v2)})
    out = out.withColumns({
        "beta1_t": F.try_divide(F.col("beta1"), F.col("beta1_se")), "beta2_t": F.try_divide(F.col("beta2"), F.col("beta2_se"))})
    return out.withColumns({"beta1_p": student_p(F.col("beta1_t"), df_left), "beta2_p": student_p(F.col("beta2_t"), df_left)})


def panel_fe_quality(fit: DataFrame, residuals: DataFrame, group: str, entity: str) -> DataFrame:
    """R^2 after both effects, within R^2 (entity effects only), F, AIC and BIC."""
    by_entity = Window.partitionBy(group, entity)
    raw = residuals.withColumns({
        f"_w{c}": F.col(f"_{c}0") - F.avg(f"_{c}0").over(by_entity) for c in ("y", "x", "q")})
    raw = raw.join(fit.select(group, "beta1", "beta2"), group)
    gap = F.col("_wy") - F.col("beta1") * F.col("_wx") - F.col("beta2") * F.col("_wq")
    sums = raw.groupBy(group).agg(
        F.sum(F.col("_e") * F.col("_e")).alias("ssr"), F.sum(gap * gap).alias("_wssr"), F.sum(F.col("_wy") * F.col("_wy")).alias("_wsst"))
    out = fit.join(sums, group)
    n, k = F.col("n_obs"), 3
    df_left = n - (F.col("n_entities") + F.col("n_periods") - 1) - 2
    loglik = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(F.col("ssr") / n) + 1)
    return out.withColumns({
        "r_squared": 1 - F.try_divide(F.col("ssr"), F.col("sst")),
        "r_squared_within": 1 - F.try_divide(F.col("_wssr"), F.col("_wsst")),
        "f_stat": F.when(df_left > 0, F.try_divide((F.col("sst") - F.col("ssr")) / 2, F.col("ssr") / df_left)),
        "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + F.log(n.cast("double")) * k,
    })


def turning_point(fit: DataFrame, alpha: float = 0.05, min_obs: int = 30) -> DataFrame:
    """Turning point exp(-b1 / 2 b2), curve shape, hypothesis flag, and why a fit is unusable.

    Needs ``beta1_p``/``beta2_p``. A group below ``min_obs`` keeps its row with a reason.
    """
    b1, b2 = F.col("beta1"), F.col("beta2")
    enough = F.col("n_obs") >= min_obs
    ln_y = F.when(enough & (b2 != 0), -b1 / (2 * b2))
    shape = (
        F.when(~enough | b1.isNull() | b2.isNull(), "UNCLEAR").when((b1 > 0) & (b2 < 0), "INVERTED_U")
        .when((b1 > 0) & (b2 > 0), "MONOTONIC_UP").when(b1 < 0, "MONOTONIC_DOWN").otherwise("UNCLEAR")
    )
    confirmed = (b1 > 0) & (b2 < 0) & (F.col("beta1_p") < alpha) & (F.col("beta2_p") < alpha)
    reason = F.when(~enough, "TOO_FEW_OBSERVATIONS").when(b1.isNull() | b2.isNull(), "SINGULAR").when(b2 == 0, "NO_CURVATURE")
    return fit.withColumns({
        "turning_point_ln": ln_y, "turning_point": F.exp(ln_y), "shape": shape,
        "hypothesis_supported": F.coalesce(enough & confirmed, F.lit(False)), "reason": reason,
    })


def gap_to_turning(fact: DataFrame, fit: DataFrame, group: str, level: str) -> DataFrame:
    """Distance of each row's level to its group's turning point."""
    side = fit.select(group, "turning_point", "shape")
    return fact.join(side, group, "left").withColumn("gap_to_turning", F.col(level) - F.col("turning_point"))
