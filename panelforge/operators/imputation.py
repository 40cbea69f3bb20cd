"""Interpolation, fills and source cascades that bring inputs to one grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from .ordering import column_quantiles, quantiles
from .reshape import fan_months, fan_out
from .windows import fill, next_value  # noqa: F401  (I19 uses the fill)
from .joins import fill_uncovered


def interp_monthly(df: DataFrame, entity: str, year: str, value: str, out: str = "monthly") -> DataFrame:
    """Annual values to months on the line toward the next stored year; the last year is flat.

    The next stored value is used even across missing years. A NULL next value gives NULL for
    the months after January, a NULL own value gives NULL throughout.
    """
    ahead = next_value(df, [entity], [year], value, "_next")
    step = (F.col("_next") - F.col(value)) * (F.col("month") - 1) / 12
    flat = fan_months(ahead)
    return flat.withColumn(out, F.when(F.col("month") == 1, F.col(value)).otherwise(F.col(value) + step)).drop("_next")


def _bridge(grid: DataFrame, entity: str, year: str, value: str) -> tuple[Column, Column, Column]:
    w = Window.partitionBy(entity).orderBy(year)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = nxt["y"] - prev["y"]
    line = F.when(gap == 0, prev["v"]).otherwise(
        prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(F.col(year) - prev["y"], gap))
    return line, prev["v"], nxt["v"]


def interp_grid(df: DataFrame, entity: str, year: str, value: str, lo: int, hi: int) -> DataFrame:
    """Linear over a full year range; before the first and after the last known value it is held."""
    grid = df.select(entity).distinct().withColumn(year, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    joined = grid.join(df.select(entity, year, value), [entity, year], "left")
    line, prev, nxt = _bridge(joined, entity, year, value)
    return joined.withColumn(value, F.coalesce(line, prev, nxt))


def interp_interior(df: DataFrame, grid: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """Linear only between two known values of the given grid."""
    joined = grid.select(entity, year).join(df.select(entity, year, value), [entity, year], "left")
    line, _, _ = _bridge(joined, entity, year, value)
    return joined.withColumn(value, line)


def impute_group_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
    return out.select(*df.columns)


def impute_base_year(df: DataFrame, entity: str, year: str, base: int, cols: list[str]) -> DataFrame:
    """Fill NULLs with the entity's value of one base year."""
    at = df.groupBy(entity).agg(*[F.max(F.when(F.col(year) == base, F.col(c))).alias(f"_b_{c}") for c in cols])
    out = df.join(at, entity, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in cols})
    return out.select(*df.columns)


def impute_median(df: DataFrame, cols: list[str], keys: list[str] | None = None, default: float = 0.0) -> DataFrame:
    """Fill NULLs with the column's exact median (of the group, if keyed), else ``default``."""
    if not keys:
        med = column_quantiles(df, cols, {"m": 0.5})
        return df.withColumns({c: F.coalesce(F.col(c), med[c]["m"], F.lit(default)) for c in cols})
    found = quantiles(df, cols, [0.5], keys)
    medians = found.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_m_{c}") for c in cols])
    out = df.join(medians, keys, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(default)) for c in cols})
    return out.select(*df.columns)


def impute_nearest_year(df: DataFrame, grid: DataFrame, entity: str, year: str, c: str) -> DataFrame:
    """Value of the nearest year that has one; of two equally near the earlier."""
    joined = grid.select(entity, year).join(df.select(entity, year, c), [entity, year], "left")
    w = Window.partitionBy(entity).orderBy(year)
    known = F.when(F.col(c).isNotNull(), F.struct(F.col(year).alias("y"), F.col(c).alias("v")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    earlier = prev.isNotNull() & (nxt.isNull() | (F.col(year) - prev["y"] <= nxt["y"] - F.col(year)))
    return joined.withColumn(c, F.when(earlier, prev["v"]).otherwise(nxt["v"]))


def fill_from(df: DataFrame, secondary: DataFrame, on: list[str], c: str, when: Column, order: list[str] | None = None) -> DataFrame:
    """Take a second sensor's value only where the own one is NULL and ``when`` holds; of several the first in ``order``, or the smallest."""
    side = secondary.groupBy(*on).agg(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*(order or []), c))).alias("_second"))
    out = df.join(side, on, "left")
    return out.withColumn(c, F.when(F.col(c).isNull() & when, F.col("_second")).otherwise(F.col(c))).drop("_second")


def harmonise_sensors(df: DataFrame, entity: str, year: str, month: str, value: str, sensor: str, old: str, new: str,
                      overlap: list[int], default_factor: float = fv.SENSOR_FALLBACK_RATIO) -> DataFrame:
    """Rescale the old sensor by its ratio to the new one on overlap years, spread it over the
    months, and append the new sensor's monthly values.

    The old sensor is annual: it is brought to one mean per entity and year first.
    """
    both = F.col(year).isin(list(overlap))
    ratio = df.groupBy(entity).agg(
        F.avg(F.when(both & (F.col(sensor) == new), F.col(value))).alias("_new"),
        F.avg(F.when(both & (F.col(sensor) == old), F.col(value))).alias("_old"),
    )
    usable = (F.col("_old") > 0) & (F.col("_new") != 0)
    factor = F.when(usable, F.col("_new") / F.col("_old")).otherwise(F.lit(default_factor))
    annual = df.filter(F.col(sensor) == old).groupBy(entity, year).agg(F.avg(value).alias(value))
    scaled = annual.join(ratio, entity, "left").withColumn(value, F.col(value) * factor)
    spread = fan_months(scaled.select(entity, year, value)).withColumnRenamed("month", month)
    recent = df.filter(F.col(sensor) == new).select(entity, year, month, value)
    return spread.withColumn(sensor, F.lit(old)).unionByName(recent.withColumn(sensor, F.lit(new)))


def disaggregate(annual: DataFrame, value: str, index: dict[int, float] = fv.CARBON_MONTH_INDEX) -> DataFrame:
    """Annual price times a month index."""
    months = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(float(w)).alias("w")) for m, w in index.items()]))
    out = annual.withColumn("_m", months)
    return out.withColumns({"month": F.col("_m.month"), value: F.round(F.col(value) * F.col("_m.w"), 4)}).drop("_m")


def cascade_series(frames: list[tuple[str, DataFrame]], entity: str, label: str = "source") -> DataFrame:
    """For each entity the whole series of the best source that has it, labelled."""
    ranked = [f.withColumns({label: F.lit(n), "_p": F.lit(i)}) for i, (n, f) in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    best = union.groupBy(F.col(entity).alias("_e")).agg(F.min("_p").alias("_best"))
    return union.join(best, (union[entity] == best["_e"]) & (union["_p"] == best["_best"]), "left_semi").drop("_p")


def cascade_cells(frames: list[tuple[str, DataFrame]], on: list[str], value: str, label: str = "source",
                  base: DataFrame | None = None) -> DataFrame:
    """For each cell of a grid the first source with a value, labelled."""
    out = base.select(*on) if base is not None else reduce(
        lambda a, b: a.unionByName(b), [f.select(*on) for _, f in frames]).distinct()
    for i, (_, f) in enumerate(frames):
        out = out.join(f.select(*on, F.col(value).alias(f"_v{i}")), on, "left")
    vals = [F.col(f"_v{i}") for i in range(len(frames))]
    names = [F.when(v.isNotNull(), F.lit(n)) for v, (n, _) in zip(vals, frames)]
    return out.select(*on, F.coalesce(*vals).alias(value), F.coalesce(*names).alias(label))


def prefer_category(df: DataFrame, c: str, ordered: list[str]) -> DataFrame:
    """Only the rows of the first listed category that occurs anywhere."""
    place = reduce(lambda acc, p: acc.when(F.col(c) == p[1], F.lit(p[0])), list(enumerate(ordered))[1:],
                   F.when(F.col(c) == ordered[0], F.lit(0)))
    best = df.agg(F.min(place).alias("b")).scalar()
    return df.filter(place == best)


def first_non_empty(frames: list[DataFrame]) -> DataFrame:
    """The first frame that has rows, decided inside the plan."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = union.agg(F.min("_p").alias("b")).scalar()
    return union.filter(F.col("_p") == best).drop("_p")


def blend(primary: DataFrame, country: DataFrame, members: DataFrame, entity: str, group: str, keys: list[str],
          value: str, labels: tuple[str, str] = ("STATION", "COUNTRY"), label: str = "source") -> DataFrame:
    """Own monthly series, plus the group's annual series for entity-months it does not cover."""
    own = primary.select(*keys, value).withColumn(label, F.lit(labels[0]))
    wide = fan_months(fan_out(country, members.select(entity, group), group))
    shared = wide.select(*keys, value).withColumn(label, F.lit(labels[1]))
    return fill_uncovered(own, shared, keys)


def coverage_gate(df: DataFrame, entity: str, year: str, c: str, n: int = 6) -> DataFrame:
    """Only entity-years with at least ``n`` valid months."""
    enough = df.groupBy(entity, year).agg(F.count(c).alias("_n")).filter(F.col("_n") >= n)
    return df.join(enough, [entity, year], "left_semi")
