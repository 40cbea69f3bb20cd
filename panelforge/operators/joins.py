"""Joins of panels, lookups and fallbacks.

No hint is given but for a list whose length is bounded: the planner broadcasts a side whose size it knows to be small,
and adaptive execution does so, or splits a skewed side, from the sizes it measures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..functions.scalars import haversine_km
from ..streaming.storage import stored
from .cleaning import dedupe
from .ordering import same


def attach(base: DataFrame, sides: list[DataFrame], on: list[str], make_unique: bool = True) -> DataFrame:
    """Left-join sides onto a base. A side is made unique on the key first, so rows never multiply."""
    for side in sides:
        if make_unique:
            side = dedupe(side, on, [c for c in side.columns if c not in on])
        base = base.join(side, on, "left")
    return base


def attach_group(base: DataFrame, side: DataFrame, on: list[str], make_unique: bool = True) -> DataFrame:
    """Left-join a coarser table (by group and time) to each member row."""
    return attach(base, [side], on, make_unique)


def join_inner(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "inner")


def outer_panel(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer chain with one shared key."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def first_available(frames: list[tuple[str, DataFrame]], on: list[str], value: str, label: str = "source") -> DataFrame:
    """Full outer of sources; the first non-NULL by priority, with its name."""
    named = [f.select(*on, F.col(value).alias(f"_v{i}")) for i, (_, f) in enumerate(frames)]
    panel = outer_panel(named, on)
    vals = [F.col(f"_v{i}") for i in range(len(frames))]
    names = [F.when(v.isNotNull(), F.lit(n)) for v, (n, _) in zip(vals, frames)]
    out = panel.select(*on, F.coalesce(*vals).alias(value), F.coalesce(*names).alias(label))
    return out.filter(F.col(value).isNotNull())


def prefix_join(a: DataFrame, b: DataFrame, prefix: str, code: str, lengths: list[int], how: str = "left") -> DataFrame:
    """Rows of ``b`` whose ``code`` starts with ``a.prefix``, as an equi-join on the cut code.

    ``lengths`` are the prefix lengths in use; each region is offered once per length.
    """
    cuts = F.array_distinct(F.array(*[F.substring(F.col(code), 1, n) for n in sorted(set(lengths))]))
    offered = b.withColumn("_cut", F.explode(cuts))
    return a.join(offered, a[prefix] == offered["_cut"], how).drop("_cut")


def keep_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def minus_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on), on, "left_anti")


def fill_uncovered(primary: DataFrame, fallback: DataFrame, on: list[str]) -> DataFrame:
    """Primary rows plus fallback rows for keys the primary does not hold."""
    return primary.unionByName(minus_keys(fallback, primary, on), allowMissingColumns=True)


def join_current(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return fact.join(dim.filter("is_current"), on, how)


def _hot_keys(fact: DataFrame, on: list[str], share: int) -> DataFrame:
    """Keys that hold more than one ``share``-th of the rows: fewer than ``share`` of them."""
    counted = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") * share > counted.agg(F.sum("_n")).scalar()).select(*on)


def join_valid_at(fact: DataFrame, dim: DataFrame, on: list[str], date: str, how: str = "left", share: int | None = None) -> DataFrame:
    """Dimension versions valid on a date: every version of the key whose range holds it; an open end is null or far away.

    The key is the hash key. A key that holds more than one ``share``-th of the rows (by default four per shuffle partition) is
    dealt by month as well: its rows meet the versions of their month alone, in as many tasks as it has months, and its versions
    stand once in each month of the facts that they touch.
    """
    spark = fact.sparkSession
    share = share or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    month = lambda d: F.year(d) * 12 + F.month(d)
    # Fewer than ``share`` keys: small enough to send to every task.
    hot = F.broadcast(_hot_keys(fact, on, share).select(*[F.col(k).alias(f"_h_{k}") for k in on], F.lit(True).alias("_hot")))

    def marked(df):
        return df.join(hot, same(df, hot, [(k, f"_h_{k}") for k in on]), "left").drop(*[f"_h_{k}" for k in on])

    rows = marked(fact).withColumn("_m", F.when(F.col("_hot"), month(F.col(date))).otherwise(0)).drop("_hot")
    span = fact.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("s")).scalar()
    first = F.greatest(month(F.coalesce("valid_from", span["lo"])), month(span["lo"]))
    last = F.least(month(F.coalesce("valid_to", span["hi"])), month(span["hi"]))
    months = F.when(F.col("_hot"), F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(0)))
    version = marked(dim).withColumn("_v", F.explode(months)).drop("_hot").withColumnsRenamed({k: f"_d_{k}" for k in on})
    keys = reduce(lambda a, b: a & b, [rows[k] == version[f"_d_{k}"] for k in on])
    during = (version["valid_from"].isNull() | (rows[date] >= version["valid_from"])) & (version["valid_to"].isNull() | (rows[date] <= version["valid_to"]))
    return rows.join(version, keys & (rows["_m"] == version["_v"]) & during, how).drop("_m", "_v", *[f"_d_{k}" for k in on])


#: A cell is parted in so many strips each way, so many times at most; one of so few sites is not parted.
STRIPS, DEPTH, LEAF = 8, 6, 16


def _site_cells(spot: DataFrame, group: str, level: int) -> DataFrame:
    """Summary of the cells of a level: number of sites, the box they lie in, and one of them."""
    shrink = STRIPS ** (DEPTH - level)
    return spot.groupBy(group, F.floor(F.col("_sr") / shrink).alias("_r"), F.floor(F.col("_sc") / shrink).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_slat").alias("_south"), F.max("_slat").alias("_north"), F.min("_x").alias("_west"), F.max("_x").alias("_east"),
        F.min(F.struct("_slat", "_slon")).alias("_one"))


def nearest_within(points: DataFrame, sites: DataFrame, group: str, radius_km: float, point_id: str = "point",
                   site_id: str = "site", lat: str = "lat", lon: str = "lon", compared: Observation | None = None, leaf: int = LEAF) -> DataFrame:
    """Nearest site of the same group within a radius, for each point; of equally near ones the smallest.

    Points first meet summaries of the grid cells that their circle can touch. A cell that must be farther away than one site that is
    known goes; one of many sites is parted into smaller cells, whose summaries are met in the same way. Only the sites of the few
    cells left are compared, so a dense cell is never met whole. Equal positions are matched once and sites at one position are
    reduced to one. ``compared`` receives ``n_pairs``, the number of (position, site) pairs whose distance was taken at the end.
    """
    cell = max(radius_km / 111.0, 1e-6)
    fine = cell / STRIPS ** DEPTH
    place = points.groupBy(group, lat, lon).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    spot = sites.groupBy(group, F.col(lat).alias("_slat"), F.col(lon).alias("_slon")).agg(F.min(site_id).alias(site_id))
    # Longitudes one lap away, so that circles across the date line find their sites.
    spot = spot.withColumn("_x", F.explode(F.array(*[F.col("_slon") + lap for lap in (-360.0, 0.0, 360.0)])))
    spot = stored(spot.withColumns({"_sr": F.floor(F.col("_slat") / fine).cast("long"), "_sc": F.floor(F.col("_x") / fine).cast("long")}), "sites")
    # A degree of longitude shrinks with the cosine of the latitude at the circle's far edge.
    edge = F.least(F.abs(F.col(lat)) + cell * 1.01, F.lit(89.9))
    reach = F.least(F.lit(360.0), F.lit(cell * 1.01) / F.cos(F.radians(edge)))
    strips = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    near = place.select(group, lat, lon, reach.alias("_reach"), F.explode(strips(F.col(lat) - cell * 1.01, F.col(lat) + cell * 1.01)).alias("_r"))
    near = near.withColumn("_c", F.explode(strips(F.col(lon) - F.col("_reach"), F.col(lon) + F.col("_reach")))).drop("_reach")

    gap = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    half = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2), 2)
    narrow = F.least(F.cos(F.radians("_south")), F.cos(F.radians("_north")))
    least = half(gap(F.col(lat), F.col("_south"), F.col("_north"))) + F.cos(F.radians(lat)) * F.greatest(narrow, F.lit(0.0)) * half(
        F.least(gap(F.col(lon), F.col("_west"), F.col("_east")), F.lit(180.0)))
    bounds = {"_least": 2 * 6371.0 * F.asin(F.sqrt(F.least(least, F.lit(1.0)))) * (1 - 1e-9) - 1e-9,
              "_known": haversine_km(F.col(lat), F.col(lon), F.col("_one._slat"), F.col("_one._slon"))}
    best = F.min("_known").over(Window.partitionBy(group, lat, lon))
    kept = [group, lat, lon, "_level", "_r", "_c", "_n", "_least", "_known"]

    def pruned(cells):
        fit = cells.withColumn("_best", best).filter(F.col("_least") <= F.least(F.col("_best") + 1e-9, F.lit(radius_km)))
        return stored(fit.select(*kept), "cells")

    cells = near.join(_site_cells(spot, group, 0), [group, "_r", "_c"]).withColumns(bounds).withColumn("_level", F.lit(0))
    cells, level = pruned(cells), 0
    while level < DEPTH and not cells.filter((F.col("_level") == level) & (F.col("_n") > leaf)).isEmpty():
        wide = (F.col("_level") == level) & (F.col("_n") > leaf)
        parent = cells.filter(wide).select(group, lat, lon, F.col("_r").alias("_pr"), F.col("_c").alias("_pc"))
        child = _site_cells(spot, group, level + 1).withColumns({"_pr": F.floor(F.col("_r") / STRIPS), "_pc": F.floor(F.col("_c") / STRIPS)})
        level += 1
        inner = parent.join(child, [group, "_pr", "_pc"]).withColumns(bounds).withColumn("_level", F.lit(level)).select(*kept)
        cells = pruned(cells.filter(~wide).unionByName(inner))
    parts = []
    for k in range(level + 1):
        shrink = STRIPS ** (DEPTH - k)
        keyed = spot.select(group, site_id, "_slat", "_slon", F.floor(F.col("_sr") / shrink).alias("_r"), F.floor(F.col("_sc") / shrink).alias("_c"))
        parts.append(cells.filter(F.col("_level") == k).select(group, lat, lon, "_r", "_c").join(keyed, [group, "_r", "_c"]))
    pairs = reduce(lambda a, b: a.unionByName(b), parts).withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), F.col("_slat"), F.col("_slon")))
    if compared is not None:
        pairs = pairs.observe(compared, F.count(F.lit(1)).alias("n_pairs"))
    found = pairs.filter(F.col("distance_km") <= radius_km).groupBy(group, lat, lon).agg(F.min(F.struct("distance_km", site_id)).alias("_best"))
    found = found.select(group, lat, lon, f"_best.{site_id}", "_best.distance_km")
    return points.join(found, [group, lat, lon], "inner").select(point_id, group, site_id, "distance_km")


def entity_else_group(base: DataFrame, side: DataFrame, group_side: DataFrame, entity: list[str], group: list[str],
                      value: str) -> DataFrame:
    """Value of the entity, else of its group."""
    own = side.select(*entity, F.col(value).alias("_own"))
    shared = group_side.select(*group, F.col(value).alias("_shared"))
    out = base.join(own, entity, "left").join(shared, group, "left")
    return out.withColumn(value, F.coalesce("_own", "_shared")).drop("_own", "_shared")


def proxy_fill(df: DataFrame, cols: list[str], proxies: DataFrame, key: str, time: str) -> DataFrame:
    """Fill NULLs with the mean of the mapped peers in the same period. ``proxies``: (key, proxy)."""
    means = df.groupBy(key, time).agg(*[F.avg(c).alias(c) for c in cols])
    peers = (
        proxies.join(means.withColumnRenamed(key, "proxy"), "proxy")
        .groupBy(key, time).agg(*[F.avg(c).alias(f"_p_{c}") for c in cols])
    )
    out = df.join(peers, [key, time], "left")
    return out.withColumns({c: F.coalesce(c, f"_p_{c}") for c in cols}).drop(*[f"_p_{c}" for c in cols])


def with_group_stat(df: DataFrame, keys: list[str], stats: dict) -> DataFrame:
    """Attach group aggregates to rows: combined before the shuffle, then joined."""
    sums = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return df.join(sums, keys, "left")


def history_view(fact: DataFrame, dim_a: DataFrame, on_a: list[str], dim_b: DataFrame, on_b: list[str]) -> DataFrame:
    """Fact rows with an entity and every version of a second dimension."""
    return fact.join(dim_a, on_a).join(dim_b, on_b)
