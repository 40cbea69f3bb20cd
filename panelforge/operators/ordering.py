"""Ranks, row numbers and exact quantiles that never sort a whole group in one task.

A plain window ranks a group inside one task, so a month holding every entity, or one hot
entity, ends up on one core. Here a group is cut at hash-sampled split values: each
(group, bucket) is ranked on its own and shifted by the size of the buckets before it.
Equal values are counted before the shuffle, so ties cost one row. The sample only
chooses cut points; every row is ranked, and the result is exact for any cut points. Groups of
every size are cut alike; the number of cuts follows the shuffle partitions of the session.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CUTS_PER_PARTITION = 4  # cut values over all groups together, per shuffle partition


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def value_positions(df: DataFrame, keys: list[str], value: Column | str, descending: bool = False,
                    cuts_wanted: int | None = None) -> DataFrame:
    """Distinct values ``_v`` per group with their count ``_n`` and the rows ``_before`` them.

    ``cuts_wanted`` is the expected number of cut values at most, ``CUTS_PER_PARTITION`` per shuffle partition by default. Cuts are
    searched coarsely, then within one step of about the square root of their number.
    """
    wanted = cuts_wanted or CUTS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(2, math.isqrt(wanted))
    x = F.col(value) if isinstance(value, str) else value
    groups = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_g0")]
    g = [f"_g{i}" for i in range(len(groups))]
    counted = (
        df.select(*groups, x.alias("_v")).filter(F.col("_v").isNotNull())
        .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    # One cut per `stride` distinct values on average, so a hot value takes no cuts from the others. Reading `_n` in every
    # branch keeps the branches on one and the same shuffle of `counted`, which Spark then runs once.
    stride = counted.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.least("_n", F.lit(1))) / wanted)).alias("s")).scalar()
    drawn = F.when(F.pmod(F.xxhash64(*g, "_v"), stride) == 0, F.col("_v"))
    # About ``wanted`` cut values exist over all groups, whatever the data size.
    listed = F.sort_array(F.collect_list(drawn)).alias("_cuts")
    if keys:
        cuts = (
            counted.groupBy(*g).agg(listed, F.sum("_n").alias("_rows"))
            .filter((F.size("_cuts") > 0) & (F.col("_rows") > 0))
        )
        cuts = F.broadcast(cuts.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(g)], "_cuts"))
        joined = counted.join(cuts, same(counted, cuts, [(k, f"_c{i}") for i, k in enumerate(g)]), "left")
    else:
        packed = counted.agg(listed, F.sum("_n").alias("_rows")).select(
            F.when((F.size("_cuts") > 0) & (F.col("_rows") > 0), F.col("_cuts")))
        joined = counted.withColumn("_cuts", packed.scalar())
    joined = joined.withColumn("_cut", F.col("_cuts").isNotNull())
    smaller = lambda c: c < F.col("_v")
    every = F.transform(
        F.sequence(F.lit(step - 1), F.size("_cuts") - 1, F.lit(step)), lambda i: F.get("_cuts", i)
    )
    coarse = F.when(F.size("_cuts") >= step, F.size(F.filter(every, smaller))).otherwise(0)
    joined = joined.withColumn("_k", F.when(F.col("_cut"), coarse).otherwise(0))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_k") * step + 1, F.lit(step)), smaller))
    bucketed = joined.select(
        *g, "_v", "_n", "_cut", F.when(F.col("_cut"), F.col("_k") * step + fine).otherwise(0).alias("_b")
    )
    bucket = F.col("_b").desc() if descending else F.col("_b")
    earlier = Window.partitionBy(*g).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        bucketed.groupBy(*g, "_b", "_cut").agg(F.sum("_n").alias("_t")).filter("_cut")
        .withColumn("_shift", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(g)], F.col("_b").alias("_sb"), "_shift")
    )
    shift = F.broadcast(shift)  # one row per cut value, bounded as above
    direction = F.col("_v").desc() if descending else F.col("_v")
    inside = Window.partitionBy(*g, "_b").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    pairs = [(k, f"_s{i}") for i, k in enumerate(g)] + [("_b", "_sb")]
    return ranked.join(shift, same(ranked, shift, pairs), "left").select(
        *g, "_v", "_n", (F.col("_in") + F.coalesce("_shift", F.lit(0))).alias("_before")
    )


def with_positions(df: DataFrame, keys: list[str], value: str, descending: bool = False,
                   source: DataFrame | None = None) -> DataFrame:
    """Rows with ``_n`` and ``_before`` of their own value; NULL for a NULL value.

    ``source`` may hold the same keys and values in a table that is cheaper to read than ``df``.
    """
    pos = value_positions(df if source is None else source, keys, value, descending)
    base = df if keys else df.withColumn("_all", F.lit(0))
    pairs = [(k, f"_g{i}") for i, k in enumerate(keys or ["_all"])] + [(value, "_v")]
    drop = [y for _, y in pairs] + ([] if keys else ["_all"])
    return base.join(pos, same(base, pos, pairs), "left").drop(*drop)


def rank_in(df: DataFrame, partition: list[str], measure: str, out: str = "rank",
            source: DataFrame | None = None) -> DataFrame:
    """Rank with gaps, best value first."""
    placed = with_positions(df, partition, measure, True, source)
    return placed.withColumn(out, (F.col("_before") + 1).cast("int")).drop("_n", "_before")


def average_rank(df: DataFrame, value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Ascending rank in which ties share the mean of their places; ``source`` as in ``with_positions``."""
    placed = with_positions(df, [], value, source=source)
    return placed.withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")


def number_rows(df: DataFrame, order: list[str], start: int | Column = 1, out: str = "sk") -> DataFrame:
    """Consecutive numbers in the order of columns that are unique together."""
    keyed = df.withColumn("_order", F.struct(*order))
    first = start if isinstance(start, Column) else F.lit(start)
    placed = with_positions(keyed, [], "_order")
    return placed.withColumn(out, (F.col("_before") + first).cast("long")).drop("_order", "_n", "_before")


def long_values(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot([F.col(k) for k in keys], cols, "column", "value")


def quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles: (keys, column, prob, value), any group size."""
    keys = list(keys or [])
    group = keys + ["column"]
    flat = long_values(df, cols, keys)
    pos = value_positions(flat, group, "value")
    g = [f"_g{i}" for i in range(len(group))]
    total = pos.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(g)]).agg(F.sum("_n").alias("_total"))
    rows = pos.join(total, same(pos, total, [(k, f"_t{i}") for i, k in enumerate(g)]))
    rows = rows.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    at = (F.col("_total") - 1) * F.col("_p")
    lo, hi = F.floor(at), F.ceil(at)

    def covers(i):
        return (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))

    picked = rows.filter(covers(lo) | covers(hi)).groupBy(*g, "_p").agg(
        F.max(F.when(covers(lo), F.col("_v"))).alias("_lo"),
        F.max(F.when(covers(hi), F.col("_v"))).alias("_hi"),
        F.max(at - lo).alias("_f"),
    )
    return picked.select(
        *[F.col(k).alias(name) for k, name in zip(g, group)], F.col("_p").alias("prob"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"),
    )


def quantile_columns(df: DataFrame, col: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row per group with one column per named quantile of ``col``."""
    q = quantiles(df, [col], sorted(set(probs.values())), keys)
    picks = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in probs.items()]
    return q.groupBy(*(keys or [])).agg(*picks)


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]):
    """Scalar struct ``{column: {name: value}}`` over the whole table, usable in any expression."""
    q = quantiles(df, cols, sorted(set(probs.values())))
    fields = [
        F.struct(*[
            F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value"))).alias(n)
            for n, p in probs.items()
        ]).alias(c)
        for c in cols
    ]
    return q.agg(F.struct(*fields).alias("s")).scalar()
