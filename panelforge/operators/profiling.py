"""Data profiling. Quantiles are exact and distributed, moments follow the sample-corrected forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordering import average_rank, column_quantiles, long_values, quantile_columns, quantiles


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max."""
    base = long_values(df, cols, []).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    wide = q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in named.items()])
    return base.join(wide, "column", "left")


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample-corrected skewness and excess kurtosis per column."""
    m = long_values(df, cols, []).groupBy("column").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("g"), F.kurtosis("value").alias("k"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return m.select("column", skew.alias("skewness"), kurt.alias("kurtosis"))


def missing(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Missing count and percent per column, over all rows or per group."""
    keys = [by] if by else []
    flags = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = flags.unpivot([*[F.col(k) for k in keys], F.col("_n")], cols, "column", "n_missing")
    return long.select(*keys, "column", "n_missing", (F.col("n_missing") / F.col("_n") * 100).alias("pct_missing"))


def coverage(df: DataFrame, entity: str, period: str, c: str, full: int = 12) -> DataFrame:
    """How many entity-periods hold k valid rows, and the share of all that hold ``full``."""
    per = df.groupBy(entity, period).agg(F.count(c).alias("months_present"))
    hist = per.groupBy("months_present").agg(F.count(F.lit(1)).alias("n_groups"))
    total = hist.agg(F.sum("n_groups").alias("t")).scalar()
    return hist.withColumns({
        "share": F.col("n_groups") / total, "is_complete": F.col("months_present") >= full})


def balance(df: DataFrame, entity: str, year: str, c: str) -> DataFrame:
    """Years with data per entity, and whether that is every year of the panel."""
    seen = df.filter(F.col(c).isNotNull()).select(entity, year).distinct()
    span = seen.agg(F.countDistinct(year).alias("n")).scalar()
    return seen.groupBy(entity).agg(F.count(F.lit(1)).alias("n_years")).withColumn("is_complete", F.col("n_years") == span)


def seasonality(df: DataFrame, month: str, c: str) -> DataFrame:
    return df.groupBy(month).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))


def yearly(df: DataFrame, year: str, c: str) -> DataFrame:
    base = df.groupBy(year).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    return base.join(quantile_columns(df, c, {"median": 0.5}, [year]), year, "left")


def _products(width: int):
    """Rows of shifted values (NaN where unknown) to (i, j, n, sums, squares, products) of every two columns, added up within a task."""

    def run(batches):
        total = np.zeros((6, width, width))
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            known = (~np.isnan(x)).astype(float)
            v = np.where(known > 0, x, 0.0)
            s, q = v.T @ known, (v * v).T @ known
            total += [known.T @ known, s, s.T, q, q.T, v.T @ v]
        i, j = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j]) for m in total]],
                                         ["i", "j", "n", "sa", "sb", "qa", "qb", "p"])

    return run


def correlations(df: DataFrame, cols: list[str], min_abs: float = 0.1) -> DataFrame:
    """Pearson for every pair of columns over the rows that know both, kept from ``min_abs`` on.

    Each task multiplies its rows' matrix with itself and Spark adds the tasks' products, so the number of columns is no number of
    expressions. Values are shifted by their means first; a pair without spread has no coefficient.
    """
    numbers = [F.col(c).cast("double") for c in cols]
    means = df.agg(F.array(*[F.coalesce(F.avg(F.nanvl(c, F.lit(None).cast("double"))), F.lit(0.0)) for c in numbers]).alias("m")).first()["m"]
    rows = df.select(F.array(*[F.coalesce(c - F.lit(m), F.lit(float("nan"))) for c, m in zip(numbers, means)]).alias("x"))
    shape = "i int, j int, n double, sa double, sb double, qa double, qb double, p double"
    sums = rows.mapInArrow(_products(len(cols)), shape).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    spread = (F.col("qa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("qb") - F.col("sb") * F.col("sb") / F.col("n"))
    r = F.when((F.col("n") > 0) & (spread > 0), (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread))
    labels = F.array(*[F.lit(c) for c in cols])
    out = sums.select(F.get(labels, F.col("i")).alias("a"), F.get(labels, F.col("j")).alias("b"), r.alias("pearson"))
    return out.filter(F.abs("pearson") >= min_abs)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are known."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_rank(average_rank(both, a, "_ra"), b, "_rb", source=both)
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def trend_line(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"))


def tails(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip to two quantiles and flag what lay outside."""
    q = column_quantiles(df, cols, {"lo": lo, "hi": hi})
    out = {}
    for c in cols:
        out[f"{c}_outside"] = ((F.col(c) < q[c]["lo"]) | (F.col(c) > q[c]["hi"])).cast("int")
        out[f"{c}_clipped"] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), q[c]["lo"]), q[c]["hi"]))
    return df.withColumns(out)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n_rows"))


def group_shares(df: DataFrame, group: str, category: str) -> DataFrame:
    """Rows per category and their percent of the group."""
    cell = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n_rows"))
    total = cell.groupBy(group).agg(F.sum("n_rows").alias("_t"))
    return cell.join(total, group).select(group, category, "n_rows", (F.col("n_rows") / F.col("_t") * 100).alias("pct"))


def composition(df: DataFrame, group: str, cols: list[str], limit: float = 100.0) -> DataFrame:
    """Mean of each part per group, and the rows whose parts sum above ``limit``."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols], F.count_if(total > limit).alias("n_above"))


def spread(df: DataFrame, hi: str, lo: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(hi) - F.col(lo)).alias("mean_spread"), F.count(F.lit(1)).alias("n_rows"))


def vs_median(df: DataFrame, group: str, c: str, out: str = "above_median") -> DataFrame:
    med = quantile_columns(df, c, {"_median": 0.5}, [group])
    return df.join(med, group, "left").withColumn(out, F.col(c) > F.col("_median")).drop("_median")
