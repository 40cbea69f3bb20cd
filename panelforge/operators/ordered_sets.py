"""Sorting, top-k, latest period, set operations and seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def order(df: DataFrame, keys: list) -> DataFrame:
    return df.orderBy(*keys)


def order_nulls_last(df: DataFrame, c: str, ties: list[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(c), *ties)


def top_k(df: DataFrame, keys: list, k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def top_k_of(df: DataFrame, keys: list[str], agg: Column, k: int, largest: bool = True, out: str = "value") -> DataFrame:
    grouped = df.groupBy(*keys).agg(agg.alias(out))
    by = F.desc_nulls_last(out) if largest else F.asc_nulls_last(out)
    return top_k(grouped, [by, *keys], k)


def arg_extreme(df: DataFrame, by: str, ret: list[str], tie: list[str], keys: list[str] = ()) -> DataFrame:
    """Row of the largest and of the smallest value; equal values are settled by ``tie``."""
    known = df.filter(F.col(by).isNotNull())
    ext = known.groupBy(*keys).agg(
        F.max_by(F.struct(*ret, by), F.struct(by, *tie)).alias("hi"),
        F.min_by(F.struct(*ret, by), F.struct(by, *tie)).alias("lo"),
    )
    names = [*ret, by]
    return ext.select(*keys, *[F.col(f"hi.{n}").alias(f"max_{n}") for n in names],
                      *[F.col(f"lo.{n}").alias(f"min_{n}") for n in names])


def last_period(df: DataFrame, *time: str) -> DataFrame:
    """Rows of the table's latest period, by an uncorrelated scalar subquery."""
    newest = df.agg(F.max(F.struct(*time)).alias("m")).scalar()
    return df.filter(reduce(lambda a, b: a & b, [F.col(t) == newest[t] for t in time]))


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample: the ``n`` rows with the smallest MD5 of seed and key, written out with colons between them."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return df.orderBy(F.md5(named.cast("binary")), *key).limit(n)
