"""Incremental loads: resume points, pending keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.cleaning import dedupe


def append_new(stored: DataFrame, new: DataFrame, keys: list[str], time: list[str] = ("year",)) -> DataFrame:
    """Stored rows plus rows from the last stored period on; a stored row wins over a repeated key."""
    resume = stored.agg(F.max(F.struct(*time)).alias("m")).scalar()
    fresh = new.filter(resume.isNull() | (F.struct(*time) >= resume))
    both = stored.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys and c != "_p"]
    return dedupe(both, list(keys), ["_p", *others]).drop("_p")


def pending(keys: DataFrame, done: DataFrame, on: list[str], retry_missing: str | None = None) -> DataFrame:
    """Keys not done yet; with ``retry_missing``, done rows without that value count as not done."""
    finished = done.filter(F.col(retry_missing).isNotNull()) if retry_missing else done
    return keys.join(finished.select(*on), on, "left_anti")
