"""Dimensions, slowly changing history and keyed upserts as set operations on immutable tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from .cleaning import dedupe, latest
from .ordering import number_rows, same


def _one_per_key(new: DataFrame, key: list[str], order: list[str] | None, pick) -> DataFrame:
    """One row per key by ``order``; without one, by the other columns' values, so that the choice is repeatable."""
    order = order or [c for c in new.columns if c not in key]
    return pick(new, key, order) if order else new.dropDuplicates(key)


def insert_absent(target: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows stay as they are; new keys are added, each once: of several new rows the first in ``order``.

    Columns of ``order`` that the target lacks only order.
    """
    one = _one_per_key(new, key, order, dedupe).drop(*[c for c in order or [] if c not in target.columns])
    return target.unionByName(one.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, new: DataFrame, key: list[str], update_cols: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert new keys, overwrite the listed columns of known keys, keep all others.

    Of several new rows of a key the last in ``order`` counts, for inserted and for overwritten columns.
    """
    new = _one_per_key(new, key, order, latest)
    side = new.withColumn("_new", F.lit(True)).select(
        *[F.col(k).alias(f"_k_{k}") for k in key], "_new", *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key])
    old = target.withColumn("_old", F.lit(True))
    joined = old.join(side, same(old, side, [(k, f"_k_{k}") for k in key]), "full")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return joined.select(*out)


def scd2_merge(dim: DataFrame, snapshot: DataFrame, key: str, tracked: list[str], as_of: str, sk: str = "sk",
               first_load: str = fv.FIRST_LOAD, always: bool = False, order: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Close changed versions the day before ``as_of`` and open new ones.

    A key without history opens at ``first_load``. Keys absent from the snapshot are left
    alone. A version opened on ``as_of`` itself is replaced in place, so a rerun on the same day
    gives the same table. Of several snapshot rows of a key the last in ``order`` counts; columns of ``order``
    that the dimension lacks only order. New surrogates go on from ``top``, by default the largest one of ``dim``.
    """
    snapshot = _one_per_key(snapshot, [key], order, latest).drop(*[c for c in order or [] if c not in dim.columns])
    attrs = [c for c in snapshot.columns if c != key]
    cols = [sk, key, *attrs, "valid_from", "valid_to", "is_current"]
    day, end = F.lit(as_of).cast("date"), F.lit(fv.OPEN_END).cast("date")
    history = dim.filter(~F.col("is_current")).select(*cols)
    known = history.select(F.col(key).alias("_h")).distinct()
    incoming = snapshot.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in attrs])
    incoming = incoming.join(known, incoming["_key"] == known["_h"], "left")
    pair = dim.filter("is_current").select(*cols).join(incoming, F.col(key) == F.col("_key"), "full")

    stored, arrived = F.col(sk).isNotNull(), F.col("_key").isNotNull()
    differs = F.lit(True) if always else reduce(
        lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in tracked])
    changed = stored & arrived & differs
    today = F.col("valid_from") == day

    def version(sk_, new: bool, start, stop, live):
        k = F.coalesce(F.col(key), F.col("_key"))
        values = [F.col(f"_n_{c}") if new else F.col(c) for c in attrs]
        return F.struct(*[v.alias(n) for v, n in zip([sk_, k, *values, start, stop, live], cols)])

    since = F.when(stored | F.col("_h").isNotNull(), day).otherwise(F.lit(first_load).cast("date"))
    none = F.lit(None).cast(dim.schema[sk].dataType)
    versions = F.array_compact(F.array(
        F.when(stored & ~changed, version(F.col(sk), False, F.col("valid_from"), F.col("valid_to"), F.col("is_current"))),
        F.when(changed & today, version(F.col(sk), True, F.col("valid_from"), end, F.lit(True))),
        F.when(changed & ~today, version(F.col(sk), False, F.col("valid_from"), F.date_sub(day, 1), F.lit(False))),
        F.when((changed & ~today) | ~stored, version(none, True, since, end, F.lit(True))),
    ))
    rows = pair.select(F.explode(versions).alias("v")).select("v.*")
    top = F.lit(top) if top is not None else dim.agg(F.coalesce(F.max(sk), F.lit(0)).cast("long").alias("m")).scalar()
    opened = number_rows(rows.filter(F.col(sk).isNull()).drop(sk), [key], top + 1, sk).select(*cols)
    return history.unionByName(rows.filter(F.col(sk).isNotNull())).unionByName(opened)


def scd2_reopen(dim: DataFrame, snapshot: DataFrame, key: str, as_of: str, sk: str = "sk", order: list[str] | None = None) -> DataFrame:
    """A new version for every key of the snapshot, whether or not anything changed."""
    return scd2_merge(dim, snapshot, key, [], as_of, sk, first_load=as_of, always=True, order=order)


def current(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current")


def to_surrogate(df: DataFrame, dim: DataFrame, key: str, sk: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the surrogate of their key, and one row counting those without."""
    side = dim.select(key, sk)
    dropped = df.join(side, key, "left_anti").agg(F.count(F.lit(1)).alias("n_dropped"))
    return df.join(side, key, "inner"), dropped


def update_from(fact: DataFrame, patch: DataFrame, on: list[str], exprs: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Recompute fact columns from a patch table where it has the row's key.

    Fact rows stay as many as they are: of several patch rows of a key the last in ``order`` counts.
    """
    side = _one_per_key(patch, on, order, latest).withColumn("_hit", F.lit(True))
    joined = fact.join(side, on, "left")
    new = [F.when(F.col("_hit"), e).otherwise(fact[c] if c in fact.columns else F.lit(None)).alias(c) for c, e in exprs.items()]
    return joined.select(*[fact[c] for c in fact.columns if c not in exprs and c not in on], *on, *new)


def spread_to_months(df: DataFrame, months: DataFrame, on: list[str]) -> DataFrame:
    """Give an entity-year result to each stored month of that year."""
    return months.join(df, on, "inner")


def placeholders(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns that later steps fill."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


def star_view(fact: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    return reduce(lambda f, d: f.join(d[0], d[1], "inner"), dims, fact)


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key holds."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
