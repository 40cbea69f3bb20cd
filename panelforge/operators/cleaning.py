"""Projection, filtering and cleaning of raw tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.scalars import col, guarded_log


def rename_typed(df: DataFrame, mapping: dict[str, str], null_cols: dict[str, str] | None = None) -> DataFrame:
    """Rename columns and add typed NULLs for those a source does not deliver."""
    out = df.withColumnsRenamed(mapping)
    gaps = {c: F.lit(None).cast(t) for c, t in (null_cols or {}).items() if c not in out.columns}
    return out.withColumns(gaps) if gaps else out


def std_cols(df: DataFrame) -> DataFrame:
    """Lower-case, underscored names; repeats get ``__dupN``."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = re.sub(r" ", "_", raw.strip().lower())
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}__dup{count}" if count else name)
    return df.toDF(*names)


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def audit(df: DataFrame, source: str, file: str | None = None) -> DataFrame:
    """Load date, source and file. Without ``file`` the scanned file's own path is kept."""
    return df.withColumns({
        "_ingestion_date": F.current_date(),
        "_source_system": F.lit(source),
        "_file_name": F.lit(file) if file else F.input_file_name(),
    })


def keep_matching_if_any(df: DataFrame, c: str, pattern: str) -> DataFrame:
    """Case-insensitive contains filter that is skipped when it would leave nothing."""
    hit = F.coalesce(F.contains(F.lower(F.col(c)), F.lit(pattern.lower())), F.lit(False))
    some = df.agg(F.max(hit).alias("m")).scalar()
    return df.filter(hit | ~F.coalesce(some, F.lit(False)))


def value_flags(df: DataFrame, value: str, dataset: str, rules=fv.DATASET_RANGES, above_zero=fv.DATASETS_ABOVE_ZERO) -> DataFrame:
    """Missing and out-of-range flags by the dataset each row belongs to."""
    lows = {k: lo for k, (lo, _) in rules.items() if lo is not None}
    highs = {k: hi for k, (_, hi) in rules.items() if hi is not None}

    def bound(limits):
        pairs = [x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.try_element_at(F.create_map(*pairs), F.col(dataset))

    outside = (F.col(value) < bound(lows)) | (F.col(value) > bound(highs)) | (F.col(dataset).isin(list(above_zero)) & (F.col(value) <= 0))
    return df.withColumns({
        "value_is_na": F.col(value).isNull(),
        "value_out_of_range": F.coalesce(outside, F.lit(False)),
    })


def range_flags(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``<col>_out_of_range`` 0/1, NULL for a NULL value."""
    return df.withColumns({
        f"{c}_out_of_range": ((F.col(c) < lo) | (F.col(c) > hi)).cast("int") for c, (lo, hi) in limits.items()
    })


def dedupe(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Distinct rows, or the first row per key in ``order``.

    The first row is an aggregate over structs, combined before the shuffle, so a hot key sends one row per task
    (Spark sorts each task's rows by key to aggregate structs).
    """
    if not keys:
        return df.dropDuplicates()
    if not order:
        raise ValueError("deduplication on a key needs an order to be repeatable")
    return _extreme_row(df, keys, order, F.min_by)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key; later columns of ``order`` break ties."""
    return _extreme_row(df, keys, order, F.max_by)


def _extreme_row(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    row = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return row.select(*keys, "_row.*").select(*df.columns)


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with the number of rows a step removed."""
    n0 = before.agg(F.count(F.lit(1)).alias("rows_before"))
    n1 = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    return n0.withColumn("rows_after", n1).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def pick_column(columns: list[str], candidates: list[str] = (), keywords: list[str] = ()) -> str | None:
    """First candidate present, else the first column whose name holds a keyword."""
    by_lower = {c.lower(): c for c in columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    return next((c for c in columns if any(k.lower() in c.lower() for k in keywords)), None)


def harmonise_headers(df: DataFrame, rules: dict[str, list[list[str]]]) -> DataFrame:
    """Rename headers by keywords: a rule holds alternatives, each a set of words all present."""
    taken, mapping = set(), {}
    for target, alternatives in rules.items():
        for c in df.columns:
            words = c.lower()
            if c not in taken and any(all(w in words for w in alt) for alt in alternatives):
                mapping[c] = target
                taken.add(c)
                break
    return df.withColumnsRenamed(mapping)


def code_shares(df: DataFrame, regex: str = "^[A-Z]{2}$") -> DataFrame:
    """Share of non-NULL values per string column that look like a code, in one pass."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    shares = df.agg(*[F.avg(F.col(c).rlike(regex).cast("double")).alias(c) for c in texts])
    return shares.unpivot([], texts, "column", "share")


def detect_code_column(df: DataFrame, regex: str = "^[A-Z]{2}$", min_share: float = 0.4) -> DataFrame:
    """One row: the column with the largest share of codes, if it reaches ``min_share``."""
    s = code_shares(df, regex).filter(F.col("share") >= min_share)
    return s.agg(F.max_by("column", F.struct("share", "column")).alias("column"), F.max("share").alias("share"))


def lookup_frame(like: DataFrame, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    """Literal dictionary as a table; its size is known to the planner."""
    from ..sources.readers import lookup

    return lookup(like.sparkSession, list(mapping.items()), f"{key} string, {value} string")


def map_codes(df: DataFrame, c: str, lookup: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a mapped code, and the unmapped codes with their row counts."""
    side = lookup.select(F.col(key).alias(c), F.col(value))
    unmapped = df.groupBy(c).agg(F.count(F.lit(1)).alias("n_rows")).join(side, c, "left_anti")
    return df.join(side, c, "inner"), unmapped


def map_code(c, mapping: dict[str, str]) -> Column:
    """Dictionary lookup as an expression, for mappings of a few entries."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col(c))


def keep_codes(df: DataFrame, values: dict[str, list], contains: dict[str, str] | None = None) -> DataFrame:
    for c, allowed in values.items():
        df = df.filter(F.col(c).isin(list(allowed)))
    for c, part in (contains or {}).items():
        df = df.filter(F.contains(F.upper(F.col(c)), F.lit(part.upper())))
    return df


def keep_sectors(df: DataFrame, c: str, values=fv.TARGET_INDUSTRIES) -> DataFrame:
    return df.filter(F.col(c).isin(list(values)))


def log_features(df: DataFrame, c: str, prefix: str = "ln_") -> DataFrame:
    ln = guarded_log(c)
    return df.withColumns({f"{prefix}{c}": ln, f"{prefix}{c}_sq": ln * ln})


def indicators(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: F.coalesce(rule, F.lit(False)).cast("int") for name, rule in rules.items()})


SERIES_SCHEMA = "array<struct<Nombre:string,Data:array<struct<Anyo:int,FK_Periodo:string,T:string,NombrePeriodo:string,Valor:double>>>>"


def explode_series(df: DataFrame, json_col: str, code_map=fv.QUARTER_CODES, schema: str = SERIES_SCHEMA) -> DataFrame:
    """Nested JSON series to rows (indicator, period, value)."""
    keep = [c for c in df.columns if c != json_col]
    series = df.select(*keep, F.explode(F.from_json(F.col(json_col), schema)).alias("s"))
    points = series.select(*keep, F.coalesce("s.Nombre", F.lit("Sin nombre")).alias("indicator"), F.explode("s.Data").alias("d"))
    label = F.concat(F.col("d.Anyo").cast("string"), map_code("d.FK_Periodo", code_map))
    period = F.coalesce(label, F.col("d.T"), F.col("d.NombrePeriodo"))
    return points.select(*keep, "indicator", period.alias("period"), F.col("d.Valor").alias("value"))
