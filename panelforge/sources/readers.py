"""Scans. Columns are bound by header name, never by position."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.cleaning import pick_column, std_cols
from ..operators.ordered_sets import stack


def as_schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path, schema: StructType | str, mode: str = "PERMISSIVE",
             unreadable: str | None = None, **options) -> DataFrame:
    """Typed CSV with header. A column the file lacks is NULL.

    PERMISSIVE keeps every row, with NULL for an unreadable cell; DROPMALFORMED drops rows with
    one. ``unreadable`` names a column that lists the columns that could not be read.
    """
    raw = spark.read.options(header=True, mode=mode, **options).csv(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    typed, bad = [], []
    for f in as_schema(schema).fields:
        source = by_name.get(f.name.lower())
        if source is None:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{source}`")
        value = text.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        bad.append(F.when((F.trim(text) != "") & value.isNull(), F.lit(f.name)))
    failed = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    if mode.upper() == "DROPMALFORMED":
        raw = raw.filter(F.size(failed) == 0)
    return raw.select(*typed, *([failed.alias(unreadable)] if unreadable else []))


def read_raw(spark: SparkSession, path) -> DataFrame:
    """All columns as text, with standardised names."""
    return std_cols(spark.read.options(header=True, inferSchema=False).csv(path))


def read_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated statistical file, plain or gzipped; header blanks are trimmed."""
    raw = spark.read.options(header=True, sep="\t", inferSchema=False).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def read_sdmx_csv(spark: SparkSession, path, value_col: str = "value") -> DataFrame:
    """(REF_AREA, year, value) of a long SDMX file; other columns are never read."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    names = {n: pick_column(raw.columns, [n]) for n in ("REF_AREA", "TIME_PERIOD", "OBS_VALUE")}
    absent = [n for n, c in names.items() if c is None]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    out = raw.select(
        F.col(names["REF_AREA"]).alias("ref_area"), F.col(names["TIME_PERIOD"]).try_cast("int").alias("year"),
        F.col(names["OBS_VALUE"]).try_cast("double").alias(value_col))
    return out.dropna()


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several CSV files as one table; columns are matched by name, missing ones are NULL.

    Files with one header are one scan, so the plan grows with the number of layouts, not of files.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        layouts.setdefault(tuple(spark.read.option("header", True).csv(p).columns), []).append(p)
    return stack([read_raw(spark, same) for same in layouts.values()])


def read_parquet_with_key(spark: SparkSession, folder: str, key: str = "key", pattern: str = r"([^/]+?)\.parquet$") -> DataFrame:
    """Parquet files whose name carries a key. File listing and the key stay in the scan."""
    df = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_table(spark: SparkSession, name: str) -> DataFrame | None:
    """Parquet path or catalog table; None if it does not exist. Other failures are raised."""
    try:
        return spark.read.parquet(name) if "/" in name else spark.table(name)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower=None, upper=None,
              partitions: int = 8, properties: dict | None = None) -> DataFrame:
    """JDBC table; with a partition column it is read in ``partitions`` range queries."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=10000, **(properties or {}))
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def quoter(spark: SparkSession, url: str):
    """How the database quotes a name."""
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return lambda name: dialect.quoteIdentifier(name)


def read_jdbc_evenly(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, properties: dict | None = None) -> DataFrame:
    """JDBC table in ``partitions`` queries of about as many rows each, however its keys lie.

    The bounds are quantiles of the column, which is read alone first; nulls go with the first query.
    """
    options, column = {"url": url, "fetchsize": 10000} | (properties or {}), quoter(spark, url)(column)
    keys = spark.read.format("jdbc").options(**options, query=f"SELECT {column} AS K FROM {table}").load()
    shares = [i / partitions for i in range(1, partitions)]
    cuts = sorted(set(keys.agg(F.percentile_approx("K", shares, 10_000)).first()[0] or [])) if shares else []
    text = lambda v: str(v) if isinstance(v, (int, float)) else f"'{v}'"
    edges = [None, *[text(c) for c in cuts], None]
    where = []
    for low, high in zip(edges, edges[1:]):
        parts = [f"{column} > {low}"] if low else []
        parts += [f"{column} <= {high}"] if high else []
        where.append(" AND ".join(parts) or "1 = 1")
    if cuts:
        where[0] = f"{where[0]} OR {column} IS NULL"
    return spark.read.jdbc(url, table, predicates=where, properties={"fetchsize": "10000"} | {k: str(v) for k, v in (properties or {}).items()})


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal lookup table. It goes through Arrow to become a local relation, whose exact size
    the planner knows, so it is broadcast without a hint exactly when it is small."""
    struct = as_schema(schema)
    columns = zip(*rows) if rows else [() for _ in struct]
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), struct)
