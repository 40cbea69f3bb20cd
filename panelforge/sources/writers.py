"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.storage import stored
from .readers import as_schema, quoter


def write_parquet(df: DataFrame, path: str, parts: list[str], mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Partitioned Parquet; an overwrite replaces only the partitions it holds.

    Rows are gathered by partition value before the write, so a folder gets few files, and the
    adaptive rebalance splits a folder that holds far more rows than others.
    """
    rows = df.hint("rebalance", *parts) if parts else df
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy(*parts).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 4, batch: int = 5000,
               properties: dict | None = None) -> None:
    """JDBC insert with a bounded number of connections."""
    df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=batch, numPartitions=connections, **(properties or {})).mode(mode).save()


def _statements(spark: SparkSession, url: str, properties: dict):
    """A connection of the driver's own, without automatic commits."""
    if "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"])
    info = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        info.setProperty(k, str(v))
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, info)
    connection.setAutoCommit(False)
    return connection


def _number(connection, sql: str) -> int:
    found = connection.createStatement().executeQuery(sql)
    found.next()
    return found.getLong(1)


def load_jdbc(df: DataFrame, url: str, table: str, run: str, replace: bool = False, connections: int = 4, batch: int = 5000,
              properties: dict | None = None, types: str | None = None) -> int:
    """Bring rows into a database table exactly once; returns how many rows this call added.

    Tasks write to ``<table>_STAGED``, each row under ``run`` and its own number, so a task that is repeated adds copies that are told
    apart. The driver then counts the distinct rows of the run and, in one transaction, moves them, notes the run in
    ``<table>_LOADS`` and clears the stage: a reader sees all of them or none. A run that is noted already adds nothing.
    ``replace`` empties the table in that transaction; ``types`` are column types where Spark's choice does not fit (the database must be
    able to compare the columns).
    """
    spark, given = df.sparkSession, properties or {}
    options = {"url": url, "batchsize": batch, "numPartitions": connections} | given
    quoted = quoter(spark, url)
    columns = ", ".join(quoted(c) for c in df.columns)
    # Stored first: a repeated task then reads the same rows in the same order.
    rows = stored(df, "load").withColumns({"LOAD_RUN": F.lit(run), "LOAD_ROW": F.monotonically_increasing_id()})
    kinds = ", ".join(x for x in (types, "LOAD_RUN VARCHAR(64)") if x)

    def put(frame, name, **more):
        frame.write.format("jdbc").options(**options, dbtable=name, **more).mode("append").save()

    put(df.limit(0), table, **({"createTableColumnTypes": types} if types else {}))
    put(spark.createDataFrame([], "LOAD_RUN string, LOAD_ROWS bigint"), f"{table}_LOADS", createTableColumnTypes="LOAD_RUN VARCHAR(64)")
    put(rows.limit(0), f"{table}_STAGED", createTableColumnTypes=kinds)
    connection = _statements(spark, url, given)
    name = run.replace("'", "''")
    try:
        noted = _number(connection, f"SELECT COUNT(*) FROM {table}_LOADS WHERE LOAD_RUN = '{name}'")
        connection.commit()
        if noted:
            return 0
        run_sql = lambda sql: connection.createStatement().executeUpdate(sql)
        run_sql(f"DELETE FROM {table}_STAGED WHERE LOAD_RUN = '{name}'")  # of a call that was cut off
        connection.commit()
        put(rows, f"{table}_STAGED")
        distinct = f"SELECT DISTINCT LOAD_ROW, {columns} FROM {table}_STAGED WHERE LOAD_RUN = '{name}'"
        want, have = rows.count(), _number(connection, f"SELECT COUNT(*) FROM ({distinct}) AS D")
        if want != have:
            raise ValueError(f"{have} of {want} rows are staged")
        if replace:
            run_sql(f"DELETE FROM {table}")
        run_sql(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM ({distinct}) AS D")
        run_sql(f"INSERT INTO {table}_LOADS (LOAD_RUN, LOAD_ROWS) VALUES ('{name}', {want})")
        run_sql(f"DELETE FROM {table}_STAGED WHERE LOAD_RUN = '{name}'")
        connection.commit()
        return want
    finally:
        connection.rollback()
        connection.close()


def write_csv(df: DataFrame, folder: str, single: bool = False) -> None:
    """CSV with header, as parallel part files or, where the caller asks for it, as one file for a desk tool.

    The shuffle before a single file keeps the upstream work parallel.
    """
    out = df.repartition(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(folder)


def register(spark: SparkSession, table: str, path: str) -> None:
    """Expose a Parquet folder as a table and pick up its partitions."""
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=path, source="parquet")
    if any(c.isPartition for c in spark.catalog.listColumns(table)):
        spark.catalog.recoverPartitions(table)


def typed(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of a schema; absent or untyped (all-NULL) ones become typed NULLs."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in as_schema(schema).fields])


def write_typed(df: DataFrame, schema, path: str, mode: str = "overwrite") -> None:
    typed(df, schema).write.mode(mode).parquet(path)
