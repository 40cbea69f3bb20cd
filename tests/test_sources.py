"""Readers, sinks, ingest jobs, incremental loads."""

import os

import pytest
from pyspark.sql import functions as F

from panelforge.sources import ingest as jobs
from panelforge.sources import readers, writers
from panelforge.streaming.incremental import append_new, pending


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_binds_by_name_in_any_order(spark, tmp_path):
    p = put(f"{tmp_path}/a.csv", "City,PM10_Mean,AQ_Source,PM25_Mean\nX_ES,20.5,EEA,10.5\n")
    r = readers.read_csv(spark, p, "City string, PM25_Mean double, PM10_Mean double, AQ_Source string, Absent int").first()
    assert tuple(r) == ("X_ES", 10.5, 20.5, "EEA", None)


def test_malformed_rows(spark, tmp_path):
    p = put(f"{tmp_path}/a.csv", "k,v\n1,2.5\n2,bad\n3,\n")
    kept = readers.read_csv(spark, p, "k int, v double", unreadable="bad").orderBy("k").collect()
    assert [tuple(r) for r in kept] == [(1, 2.5, []), (2, None, ["v"]), (3, None, [])]
    assert sorted(r["k"] for r in readers.read_csv(spark, p, "k int, v double", "DROPMALFORMED").collect()) == [1, 3]


def test_required_columns_of_long_statistics(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_sdmx_csv(spark, put(f"{tmp_path}/a.csv", "REF_AREA,OBS_VALUE\nES,1\n"))


def test_missing_table_is_none(spark, tmp_path):
    assert readers.read_table(spark, f"{tmp_path}/nope") is None
    assert readers.read_table(spark, "no_such_table") is None


def test_overwrite_replaces_only_its_partitions_and_registers(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.write_parquet(spark.createDataFrame([(1, 2000), (2, 2001)], "v int, year int"), path, ["year"])
    writers.write_parquet(spark.createDataFrame([(9, 2001)], "v int, year int"), path, ["year"])
    writers.register(spark, "panel_t", path)
    writers.write_parquet(spark.createDataFrame([(5, 2002)], "v int, year int"), path, ["year"], "append")
    writers.register(spark, "panel_t", path)
    assert sorted(map(tuple, spark.table("panel_t").select("v", "year").collect())) == [(1, 2000), (5, 2002), (9, 2001)]
    spark.sql("DROP TABLE panel_t")


def test_csv_is_one_file_where_asked(spark, tmp_path):
    df = spark.range(1000, numPartitions=4)
    writers.write_csv(df, f"{tmp_path}/a", single=True)
    assert len([f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".csv")]) == 1
    writers.write_csv(df, f"{tmp_path}/b")
    assert spark.read.option("header", True).csv(f"{tmp_path}/b").count() == 1000


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).select(F.col("id").cast("int").alias("K"), (F.col("id") * 2.0).alias("V"))
    try:
        writers.write_jdbc(df, url, "T", "overwrite", properties=driver)
    except Exception as e:
        if "ClassNotFound" in str(e):
            pytest.skip("no embedded database driver in this Spark")
        raise
    back = readers.read_jdbc(spark, url, "T", "K", 0, 100, 4, driver)
    assert back.rdd.getNumPartitions() == 4
    assert back.agg(F.count("*"), F.sum("V")).first() == df.agg(F.count("*"), F.sum("V")).first()


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_a_repeated_task_adds_nothing(spark, tmp_path):
    """A task of the staging write fails after its rows are in the database; its repeat writes them again."""
    url = f"jdbc:derby:{tmp_path}/once;create=true"
    df = spark.range(500, numPartitions=4).select(F.col("id").alias("K"), (F.col("id") % 7).cast("double").alias("V"))
    plain = writers.stored
    assert writers.load_jdbc(df, url, "T", "r1", properties=DERBY) == 500
    # What a repeat leaves behind: the rows of some tasks stand twice in the stage.
    def twice(frame, name):
        rows = plain(frame, name)
        again = rows.withColumns({"LOAD_RUN": F.lit("r2"), "LOAD_ROW": F.monotonically_increasing_id()}).filter("K % 4 = 1")
        spark.read.format("jdbc").options(url=url, dbtable="T_STAGED", **DERBY).load()
        twice.rows = again
        return rows

    number = writers._number

    def late(connection, sql):
        if sql.startswith("SELECT COUNT(*) FROM (SELECT DISTINCT"):  # after the tasks wrote, before the rows are counted
            twice.rows.write.format("jdbc").options(url=url, dbtable="T_STAGED", **DERBY).mode("append").save()
        return number(connection, sql)

    writers.stored, writers._number = twice, late
    try:
        assert writers.load_jdbc(df.withColumn("K", F.col("K") + 1000), url, "T", "r2", properties=DERBY) == 500
    finally:
        writers.stored, writers._number = plain, number
    back = readers.read_jdbc(spark, url, "T", properties=DERBY)
    assert back.count() == back.distinct().count() == 1000
    assert writers.load_jdbc(df, url, "T", "r2", properties=DERBY) == 0
    assert readers.read_jdbc(spark, url, "T_STAGED", properties=DERBY).count() == 0
    assert writers.load_jdbc(df.limit(0), url, "T", "empty", properties=DERBY) == 0


def test_even_parts_of_uneven_keys(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/even;create=true"
    df = spark.range(800).select(F.when(F.col("id") < 790, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("K"), F.col("id").alias("V"))
    df = df.unionByName(spark.createDataFrame([(None, -1)], "K long, V long"))
    writers.write_jdbc(df, url, "T", properties=DERBY)
    back = readers.read_jdbc_evenly(spark, url, "T", "K", 4, DERBY)
    sizes = [r["n"] for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 801 and max(sizes) < 230
    assert back.filter("K IS NULL").count() == 1


@pytest.mark.parametrize("name", list(jobs.SOURCES))
def test_every_ingest_job(spark, tmp_path, name):
    source = jobs.SOURCES[name]
    fields = [f.strip().split() for f in source.schema.split(",")]
    cell = {"string": "Madrid_ES", "int": "2019", "double": "1.5", "long": "7"}
    good = ["ES" if n in ("Country", "Country_Code", "FUA_Country_Code") else "3" if n == "Month" else cell[t] for n, t in fields]
    # Reversed column order, one row without its keys, one row with an unreadable year.
    keyless = ["" for _ in fields]
    broken = ["x" if n == "Year" else g for (n, _), g in zip(fields, good)]
    text = "\n".join(",".join(reversed(r)) for r in ([n for n, _ in fields], good, keyless, broken))
    df = jobs.ingest(spark, name, put(f"{tmp_path}/raw/{name}.csv", text + "\n"), f"{tmp_path}/{name}")
    row = df.first().asDict()
    assert df.count() == 1 and row["year"] == 2019 and row["_source_system"] == source.system and row["_file_name"] == f"{name}.csv"
    for part in source.parts:
        assert str(row[part]) == {"year": "2019"}.get(part, "ES")


def test_one_broken_source_does_not_stop_the_others(spark, tmp_path):
    good = put(f"{tmp_path}/c.csv", "Year,Month,ETS_Price_EUR,ETS_Source\n2020,1,25.0,X\n")
    status = jobs.ingest_all(spark, {"gdp": f"{tmp_path}/missing.csv", "carbon_price": good}, f"{tmp_path}/out")
    assert status["carbon_price"] == "ok" and status["gdp"].startswith("failed")


def test_append_keeps_stored_rows_and_resumes(spark):
    stored = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 2.0)], "k string, year int, v double")
    new = spark.createDataFrame([("a", 1999, 9.0), ("a", 2001, 9.0), ("a", 2002, 3.0)], "k string, year int, v double")
    once = append_new(stored, new, ["k", "year"])
    assert sorted(map(tuple, once.collect())) == [("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2002, 3.0)]
    assert sorted(map(tuple, append_new(stored.limit(0), new, ["k", "year"]).collect())) == sorted(map(tuple, new.collect()))
    assert sorted(map(tuple, append_new(once, new, ["k", "year"]).collect())) == sorted(map(tuple, once.collect()))


def test_pending_retries_empty_values(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    assert sorted(r[0] for r in pending(keys, done, ["k"]).collect()) == [3]
    assert sorted(r[0] for r in pending(keys, done, ["k"], "v").collect()) == [2, 3]
