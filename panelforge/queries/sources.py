"""Scans, sinks and incremental loads. Files are written from the whole tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest as jobs
from ..operators.ordered_sets import stack
from ..sources import readers, writers
from ..streaming.incremental import append_new, pending
from .registry import ctes, query

ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"
ORDER_COLS = "o_orderkey:l o_custkey:l o_totalprice:d4 o_orderpriority:s"


def _orders(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def database(t, name: str) -> str:
    """Spark's embedded database in a folder of its own; it is reached from the driver's process alone."""
    return f"jdbc:derby:{t.scratch(name).removeprefix('file://').removeprefix('file:')};create=true"


@query("jdbc_round_trip", "S8 S10", ORDER_COLS, ORDERS)
def _(t):
    """Written once though the load runs twice, read back in parts of even size."""
    url = database(t, "orders")
    for _ in range(2):
        writers.load_jdbc(_orders(t), url, "ORDERS_COPY", "first load", properties=DERBY, types="o_orderpriority VARCHAR(40)")
    return readers.read_jdbc_evenly(t.spark, url, "ORDERS_COPY", "o_orderkey", 8, DERBY).toDF("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("jdbc_replace", "S10", "o_orderkey:l o_totalprice:d4", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def _(t):
    """A second run takes the place of the first in one transaction."""
    url = database(t, "replaced")
    rows = _orders(t).select("o_orderkey", "o_totalprice")
    writers.load_jdbc(rows, url, "ORDERS_COPY", "all", properties=DERBY)
    writers.load_jdbc(rows.filter("o_orderkey % 3 = 0"), url, "ORDERS_COPY", "thirds", replace=True, properties=DERBY)
    return readers.read_jdbc(t.spark, url, "ORDERS_COPY", properties=DERBY).toDF("o_orderkey", "o_totalprice")


@query("scan_typed_csv", "S1", ORDER_COLS, ORDERS)
def _(t):
    path = t.scratch("csv")
    _orders(t).write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, "o_orderpriority string, o_totalprice double, o_orderkey long, o_custkey long", "DROPMALFORMED")


@query("scan_typed_csv_permissive", "S1", "o_orderkey:l o_totalprice:d4 priority_code:i n_bad:i", """
    SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS priority_code,
           CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS n_bad FROM orders""")
def _(t):
    path = t.scratch("csv")
    code = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1")).otherwise(F.col("o_orderpriority"))
    _orders(t).withColumn("priority_code", code).write.option("header", True).csv(path)
    df = readers.read_csv(t.spark, path, "o_orderkey long, o_totalprice double, priority_code int", "PERMISSIVE", unreadable="bad")
    return df.withColumn("n_bad", F.size("bad"))


@query("scan_raw_text", "S2 P2", "order_key:l total:d4", "SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders")
def _(t):
    path = t.scratch("csv")
    _orders(t).select(F.col("o_orderkey").alias(" Order Key"), F.col("o_totalprice").alias("TOTAL")).write.option("header", True).csv(path)
    return readers.read_raw(t.spark, path)


@query("scan_gzipped_tsv", "S3", "o_orderkey:l o_totalprice:d4", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    path = t.scratch("tsv")
    _orders(t).write.options(header=True, sep="\t", compression="gzip").csv(path)
    return readers.read_tsv(t.spark, path)


@query("scan_long_statistics", "S4", "ref_area:s year:i value:d4", ctes("annual", "SELECT country AS ref_area, year, gdp AS value FROM annual"))
def _(t):
    path = t.scratch("sdmx")
    t.annual().select(F.col("country").alias("REF_AREA"), F.col("year").alias("TIME_PERIOD"), F.col("gdp").alias("OBS_VALUE"),
                      F.lit("x").alias("OBS_STATUS")).write.option("header", True).csv(path)
    return readers.read_sdmx_csv(t.spark, path)


@query("scan_many_files", "S5", "key:l name:s balance:d4", """
    SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier
    UNION ALL SELECT c_custkey, c_name, NULL FROM customer UNION ALL SELECT p_partkey, p_name, NULL FROM part""")
def _(t):
    a, b, c = (t.scratch("csv") for _ in range(3))
    t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).write.option("header", True).csv(a)
    t("customer").select(F.col("c_name").alias("Name"), F.col("c_custkey").alias("Key")).write.option("header", True).csv(b)
    t("part").select(F.col("p_name").alias("Name"), F.col("p_partkey").alias("Key")).write.option("header", True).csv(c)
    return readers.read_many(t.spark, [a, b, c])


@query("scan_parquet_with_key", "S6", "station:s n_rows:l total:d4", """
    SELECT event_type AS station, count(*) AS n_rows, sum(value) AS total FROM events GROUP BY 1""")
def _(t):
    path = t.scratch("stations")
    t("events").select("event_type", "value").write.partitionBy("event_type").parquet(path)
    df = readers.read_parquet_with_key(t.spark, path, "station", r"event_type=([^/]+)/")
    return df.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"))


@query("scan_optional_table", "S7", "source:s n_rows:l", """
    SELECT 'orders' AS source, count(*) AS n_rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer""")
def _(t):
    found = {n: readers.read_table(t.spark, f"{t.folder}/{n}.parquet") for n in ("orders", "no_such_table", "customer")}
    present = [df.agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n_rows")) for n, df in found.items() if df is not None]
    return stack(present)


@query("sink_partitioned_parquet", "S9", "o_orderkey:l year:i o_totalprice:d4", """
    SELECT o_orderkey, year(o_orderdate) AS year, o_totalprice FROM orders""")
def _(t):
    path = t.scratch("orders")
    writers.write_parquet(t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice"), path, ["year"])
    return t.spark.read.parquet(path)


@query("register_partitions", "S12", "year:i n_rows:l", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_rows FROM orders GROUP BY 1")
def _(t):
    path = t.scratch("orders")
    writers.write_parquet(t("orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path, ["year"])
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    writers.register(t.spark, name, path)
    return t.spark.table(name).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query("sink_single_csv", "S11", "country:s year:i gdp:d4", ctes("annual", "SELECT country, year, gdp FROM annual"))
def _(t):
    path = t.scratch("export")
    writers.write_csv(t.annual().select("country", "year", "gdp"), path, single=True)
    return readers.read_csv(t.spark, path, "country string, year int, gdp double")


@query("sink_typed_with_null_columns", "S13", "entity:l year:i score:d4 note:s", ctes("panel", """
    SELECT DISTINCT entity, year, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS note FROM panel"""))
def _(t):
    path = t.scratch("typed")
    df = t.panel().select("entity", "year", F.lit(None).alias("score")).distinct()
    writers.write_typed(df, "entity long, year int, score double, note string", path)
    return t.spark.read.parquet(path)


@query("lookup_literal_table", "S14", "s_suppkey:l zone:s", """
    SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS zone FROM supplier WHERE s_nationkey IN (1, 2)""")
def _(t):
    zones = readers.lookup(t.spark, [(1, "west"), (2, "east")], "s_nationkey int, zone string")
    return t("supplier").join(zones, "s_nationkey")


@query("incremental_append", "S15", "entity:l year:i month:i veg:d8 origin:s", ctes("panel", """
    SELECT entity, year, month, veg, CASE WHEN year <= 1999 THEN 'stored' ELSE 'new' END AS origin FROM panel"""))
def _(t):
    p = t.panel().select("entity", "year", "month", "veg")
    stored = p.filter("year <= 1999").withColumn("origin", F.lit("stored"))
    return append_new(stored, p.withColumn("origin", F.lit("new")), ["entity", "year", "month"], ["year"])


@query("pending_keys", "S16", "entity:l year:i month:i", ctes("holed", "SELECT entity, year, month FROM holed WHERE veg IS NULL OR year > 2000"))
def _(t):
    done = t.holed().filter("year <= 2000")
    return pending(t.panel().select("entity", "year", "month"), done, ["entity", "year", "month"], retry_missing="veg")


INGEST_CITY = """SELECT city_code AS city, year, month, {measures} FROM panel JOIN cities ON entity = city_sk"""


def _raw(t, columns):
    p = t.panel().join(t.cities(), F.col("entity") == F.col("city_sk"))
    return p.select(F.col("city_code").alias("City"), F.col("country_code").alias("Country"), F.col("year").alias("Year"),
                    F.col("month").alias("Month"), *[F.col(c).alias(n) for n, c in columns.items()])


def _annual_raw(t, columns):
    p = _raw(t, {c: c for c in set(columns.values())})
    return p.groupBy("City", "Country", "Year").agg(*[F.round(F.avg(c), 9).alias(n) for n, c in columns.items()])


# Which panel measure plays each measure of an ingest job: (raw column, stored column, measure).
BOUND = {
    "vegetation": ("month", [("NDVI_Mean", "ndvi_mean", "veg")]),
    "no2": ("month", [("NO2_Mean", "no2_mean", "pol")]),
    "sealing": ("year", [("Imperviousness_Mean", "imperviousness_mean", "seal")]),
    "gdp": ("year", [("GDP_Per_Capita", "gdp_value", "price")]),
    "climate": ("month", [("Temp_Mean_C", "temp_mean_c", "seal"), ("Precip_Total_m", "precip_total_m", "pol")]),
    "aerosol": ("month", [("UVAI_Mean", "uvai_mean", "pol")]),
    "land_cover": ("year", [("Tree_Pct", "wc_tree_pct", "seal"), ("Built_Pct", "wc_built_pct", "pol")]),
    "emissions": ("year", [("CO2_kt", "co2_kt", "price")]),
    "policy": ("year", [("EPS_Index", "eps_index", "veg"), ("Env_Tax_USD", "env_tax_usd", "price")]),
    "green_investment": ("year", [("InvestEU_Total_EUR", "investeu_total_eur", "price")]),
    "old_vegetation": ("month", [("NDVI_Mean", "ndvi_mean", "veg")]),
    "surface_temperature": ("month", [("LST_Day_C", "lst_day_c", "seal"), ("LST_Night_C", "lst_night_c", "pol")]),
    "night_lights": ("month", [("NTL_Mean", "ntl_mean", "price")]),
    "tourism": ("month", [("Tourism_Nights", "tourism_nights", "price")]),
    "air_quality": ("month", [("PM25_Mean", "pm25_mean", "seal"), ("PM10_Mean", "pm10_mean", "price")]),
    "population": ("year", [("Population", "population", "price")]),
}


def _register_ingest(name):
    grain, measures = BOUND[name]
    source = jobs.SOURCES[name]
    entity = source.entity
    time = ["year"] + (["month"] if grain == "month" else [])
    whole = name == "population"
    kinds = " ".join(f"{stored}:{'l' if whole else 'd6'}" for _, stored, _ in measures)
    value = (lambda m: f"CAST(floor(round(avg({m}), 9)) AS BIGINT)") if whole else (lambda m: f"round(avg({m}), 9)")
    picks = ", ".join(f"{value(m)} AS {stored}" for _, stored, m in measures)
    country = "country_code" if "country_code" in source.parts else "country"
    keys = ", ".join(time)
    sql = ctes("panel cities", f"SELECT city_code AS {entity}, country_code AS {country}, {keys}, '{source.system}' AS _source_system, {picks} "
               f"FROM panel JOIN cities ON entity = city_sk GROUP BY city_code, country_code, {keys}")

    @query(f"ingest_{name}", f"ingest:{name} S1 P1 P3 P4 P5 A20 S9", f"{entity}:s {country}:s {' '.join(f'{k}:i' for k in time)} _source_system:s {kinds}", sql)
    def _(t):
        raw = _raw(t, {n: m for n, _, m in measures}) if grain == "month" else _annual_raw(t, {n: m for n, _, m in measures})
        if whole:
            raw = raw.withColumn("Population", F.floor("Population"))
        if country == "country_code":
            raw = raw.withColumnRenamed("Country", "Country_Code")
        path = t.scratch("raw")
        raw.write.option("header", True).csv(path)
        return jobs.ingest(t.spark, name, path, t.scratch(name))


for _name in BOUND:
    _register_ingest(_name)


@query("ingest_market", "ingest:market", "ticker:s country_code:s year:i month:i close_price:d6 monthly_volatility:d8", ctes("market", """
    SELECT ticker, country_code, year, month, close_price, monthly_volatility FROM market"""))
def _(t):
    path = t.scratch("raw")
    t.market().select(F.col("ticker").alias("Ticker"), F.col("country_code").alias("FUA_Country_Code"), F.col("year").alias("Year"),
                      F.col("month").alias("Month"), F.col("close_price").alias("Close_Price"),
                      F.col("monthly_volatility").alias("Monthly_Volatility")).write.option("header", True).csv(path)
    return jobs.ingest(t.spark, "market", path, t.scratch("market"))


@query("ingest_renewables", "ingest:renewables", "country:s year:i renewables_pct:d6", ctes("annual", "SELECT country, year, gdp / 10000 AS renewables_pct FROM annual"))
def _(t):
    path = t.scratch("raw")
    t.annual().select(F.col("country").alias("Country"), F.col("year").alias("Year"), (F.col("gdp") / 10000).alias("Renewables_Pct")).write.option("header", True).csv(path)
    return jobs.ingest(t.spark, "renewables", path, t.scratch("renewables"))


@query("ingest_carbon_price", "ingest:carbon_price", "year:i month:i ets_price_eur:d6", ctes("panel", """
    SELECT year, month, avg(price) AS ets_price_eur FROM panel GROUP BY 1, 2"""))
def _(t):
    path = t.scratch("raw")
    t.panel().groupBy(F.col("year").alias("Year"), F.col("month").alias("Month")).agg(F.avg("price").alias("ETS_Price_EUR")).write.option("header", True).csv(path)
    return jobs.ingest(t.spark, "carbon_price", path, t.scratch("carbon"))
