"""Projection, filtering and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as fn
from ..operators import cleaning as op
from ..operators.ordered_sets import stack
from .registry import ctes, query

# Dirty text made from orders, the same on both sides.
DIRTY = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN ':' WHEN 1 THEN CAST(o_custkey AS VARCHAR) || ' p'
    WHEN 2 THEN '1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.5' ELSE '-' || o_custkey || '.25 e' END AS txt FROM orders"""


def dirty(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    txt = (
        F.when(k % 4 == 0, ":").when(k % 4 == 1, F.concat(c, F.lit(" p")))
        .when(k % 4 == 2, F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(".5")))
        .otherwise(F.concat(F.lit("-"), c, F.lit(".25 e")))
    )
    return t("orders").select(k.alias("k"), txt.alias("txt"))


@query("rename_with_typed_placeholders", "P1", "city:s key:l lat:d4 lon:d4", """
    SELECT s_name AS city, s_suppkey AS key, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon FROM supplier""")
def _(t):
    return op.rename_typed(t("supplier"), {"s_name": "city", "s_suppkey": "key"}, {"lat": "double", "lon": "double"})


@query("standard_column_names", "P2", "s_name:s s_name__dup1:s", "SELECT s_name, s_name AS s_name__dup1 FROM supplier")
def _(t):
    return op.std_cols(t("supplier").select(F.col("s_name").alias(" S Name"), F.col("s_name").alias("s_NAME")))


@query("key_token_country", "P3", "city_code:s country:s first:s", ctes("cities", """
    SELECT city_code, split_part(city_code, '_', 2) AS country, split_part(city_code, '_', 1) AS first FROM cities"""))
def _(t):
    return t.cities().select("city_code", fn.key_token("city_code").alias("country"), fn.key_token("city_code", pos=1).alias("first"))


@query("required_keys", "P4", "entity:l year:i month:i", ctes("holed", "SELECT entity, year, month FROM holed WHERE veg IS NOT NULL AND pol IS NOT NULL"))
def _(t):
    return op.require(t.holed(), ["veg", "pol"])


@query("audit_columns", "P5", "s_suppkey:l _source_system:s _file_name:s has_date:b", """
    SELECT s_suppkey, 'ERP' AS _source_system, 'supplier.csv' AS _file_name, true AS has_date FROM supplier""")
def _(t):
    return op.audit(t("supplier"), "ERP", "supplier.csv").withColumn("has_date", F.col("_ingestion_date").isNotNull())


@query("integer_from_text", "P6", "k:l v:i", f"SELECT k, TRY_CAST(regexp_extract(txt, '(\\d+)', 1) AS INTEGER) AS v FROM ({DIRTY})")
def _(t):
    return dirty(t).select("k", fn.to_int("txt").alias("v"))


@query("number_with_flags", "P7", "k:l v:d4", f"SELECT k, TRY_CAST(regexp_replace(txt, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS v FROM ({DIRTY})")
def _(t):
    return dirty(t).select("k", fn.to_number("txt").alias("v"))


@query("number_first_token", "P7", "k:l v:d4", f"SELECT k, TRY_CAST(split_part(txt, ' ', 1) AS DOUBLE) AS v FROM ({DIRTY})")
def _(t):
    return dirty(t).select("k", fn.leading_number("txt").alias("v"))


@query("amount_with_separators", "P8", "k:l v:d4", f"SELECT k, coalesce(TRY_CAST(replace(txt, ',', '') AS DOUBLE), 0) AS v FROM ({DIRTY})")
def _(t):
    return dirty(t).select("k", fn.to_amount("txt").alias("v"))


@query("decimal_comma", "P9", "k:l v:d4", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders")
def _(t):
    text = F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"\.", ",")
    return t("orders").select(F.col("o_orderkey").alias("k"), fn.decimal_comma(text).alias("v"))


@query("strip_notes", "P10", "k:l label:s", "SELECT o_orderkey AS k, o_orderpriority AS label FROM orders")
def _(t):
    noted = F.concat(F.lit("(1) "), F.col("o_orderpriority"), F.lit(" (a)(b)"))
    return t("orders").select(F.col("o_orderkey").alias("k"), fn.strip_notes(noted).alias("label"))


@query("contains_filter_if_any", "P11", "filter:s p_partkey:l", """
    SELECT 'hit' AS filter, p_partkey FROM part WHERE p_type ILIKE '%promo%' UNION ALL SELECT 'none', p_partkey FROM part""")
def _(t):
    hit = op.keep_matching_if_any(t("part"), "p_type", "Promo").withColumn("filter", F.lit("hit"))
    return stack([hit, op.keep_matching_if_any(t("part"), "p_type", "nowhere").withColumn("filter", F.lit("none"))])


@query("code_normalisation", "P12", "k:l code:s", "SELECT c_custkey AS k, upper(trim(' ' || lower(c_mktsegment) || '  ')) AS code FROM customer")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k"), fn.norm_code(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  "))).alias("code"))


@query("value_flags", "P13", "k:l value_is_na:b value_out_of_range:b", """
    SELECT p_partkey AS k, value IS NULL AS value_is_na, coalesce(CASE ds WHEN 'poverty_rate' THEN value < 0 OR value > 100
        WHEN 'population_density' THEN value < 0 WHEN 'household_size' THEN value <= 0 END, false) AS value_out_of_range
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'poverty_rate' WHEN 1 THEN 'population_density' WHEN 2 THEN 'household_size' ELSE 'other' END AS ds,
        CASE WHEN p_size % 10 <> 0 THEN CASE WHEN p_size > 45 THEN 0 ELSE p_retailprice / 10 - p_size END END AS value FROM part)""")
def _(t):
    k = F.col("p_partkey")
    df = t("part").select(
        k.alias("k"), F.when(k % 4 == 0, "poverty_rate").when(k % 4 == 1, "population_density").when(k % 4 == 2, "household_size").otherwise("other").alias("ds"),
        F.when(F.col("p_size") % 10 != 0, F.when(F.col("p_size") > 45, 0.0).otherwise(F.col("p_retailprice") / 10 - F.col("p_size"))).alias("value"))
    return op.value_flags(df, "value", "ds")


@query("range_flags", "P14", "entity:l year:i month:i veg_out_of_range:i seal_out_of_range:i", ctes("holed", """
    SELECT entity, year, month, CAST(veg < 0.04 OR veg > 0.06 AS INTEGER) AS veg_out_of_range,
           CAST(seal < 20 OR seal > 30 AS INTEGER) AS seal_out_of_range FROM holed"""))
def _(t):
    return op.range_flags(t.holed(), {"veg": (0.04, 0.06), "seal": (20, 30)})


@query("deduplicate_rows", "P15", "o_custkey:l o_orderpriority:s", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def _(t):
    return op.dedupe(t("orders").select("o_custkey", "o_orderpriority"))


@query("deduplicate_on_key", "P15", "o_custkey:l o_orderkey:l o_totalprice:d4", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def _(t):
    return op.dedupe(t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("deduplicate_count", "P15", "rows_before:l rows_after:l rows_removed:l", """
    SELECT count(*) AS rows_before, count(DISTINCT o_custkey) AS rows_after, count(*) - count(DISTINCT o_custkey) AS rows_removed FROM orders""")
def _(t):
    rows = t("orders").select("o_custkey", "o_orderkey")
    return op.removed_rows(rows, op.dedupe(rows, ["o_custkey"], ["o_orderkey"]))


@query("pick_column", "P16", "name:s amount:d4", "SELECT c_name AS name, c_acctbal AS amount FROM customer")
def _(t):
    c = t("customer")
    return c.select(F.col(op.pick_column(c.columns, ["name", "c_name"])).alias("name"), F.col(op.pick_column(c.columns, [], ["acct"])).alias("amount"))


@query("harmonise_headers", "P17", "borrower:s amount:d4", "SELECT c_name AS borrower, c_acctbal AS amount FROM customer")
def _(t):
    raw = t("customer").select(F.col("c_name").alias("Borrower Name (legal)"), F.col("c_acctbal").alias("Amount signed EUR"))
    return op.harmonise_headers(raw, {"borrower": [["borrower", "name"], ["beneficiary"]], "amount": [["amount", "eur"], ["volume"]]})


@query("detect_code_column", "P18", "column:s share:d6", "SELECT 'code' AS \"column\", avg(CAST(regexp_matches(code, '^[A-Z]{2}$') AS DOUBLE)) AS share "
       "FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'EU27' ELSE upper(substr(c_mktsegment, 1, 2)) END AS code FROM customer)")
def _(t):
    code = F.when(F.col("c_custkey") % 3 == 0, "EU27").otherwise(F.upper(F.substring("c_mktsegment", 1, 2)))
    return op.detect_code_column(t("customer").select("c_name", code.alias("code"), "c_acctbal"))


@query("non_finite_to_null", "P19", "k:l v:d4", """
    SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS v FROM part""")
def _(t):
    x = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).when(F.col("p_size") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return t("part").select(F.col("p_partkey").alias("k"), fn.finite_or_null(x).alias("v"))


_SEGMENTS = {"AUTOMOBILE": "AT", "BUILDING": "BE", "MACHINERY": "CY"}


@query("map_codes", "P20", "c_custkey:l code:s", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AT' WHEN 'BUILDING' THEN 'BE' ELSE 'CY' END AS code
    FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
def _(t):
    c = t("customer")
    return op.map_codes(c, "c_mktsegment", op.lookup_frame(c, _SEGMENTS, "name", "code"), "name", "code")[0]


@query("map_codes_unmapped", "P20", "c_mktsegment:s n_rows:l", """
    SELECT c_mktsegment, count(*) AS n_rows FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1""")
def _(t):
    c = t("customer")
    return op.map_codes(c, "c_mktsegment", op.lookup_frame(c, _SEGMENTS, "name", "code"), "name", "code")[1]


@query("map_codes_by_expression", "P20", "k:l code:s", """
    SELECT c_custkey AS k, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AT' WHEN 'BUILDING' THEN 'BE' WHEN 'MACHINERY' THEN 'CY' END AS code FROM customer""")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k"), op.map_code("c_mktsegment", _SEGMENTS).alias("code"))


@query("map_country_codes", "P20", "k:l by_code:s by_name:s", """
    SELECT c_custkey AS k, CASE c_nationkey % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' WHEN 2 THEN 'XK' END AS by_code,
        CASE c_nationkey % 4 WHEN 0 THEN 'EL' WHEN 1 THEN 'CZ' WHEN 2 THEN 'LT' END AS by_name FROM customer""")
def _(t):
    n = F.col("c_nationkey") % 4
    code = F.when(n == 0, "DEU").when(n == 1, "GBR").when(n == 2, "XKX").otherwise("USA")
    name = F.when(n == 0, "GREECE").when(n == 1, "CZECH REPUBLIC").when(n == 2, "LITHUANIA").otherwise("NARNIA")
    return t("customer").select(F.col("c_custkey").alias("k"), op.map_code(code, fv.ISO3_TO_ISO2).alias("by_code"), op.map_code(name, fv.COUNTRY_NAME_TO_CODE).alias("by_name"))


@query("resolve_year", "P21", "k:l year:i", """
    SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 2021 + o_orderkey % 10 WHEN 1 THEN 2000 + o_orderkey % 20 ELSE 2024 END AS year FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, F.format_string("/files/2019/%d-report-2031.pdf", 2021 + k % 10))
    date = F.when(k % 3 == 1, F.format_string(" %d-05-01", 2000 + k % 20)).otherwise("unknown")
    return t("orders").select(k.alias("k"), fn.resolve_year(url, date).alias("year"))


@query("parse_period", "P22", "k:l year:i month:i", """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate) END AS year, CASE WHEN o_orderkey % 4 < 3 THEN month(o_orderdate) END AS month FROM orders""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    label = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM")).when(k % 4 == 1, F.date_format(d, "yyyyMM")).when(
        k % 4 == 2, F.date_format(d, "yyyy-'M'MM")).otherwise(F.date_format(d, "yyyy"))
    year, month = fn.parse_period("label")
    return t("orders").select(k.alias("k"), label.alias("label")).select("k", year.alias("year"), month.alias("month"))


@query("parse_quarter", "P23", "k:l year:i quarter:i idx:i", """
    SELECT o_orderkey AS k, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, year(o_orderdate) * 10 + quarter(o_orderdate) AS idx FROM orders""")
def _(t):
    label = F.concat(F.lit(" "), F.year("o_orderdate"), F.lit("t"), F.quarter("o_orderdate"))
    y, q, i = fn.parse_quarter("label")
    return t("orders").select(F.col("o_orderkey").alias("k"), label.alias("label")).select("k", y.alias("year"), q.alias("quarter"), i.alias("idx"))


@query("parse_list", "P24", "k:l n:i joined:s", """
    SELECT p_partkey AS k, CASE p_size % 3 WHEN 2 THEN 0 ELSE 2 END AS n, CASE p_size % 3 WHEN 2 THEN '' ELSE p_brand || '|' || p_type END AS joined FROM part""")
def _(t):
    s, b, ty = F.col("p_size") % 3, F.col("p_brand"), F.col("p_type")
    text = F.when(s == 0, F.concat(F.lit("['"), b, F.lit("', '"), ty, F.lit("']"))).when(s == 1, F.concat(b, F.lit(" , "), ty)).otherwise("")
    df = t("part").select(F.col("p_partkey").alias("k"), fn.parse_list(text).alias("a"))
    return df.select("k", F.size("a").alias("n"), F.array_join("a", "|").alias("joined"))


@query("first_of_list", "P25", "k:l first:s", "SELECT p_partkey AS k, substr(p_brand, 1, 6) AS first FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), fn.first_token(F.concat(F.lit(" "), F.col("p_brand"), F.lit(",x,y")), 6).alias("first"))


@query("keep_codes", "P26", "o_orderkey:l", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND contains(upper(o_orderpriority), 'URGENT')")
def _(t):
    return op.keep_codes(t("orders"), {"o_orderstatus": ["O", "F"]}, {"o_orderpriority": "urgent"})


@query("log_features", "P27", "k:l ln_x:d8 ln_x_sq:d8 l1p:d8", """
    SELECT p_partkey AS k, CASE WHEN x > 0 THEN ln(x) END AS ln_x, CASE WHEN x > 0 THEN ln(x) * ln(x) END AS ln_x_sq,
           CASE WHEN x > 0 THEN ln(1 + x) END AS l1p FROM (SELECT p_partkey, CAST(p_size - 25 AS DOUBLE) AS x FROM part)""")
def _(t):
    df = t("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") - 25).cast("double").alias("x"))
    return op.log_features(df, "x").withColumn("l1p", fn.guarded_log1p("x"))


@query("safe_ratio", "P28", "k:l v:d8", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_retailprice / (p_size - 25) ELSE 0 END AS v FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), fn.safe_ratio("p_retailprice", F.greatest(F.col("p_size") - 25, F.lit(0))).alias("v"))


@query("unit_conversion", "P29", "k:l celsius:d6", "SELECT p_partkey AS k, p_retailprice * 0.02 - 273.15 AS celsius FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), fn.convert("p_retailprice", 0.02, -273.15).alias("celsius"))


@query("indicator_columns", "P30", "k:l is_q1:i is_promo:i price_is_na:i", """
    SELECT o_orderkey AS k, CAST(quarter(o_orderdate) = 1 AS INTEGER) AS is_q1, CAST(o_orderpriority LIKE '%URGENT%' AS INTEGER) AS is_promo,
           CAST(o_orderkey % 9 = 0 AS INTEGER) AS price_is_na FROM orders""")
def _(t):
    df = t("orders").withColumns({"k": F.col("o_orderkey"), "price": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))})
    return op.indicators(df, {"is_q1": F.quarter("o_orderdate") == 1, "is_promo": F.contains("o_orderpriority", F.lit("URGENT")), "price_is_na": F.col("price").isNull()})


@query("default_value", "P31", "k:l sector:s", "SELECT p_partkey AS k, CASE WHEN p_size % 4 <> 0 THEN p_type ELSE 'Unknown' END AS sector FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k"), fn.default(F.when(F.col("p_size") % 4 != 0, F.col("p_type")), "Unknown").alias("sector"))


@query("explode_series", "P32", "event_id:l indicator:s period:s value:d4", """
    SELECT event_id, event_type AS indicator, CASE WHEN k BETWEEN 19 AND 22 THEN '2024T' || (k - 18) ELSE 'P' || k END AS period, value
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k")
    point = F.struct(F.lit(2024).alias("Anyo"), k.alias("FK_Periodo"), F.concat(F.lit("P"), k).alias("T"), F.col("value").alias("Valor"))
    doc = F.to_json(F.array(F.struct(F.col("event_type").alias("Nombre"), F.array(point).alias("Data"))))
    return op.explode_series(t("events").select("event_id", doc.alias("doc")), "doc")


@query("keep_sectors", "P33", "p_partkey:l p_type:s", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def _(t):
    return op.keep_sectors(t("part"), "p_type", ["PROMO", "SMALL"])


@query("scalar_dates", "P22 I14 D10", "k:l d:date month_end:date ahead:date key:i week:i weekday:i", """
    SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, last_day(CAST(o_orderdate AS DATE)) AS month_end,
        CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS ahead, year(o_orderdate) * 100 + month(o_orderdate) AS key,
        weekofyear(o_orderdate) AS week, isodow(o_orderdate) AS weekday FROM orders""")
def _(t):
    d = F.to_date("o_orderdate")
    return t("orders").select(
        F.col("o_orderkey").alias("k"), d.alias("d"), F.last_day(d).alias("month_end"), F.add_months(d, 12).alias("ahead"),
        fn.date_key(F.year(d), F.month(d)).alias("key"), F.weekofyear(d).alias("week"), (F.weekday(d) + 1).alias("weekday"))
