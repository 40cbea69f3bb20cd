"""Dimensions, history and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensional as op
from ..operators.ordered_sets import stack
from .registry import ctes, query


def parts(t):
    return t("part").select(F.col("p_partkey").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"), F.col("p_size").alias("size"))


@query("insert_if_absent", "D1", "ticker:l sector:s", """
    SELECT p_partkey AS ticker, CASE WHEN p_type = 'PROMO' THEN 'kept' ELSE p_type END AS sector FROM part""")
def _(t):
    target = parts(t).filter("sector = 'PROMO'").select("ticker", F.lit("kept").alias("sector"))
    return op.insert_absent(target, parts(t).select("ticker", "sector"), ["ticker"])


@query("insert_if_absent_repeated_keys", "D1", "custkey:l day:date price:d2", """
    SELECT o_custkey AS custkey, CASE WHEN o_custkey % 3 = 0 THEN DATE '2030-01-01' ELSE arg_min(o_orderdate, (o_orderdate, o_orderkey)) END AS day,
        CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE arg_min(o_totalprice, (o_orderdate, o_orderkey)) END AS price FROM orders GROUP BY o_custkey""")
def _(t):
    new, key = customer_orders(t)
    target = new.filter("custkey % 3 = 0").select("custkey", F.lit("2030-01-01").cast("date").alias("day"), F.lit(0.0).alias("price")).distinct()
    return op.insert_absent(target, new, key, ["day", "orderkey"])


@query("upsert_repeated_keys", "D2", "custkey:l day:date price:d2", """
    SELECT o_custkey AS custkey, CASE WHEN o_custkey % 3 = 0 THEN DATE '2030-01-01' ELSE arg_max(o_orderdate, (o_orderdate, o_orderkey)) END AS day,
        arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY o_custkey""")
def _(t):
    new, key = customer_orders(t)
    target = new.filter("custkey % 3 = 0").select("custkey", F.lit("2030-01-01").cast("date").alias("day"), F.lit(0.0).alias("price")).distinct()
    return op.upsert(target, new, key, ["price"], ["day", "orderkey"])


@query("bulk_update_repeated_keys", "D7", "custkey:l price:d2", """
    SELECT c_custkey AS custkey, coalesce(o.price, c_acctbal) AS price
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1) AS o ON c_custkey = o_custkey""")
def _(t):
    new, key = customer_orders(t)
    fact = t("customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    patch = new.withColumnRenamed("price", "last")
    return op.update_from(fact.withColumn("price", F.col("balance")), patch, key, {"price": F.col("last")}, ["day", "orderkey"])


def customer_orders(t):
    """Many rows of a key, told apart by day and order."""
    return t("orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").cast("date").alias("day"),
                              F.col("o_totalprice").alias("price")), ["custkey"]


def upserted(t):
    p = t.panel()
    key = ["entity", "year", "month"]
    target = p.filter("year < 2000").select(*key, F.col("veg").alias("a"), F.col("pol").alias("b"), F.lit(1).alias("c"))
    new = p.filter("year > 1997").select(*key, F.col("seal").alias("a"), F.col("price").alias("b"), F.lit(2).alias("c"))
    return target, new, key


@query("upsert_partial_columns", "D2", "entity:l year:i month:i a:d8 b:d4 c:i", ctes("panel", """
    SELECT entity, year, month, CASE WHEN year > 1997 THEN seal ELSE veg END AS a, CASE WHEN year < 2000 THEN pol ELSE price END AS b,
        CASE WHEN year < 2000 THEN 1 ELSE 2 END AS c FROM panel"""))
def _(t):
    target, new, key = upserted(t)
    return op.upsert(target, new, key, ["a"])


@query("upsert_twice_is_once", "D2", "entity:l year:i month:i a:d8 b:d4", ctes("panel", """
    SELECT entity, year, month, CASE WHEN year > 1997 THEN seal ELSE veg END AS a, CASE WHEN year > 1997 THEN price ELSE pol END AS b FROM panel"""))
def _(t):
    target, new, key = upserted(t)
    return op.upsert(op.upsert(target, new, key, ["a", "b"]), new, key, ["a", "b"])


BUCKETS = 32
_BUCKET = "('0x' || substr(md5(CAST(entity AS VARCHAR) || '|' || year || '|' || month), 1, 8))::BIGINT % 32"


def bucketed(t):
    """A stored table of the early years, and what a day of late corrections and new months brings to few of its keys."""
    from ..operators.bucketed import BucketTable

    t.stage("panel")
    target, new, key = upserted(t)
    return BucketTable.create(target, t.scratch("bucketed"), key, BUCKETS), new.filter("year IN (1999, 2000) AND month = 7 AND entity % 5 = 0"), key


@query("upsert_rewrites_touched_buckets", "D2", "entity:l year:i month:i a:d8 b:d4 c:i", ctes("panel", """
    SELECT entity, year, month, CASE WHEN hit THEN seal ELSE veg END AS a, CASE WHEN year < 2000 THEN pol ELSE price END AS b, CASE WHEN year < 2000 THEN 1 ELSE 2 END AS c
    FROM (SELECT *, year IN (1999, 2000) AND month = 7 AND entity % 5 = 0 AS hit FROM panel) WHERE year < 2000 OR hit"""))
def _(t):
    table, new, _ = bucketed(t)
    table.upsert(new, ["a"])
    return table.read()


@query("upsert_bucket_report", "D2", "run:i n_rewritten:l n_buckets:l n_kept:l", ctes("panel", f"""
    SELECT run, CASE WHEN run = 1 THEN n ELSE 0 END AS n_rewritten, t AS n_buckets, CASE WHEN run = 1 THEN o ELSE t END AS n_kept FROM (
        SELECT count(DISTINCT b) FILTER (hit) AS n, (SELECT count(DISTINCT {_BUCKET}) FROM panel WHERE year < 2000 OR year = 2000 AND month = 7 AND entity % 5 = 0) AS t,
            (SELECT count(*) FROM (SELECT {_BUCKET} AS b FROM panel WHERE year < 2000 GROUP BY 1 HAVING NOT bool_or(year = 1999 AND month = 7 AND entity % 5 = 0)
                AND {_BUCKET} NOT IN (SELECT {_BUCKET} FROM panel WHERE year = 2000 AND month = 7 AND entity % 5 = 0))) AS o
        FROM (SELECT {_BUCKET} AS b, year IN (1999, 2000) AND month = 7 AND entity % 5 = 0 AS hit FROM panel)), (VALUES (1), (2)) AS r(run)"""))
def _(t):
    """Buckets rewritten by a run and by its repeat; kept are those whose folder stays the same."""
    table, new, _ = bucketed(t)
    rows = []
    for run in (1, 2):
        before = table.folders()
        rewritten = table.upsert(new, ["a"])
        after = table.folders()
        rows.append((run, len(rewritten), len(after), sum(before.get(b) == f for b, f in after.items())))
    return t.lookup(rows, "run int, n_rewritten long, n_buckets long, n_kept long")


def dimension(t):
    """A stored dimension: all but LARGE parts, with one closed version for SMALL ones."""
    p = parts(t).filter("sector <> 'LARGE'")
    now = p.select((F.col("ticker") * 2 + 1).alias("sk"), "ticker", "sector", "industry", F.lit("2010-01-01").cast("date").alias("valid_from"),
                   F.lit("9999-12-31").cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    was = p.filter("sector = 'SMALL'").select((F.col("ticker") * 2).alias("sk"), "ticker", "sector", F.lit("old").alias("industry"),
                                              F.lit("2006-01-01").cast("date").alias("valid_from"), F.lit("2009-12-31").cast("date").alias("valid_to"), F.lit(False).alias("is_current"))
    return now.unionByName(was)


def snapshot(t):
    """Today's companies: PROMO parts vanished, parts of size above 40 changed industry, LARGE ones are new."""
    moved = F.when(F.col("size") > 40, F.concat(F.col("industry"), F.lit("-x"))).otherwise(F.col("industry"))
    return parts(t).filter("sector <> 'PROMO'").select("ticker", "sector", moved.alias("industry"))


SCD = """p AS (SELECT p_partkey AS ticker, p_type AS sector, p_brand AS industry, p_size AS size FROM part),
    dim AS (SELECT ticker * 2 + 1 AS sk, ticker, sector, industry, DATE '2010-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current, size FROM p WHERE sector <> 'LARGE'
        UNION ALL SELECT ticker * 2, ticker, sector, 'old', DATE '2006-01-01', DATE '2009-12-31', false, size FROM p WHERE sector = 'SMALL'),
    opened AS (SELECT (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY ticker) AS sk, ticker, sector, CASE WHEN size > 40 THEN industry || '-x' ELSE industry END AS industry,
        CASE WHEN sector = 'LARGE' THEN {first} ELSE DATE '2024-05-01' END AS valid_from, DATE '9999-12-31' AS valid_to, true AS is_current FROM p
        WHERE sector <> 'PROMO' AND (sector = 'LARGE' OR {changed}))
    SELECT * FROM opened UNION ALL SELECT sk, ticker, sector, industry, valid_from, CASE WHEN is_current AND sector <> 'PROMO' AND {changed} THEN DATE '2024-04-30' ELSE valid_to END,
        is_current AND NOT (sector <> 'PROMO' AND {changed}) FROM dim"""
SCD_COLS = "sk:l ticker:l sector:s industry:s valid_from:date valid_to:date is_current:b"


@query("slowly_changing_merge", "D3", SCD_COLS, "WITH " + SCD.format(first="DATE '2006-01-01'", changed="size > 40"))
def _(t):
    return op.scd2_merge(dimension(t), snapshot(t), "ticker", ["sector", "industry"], "2024-05-01")


@query("slowly_changing_merge_rerun", "D3", SCD_COLS, "WITH " + SCD.format(first="DATE '2006-01-01'", changed="size > 40"))
def _(t):
    path = t.scratch("dim")  # a run reads the stored table and writes a new one
    op.scd2_merge(dimension(t), snapshot(t), "ticker", ["sector", "industry"], "2024-05-01").write.parquet(path)
    return op.scd2_merge(t.spark.read.parquet(path), snapshot(t), "ticker", ["sector", "industry"], "2024-05-01")


@query("slowly_changing_bucketed", "D3", SCD_COLS, "WITH " + SCD.format(first="DATE '2006-01-01'", changed="size > 40"))
def _(t):
    """The stored history, merged twice on one day: only buckets with a change are rewritten, the repeat rewrites none."""
    from ..operators.bucketed import BucketTable

    table = BucketTable.create(dimension(t), t.scratch("history"), ["ticker"], BUCKETS, "sk")
    table.merge_versions(snapshot(t), ["sector", "industry"], "2024-05-01")
    if table.merge_versions(snapshot(t), ["sector", "industry"], "2024-05-01"):
        raise AssertionError("a repeat rewrote buckets")
    return table.read()


@query("slowly_changing_reopen_bucketed", "D4", SCD_COLS, "WITH " + SCD.format(first="DATE '2024-05-01'", changed="true"))
def _(t):
    from ..operators.bucketed import BucketTable

    table = BucketTable.create(dimension(t), t.scratch("history"), ["ticker"], BUCKETS, "sk")
    table.merge_versions(snapshot(t), [], "2024-05-01", first_load="2024-05-01", always=True)
    return table.read()


@query("slowly_changing_reopen", "D4", SCD_COLS, "WITH " + SCD.format(first="DATE '2024-05-01'", changed="true"))
def _(t):
    return op.scd2_reopen(dimension(t), snapshot(t), "ticker", "2024-05-01")


@query("current_versions", "D5", "ticker:l industry:s", "SELECT p_partkey AS ticker, p_brand AS industry FROM part WHERE p_type <> 'LARGE'")
def _(t):
    return op.current(dimension(t))


def europe(t):
    return t.cities().filter("country_code IN ('N1', 'N2', 'N3', 'N4', 'N5', 'N6', 'N7', 'N8')").select(F.col("city_sk").alias("entity"), F.col("city_code").alias("sk"))


@query("surrogate_substitution", "D6", "entity:l year:i month:i sk:s", ctes("panel cities", """
    SELECT entity, year, month, city_code AS sk FROM panel JOIN cities ON entity = city_sk WHERE country_code IN ('N1', 'N2', 'N3', 'N4', 'N5', 'N6', 'N7', 'N8')"""))
def _(t):
    return op.to_surrogate(t.panel(), europe(t), "entity", "sk")[0]


@query("surrogate_unmatched_count", "D6", "n_dropped:l", ctes("panel cities", """
    SELECT count(*) AS n_dropped FROM panel JOIN cities ON entity = city_sk WHERE country_code NOT IN ('N1', 'N2', 'N3', 'N4', 'N5', 'N6', 'N7', 'N8')"""))
def _(t):
    return op.to_surrogate(t.panel(), europe(t), "entity", "sk")[1]


@query("bulk_update_by_group", "D7", "entity:l year:i month:i veg:d8 gap:d6", ctes("panel", """
    SELECT entity, year, month, CASE WHEN year IN (1996, 1999) THEN veg * 2 ELSE veg END AS veg, CASE WHEN year IN (1996, 1999) AND seal > 25 THEN seal - 25 END AS gap FROM panel"""))
def _(t):
    patch = t.lookup([(1996, 25.0), (1999, 25.0)], "year int, tp double")
    exprs = {"veg": F.col("veg") * 2, "gap": F.when(F.col("seal") > F.col("tp"), F.col("seal") - F.col("tp"))}
    return op.update_from(t.panel(), patch, ["year"], exprs)


@query("spread_result_to_months", "D8", "entity:l year:i month:i seal:d8", ctes("entity_year panel", "SELECT p.entity, p.year, p.month, e.seal FROM panel p JOIN entity_year e USING (entity, year)"))
def _(t):
    yearly = t.holed().groupBy("entity", "year").agg(F.avg("seal").alias("seal"))
    return op.spread_to_months(yearly, t.panel().select("entity", "year", "month"), ["entity", "year"])


@query("result_placeholders", "D9 D10", "entity:l date_sk:i phase:s confidence:d4", ctes("panel", "SELECT entity, year * 100 + month AS date_sk, 'PENDING' AS phase, CAST(NULL AS DOUBLE) AS confidence FROM panel"))
def _(t):
    from ..functions.scalars import date_key

    df = t.panel().withColumn("date_sk", date_key("year", "month"))
    return op.placeholders(df, {"phase": F.lit("PENDING"), "confidence": F.lit(None).cast("double"), "entity": F.lit(0)})


@query("star_detail_view", "D11", "entity:l city_code:s year:i month:i quarter:i veg:d8", ctes("panel cities", """
    SELECT entity, city_code, year, month, (month + 2) // 3 AS quarter, veg FROM panel JOIN cities ON entity = city_sk"""))
def _(t):
    from ..operators.reshape import calendar

    cal = calendar(t.spark, 1995, 2001).select("date_sk", "quarter")
    fact = t.panel().withColumns({"city_sk": F.col("entity"), "date_sk": F.col("year") * 100 + F.col("month")})
    return op.star_view(fact, [(t.cities(), ["city_sk"]), (cal, ["date_sk"])])


@query("key_uniqueness", "D12", "tbl:s n_bad:l", """
    SELECT 'orders' AS tbl, 0 AS n_bad UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def _(t):
    bad = lambda name, key: op.check_unique(t(name), key).agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n_bad"))
    return stack([bad("orders", ["o_orderkey"]), bad("lineitem", ["l_orderkey", "l_linenumber"])])
