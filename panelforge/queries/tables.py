"""Roles of the panel model bound to the driver's tables, for Spark and for SQL.

City = supplier, country = nation, month = month of shipping; vegetation, pollution and sealing
are means of discount, tax and quantity. The data hold no NULLs, so ``holed`` blanks cells by a key
rule, the same on both sides.
"""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import phase_label
from ..operators.aggregates import concat_distinct
from ..operators.metrics import green_index
from ..operators.windows import yoy_diff
from ..plans.facts import economic_fact, gold_fact, policy_fact, ranking
from ..plans.maintained import MaintainedGold
from ..sources.readers import lookup
from ..streaming.storage import fresh_path, listing, shared_folder


def total(c: str) -> Column:
    """Exact sum of values with two decimals: it does not depend on the order of summation.

    Whole hundredths are added up as longs; a decimal of every row would be read from the text of its double, which took more than half of
    a pass over the line items.
    """
    return F.sum(F.rint(F.col(c) * 100).cast("long")).cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def mean(c: str) -> Column:
    return total(c).cast("double") / F.count(c)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stored: dict[str, str] = {}

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return fresh_path(self.spark, name)

    def stage(self, *names: str) -> None:
        """Store roles that a query reads several times, as the pipeline stores its silver tables.

        Each is one pass over its raw table; later uses read the far smaller result, and plans stay short.
        """
        for name in names:
            if name not in self._stored:
                path = self.scratch(name)
                getattr(self, name)().write.parquet(path)
                self._stored[name] = path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame to shared storage and read it back."""
        path = self.scratch("kept")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _kept(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._stored[name]) if name in self._stored else None

    def lookup(self, rows: list[tuple], schema: str) -> DataFrame:
        return lookup(self.spark, rows, schema)

    # ---- roles ------------------------------------------------------------
    def panel(self) -> DataFrame:
        if "panel" in self._stored:
            return self._kept("panel")
        return self("lineitem").groupBy(
            F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        ).agg(
            mean("l_discount").alias("veg"), mean("l_tax").alias("pol"), mean("l_quantity").alias("seal"),
            mean("l_extendedprice").alias("price"), total("l_extendedprice").alias("price_sum"), F.count(F.lit(1)).alias("n"),
        )

    def holed(self) -> DataFrame:
        p = self.panel()
        e, y, m = F.col("entity"), F.col("year"), F.col("month")
        return p.withColumns({
            "veg": F.when((e + m) % 7 != 0, F.col("veg")), "pol": F.when((e + y) % 5 != 0, F.col("pol")),
            "seal": F.when((e * m + y) % 6 != 0, F.col("seal")),
        })

    def cities(self) -> DataFrame:
        s = self("supplier").join(self("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        k = F.col("s_suppkey")
        return s.select(
            k.alias("city_sk"), F.concat(F.regexp_replace("s_name", "#", ""), F.lit("_N"), F.col("s_nationkey")).alias("city_code"),
            F.col("s_name").alias("city_name"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("country_code"),
            F.col("n_name").alias("country_name"), (k % 60).cast("double").alias("lat"), (k % 120).cast("double").alias("lon"),
        )

    def cube(self) -> DataFrame:
        """Orders by nation, month and priority; ``amount`` is an exact decimal."""
        o = self("orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
                                  F.col("o_orderpriority").alias("priority"), "o_totalprice")
        c = self("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("country"))
        return o.join(c, "o_custkey").groupBy("country", "year", "month", "priority").agg(
            total("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("n"))

    def orders_by(self, *parts: str) -> DataFrame:
        cube = self._kept("cube") if "cube" in self._stored else self.cube()
        return cube.groupBy("country", *parts).agg(F.sum("amount").cast("double").alias("amount"), F.sum("n").alias("n"))

    def annual(self) -> DataFrame:
        return self.orders_by("year").select("country", "year", (F.col("amount") / F.col("n")).alias("gdp"), "amount", "n")

    def priorities(self) -> DataFrame:
        return self.orders_by("year", "priority").withColumn("value", F.col("amount") / F.col("n"))

    def prices(self) -> DataFrame:
        e = self("events")
        return e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(
            F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))

    def market(self) -> DataFrame:
        """Brand x month market: brand is the ticker, its number gives the country."""
        l = self("lineitem").select("l_partkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_extendedprice", "l_discount")
        p = self("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        square = F.sum(F.col("l_discount").cast("decimal(9,2)") * F.col("l_discount").cast("decimal(9,2)")).cast("double")
        m = l.join(p, "l_partkey").groupBy("ticker", "year", "month").agg(
            mean("l_extendedprice").alias("close_price"), (square / F.count("l_discount")).alias("monthly_volatility"))
        number = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
        return m.withColumn("country_code", F.concat(F.lit("N"), (number % 25).cast("string")))

    # ---- star and gold ----------------------------------------------------
    def env(self) -> DataFrame:
        if "env" in self._stored:
            return self._kept("env")
        h = self.holed().select(
            F.col("entity").alias("city_sk"), "year", "month", F.col("veg").alias("ndvi_mean"), F.col("pol").alias("no2_mean"),
            F.col("seal").alias("imperviousness_mean"), F.col("seal").alias("pm25_mean"))
        return green_index(yoy_diff(h, "city_sk", "year", "month", "ndvi_mean", "ndvi_yoy_change"), "ndvi_mean", "no2_mean", "imperviousness_mean")

    def renewables(self) -> DataFrame:
        m = self.orders_by("year", "month", "priority")
        urgent = F.sum(F.when(F.col("priority") == "1-URGENT", F.col("n")).otherwise(0))
        return m.groupBy(F.col("country").alias("country_code"), "year", "month").agg((urgent * 100.0 / F.sum("n")).alias("renewables_pct"))

    def carbon(self) -> DataFrame:
        return self.panel().groupBy("year", "month").agg((F.sum("price_sum").cast("double") / F.sum("n") / 1000).alias("ets_price_eur"))

    def economy(self, **sides: DataFrame) -> DataFrame:
        self.stage("cube", "panel")
        gdp = self.annual().select(F.col("country").alias("country_code"), "year", "gdp").join(
            self.cities().select("city_code", "country_code"), "country_code").select("city_code", "year", "gdp")
        co2 = self.annual().select(F.col("country").alias("country_code"), "year", F.col("amount").alias("co2_kt"))
        people = self.panel().groupBy(F.col("entity").alias("city_sk"), "year").agg(F.sum("n").alias("population"))
        people = people.join(self.cities().select("city_sk", "city_code"), "city_sk").select("city_code", "year", "population")
        return economic_fact(gdp, self.cities(), people, self.renewables(), carbon=self.carbon(), co2=co2, carbon_start=1997, unique_sides=True, **sides)

    def market_months(self) -> DataFrame:
        keys = ["country_code", "year", "month"]
        m = self.market()
        price = m.groupBy(*keys).agg(F.avg("close_price").alias("fin_close_price_avg"))
        return price.join(concat_distinct(m, keys, "ticker", ",", "fin_tickers"), keys, "left")

    def policy(self) -> DataFrame:
        p = self.priorities().select(F.col("country").alias("country_code"), "year", "priority", "amount")
        a = p.filter("priority = '1-URGENT' AND year < 1999").select("country_code", "year", F.col("amount").alias("eps_index"))
        b = p.filter("priority = '2-HIGH' AND year IN (1995, 1998, 2000)").select("country_code", "year", F.col("amount").alias("co2_kt"))
        c = p.filter("priority = '5-LOW' AND year > 1996").select("country_code", "year", F.col("amount").alias("investeu_total_eur"))
        return policy_fact(a, b, c)

    def gold(self, **sides: DataFrame) -> DataFrame:
        self.stage("panel", "cube", "env")
        eco = self.economy().select("city_sk", "year", "month", "gdp_monthly", "renewables_pct", "ets_price_eur")
        city = self.cities().select("city_sk", "city_code", "city_name", "country_code", "country_name")
        df = gold_fact(self.env(), city, eco, market=self.market_months(), unique_sides=True, **sides).drop("turning_point_phase", "gap_to_turning")
        level = self.annual().groupBy(F.col("country").alias("country_code")).agg(F.avg("gdp").alias("turning_point"))
        df = df.join(level, "country_code", "left").withColumn("gap_to_turning", F.col("gdp_monthly") - F.col("turning_point"))
        return df.withColumn("turning_point_phase", phase_label("ndvi_yoy_change", "gap_to_turning", "turning_point", 0.01))

    def ranked(self) -> DataFrame:
        """The ranking reads the stored gold table, as the pipeline does."""
        gold = self.gold().select("city_sk", "city_code", "country_code", "year", "month", "investment_score", "fin_tickers")
        return ranking(self.keep(gold))

    # ---- maintained gold ----------------------------------------------------
    RAW = ("lineitem", "orders", "customer", "part", "supplier", "nation")
    #: Counts up when the gold columns or their rules change, so that tables stored before are built anew.
    RULES = 1

    def silver(self) -> dict[str, DataFrame]:
        """Inputs of the gold table by month, each stored once."""
        self.stage("panel", "cube")
        eco = self.economy().select("city_sk", "year", "month", "gdp_monthly", "renewables_pct", "ets_price_eur")
        return {"panel": self.holed().select("entity", "year", "month", "veg", "pol", "seal"), "economy": self.keep(eco), "market": self.keep(self.market_months())}

    def gold_parts(self, silver: dict[str, DataFrame], months: Column) -> DataFrame:
        """Figures of the months for which the condition holds; the yearly change reads the same months of earlier years."""
        h = silver["panel"].select(
            F.col("entity").alias("city_sk"), "year", "month", F.col("veg").alias("ndvi_mean"), F.col("pol").alias("no2_mean"),
            F.col("seal").alias("imperviousness_mean"), F.col("seal").alias("pm25_mean"))
        env = yoy_diff(h, "city_sk", "year", "month", "ndvi_mean", "ndvi_yoy_change").filter(months)
        city = self.cities().select("city_sk", "city_code", "city_name", "country_code", "country_name")
        df = env.join(city, "city_sk", "left").join(silver["economy"].filter(months), ["city_sk", "year", "month"], "left")
        return df.join(silver["market"].filter(months), ["country_code", "year", "month"], "left")

    def levels(self) -> DataFrame:
        return self.annual().groupBy(F.col("country").alias("country_code")).agg(F.avg("gdp").alias("turning_point"))

    def raw_state(self) -> str:
        """Names, lengths and times of the raw files: equal as long as no file changed."""
        files = [x for name in self.RAW for x in listing(self.spark, f"{self.folder}/{name}.parquet")]
        return hashlib.md5(json.dumps([self.RULES, files]).encode()).hexdigest()

    def maintained(self) -> MaintainedGold:
        """The stored gold table of this folder, refreshed if a raw file changed since."""
        name = hashlib.md5(f"{self.RULES} {self.folder}".encode()).hexdigest()
        table = MaintainedGold(self.spark, f"{shared_folder(self.spark)}/maintained-{name}")
        state = self.raw_state()
        if table.manifest["raw"] != state:
            silver = self.silver()
            table.refresh(silver, lambda months: self.gold_parts(silver, months), self.levels(), state)
        return table

    def parameters(self) -> DataFrame:
        """Yearly fit figures per region, in the layout of the cluster parameters."""
        zone = self("supplier").join(self("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("cluster_id"))
        return self.panel().join(zone, "entity").groupBy("cluster_id", F.col("year").alias("estimation_year")).agg(
            F.regr_slope("veg", "seal").alias("beta1"), F.regr_slope("pol", "seal").alias("beta2"),
            F.avg("price").alias("turning_point"), F.regr_r2("veg", "seal").alias("r_squared"), F.countDistinct("entity").alias("n_cities"))


# name -> (needed tables, SQL)
_CTES: dict[str, tuple[str, str]] = {
    "panel": ("", """SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        {mean(l_discount)} AS veg, {mean(l_tax)} AS pol, {mean(l_quantity)} AS seal, {mean(l_extendedprice)} AS price, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3"""),
    "holed": ("panel", """SELECT entity, year, month, CASE WHEN (entity + month) % 7 <> 0 THEN veg END AS veg,
        CASE WHEN (entity + year) % 5 <> 0 THEN pol END AS pol, CASE WHEN (entity * month + year) % 6 <> 0 THEN seal END AS seal, price, n
        FROM panel"""),
    "cities": ("", """SELECT s_suppkey AS city_sk, replace(s_name, '#', '') || '_N' || s_nationkey AS city_code, s_name AS city_name,
        'N' || s_nationkey AS country_code, n_name AS country_name, CAST(s_suppkey % 60 AS DOUBLE) AS lat,
        CAST(s_suppkey % 120 AS DOUBLE) AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "annual": ("", """SELECT 'N' || c_nationkey AS country, CAST(year(o_orderdate) AS INTEGER) AS year, {mean(o_totalprice)} AS gdp,
        {total(o_totalprice)} AS amount, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""),
    "priorities": ("", """SELECT 'N' || c_nationkey AS country, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority,
        {mean(o_totalprice)} AS value, {total(o_totalprice)} AS amount, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "prices": ("", """SELECT user_id AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close,
        CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""),
    "market": ("", """SELECT p_brand AS ticker, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        {mean(l_extendedprice)} AS close_price,
        CAST(sum(CAST(l_discount AS DECIMAL(9, 2)) * CAST(l_discount AS DECIMAL(9, 2))) AS DOUBLE) / count(l_discount) AS monthly_volatility,
        'N' || (CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 25) AS country_code
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 6"""),
    "entity_year": ("holed", """SELECT entity, year, avg(veg) AS veg, avg(pol) AS pol, avg(seal) AS seal, avg(price) AS price
        FROM holed GROUP BY 1, 2"""),
    "env": ("holed", """SELECT entity AS city_sk, year, month, veg AS ndvi_mean, pol AS no2_mean, seal AS imperviousness_mean, seal AS pm25_mean,
        veg - lag(veg) OVER (PARTITION BY entity, month ORDER BY year) AS ndvi_yoy_change,
        round(0.5 * (veg - v0) / (v1 - v0) + 0.3 * (1 - (coalesce(pol, p0) - p0) / (p1 - p0)) + 0.2 * (1 - (coalesce(seal, s0) - s0) / (s1 - s0)), 6) AS green_index
        FROM holed, (SELECT min(veg) v0, max(veg) v1, min(pol) p0, max(pol) p1, min(seal) s0, max(seal) s1 FROM holed)"""),
    "renewables": ("", """SELECT 'N' || c_nationkey AS country_code, year(o_orderdate) AS year, month(o_orderdate) AS month,
        count(*) FILTER (o_orderpriority = '1-URGENT') * 100.0 / count(*) AS renewables_pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "carbon": ("", """SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, {mean(l_extendedprice)} / 1000 AS ets_price_eur FROM lineitem GROUP BY 1, 2"""),
    "economy": ("annual cities renewables carbon panel", """SELECT b.*, round((gdp_monthly / nullif(lag(gdp_monthly) OVER (PARTITION BY city_sk, month ORDER BY year), 0) - 1) * 100, 4) AS gdp_growth_rate FROM (
        SELECT c.city_sk, c.city_code, c.country_code, a.year, CAST(m AS INTEGER) AS month, a.year * 100 + m AS date_sk, gdp + (coalesce(nxt, gdp) - gdp) * (m - 1) / 12.0 AS gdp_monthly,
            ln(gdp + (coalesce(nxt, gdp) - gdp) * (m - 1) / 12.0) AS ln_gdp, p.population, r.renewables_pct, CASE WHEN a.year >= 1997 THEN k.ets_price_eur END AS ets_price_eur, a.amount AS co2_kt
        FROM (SELECT *, lead(gdp) OVER (PARTITION BY country ORDER BY year) AS nxt FROM annual) a CROSS JOIN range(1, 13) AS x(m) JOIN cities c ON c.country_code = a.country
        LEFT JOIN (SELECT entity, year, sum(n) AS population FROM panel GROUP BY 1, 2) p ON p.entity = c.city_sk AND p.year = a.year
        LEFT JOIN renewables r ON r.country_code = c.country_code AND r.year = a.year AND r.month = m LEFT JOIN carbon k ON k.year = a.year AND k.month = m) b"""),
    "market_months": ("market", """SELECT country_code, year, month, avg(close_price) AS fin_close_price_avg, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS fin_tickers FROM market GROUP BY 1, 2, 3"""),
    "gold": ("env economy cities market_months annual", """SELECT *, CASE WHEN investment_score >= 75 THEN 'STRONG_BUY' WHEN investment_score >= 55 THEN 'BUY' WHEN investment_score >= 35 THEN 'HOLD' ELSE 'AVOID' END AS investment_recommendation,
        CASE WHEN turning_point > 0 AND abs(gap_to_turning) <= turning_point * 0.01 THEN 'TURNING' WHEN coalesce(ndvi_yoy_change, 0) > 0.003 AND gap_to_turning > 0 THEN 'RECUPERANDO' ELSE 'DEGRADANDO' END AS turning_point_phase
        FROM (SELECT e.*, city_code, city_name, c.country_code, country_name, gdp_monthly, renewables_pct, ets_price_eur, fin_tickers, fin_close_price_avg, ndvi_trend_slope, turning_point, gdp_monthly - turning_point AS gap_to_turning,
            round(least(greatest(coalesce(green_index, 0) * 60 + coalesce(renewables_pct, 0) / 100 * 20 + least(greatest(10 - greatest(coalesce(pm25_mean, 15), 0) / 35 * 10, 0), 10)
                + least(greatest(greatest(coalesce(ets_price_eur, 0), 0) / 100 * 10, 0), 10), 0), 100), 2) AS investment_score
        FROM env e LEFT JOIN (SELECT city_sk, CASE WHEN regr_count(ndvi_mean, year) >= 2 THEN regr_slope(ndvi_mean, year) END AS ndvi_trend_slope FROM env GROUP BY 1) s ON s.city_sk = e.city_sk
        LEFT JOIN cities c ON c.city_sk = e.city_sk LEFT JOIN (SELECT city_sk, year, month, gdp_monthly, renewables_pct, ets_price_eur FROM economy) o ON o.city_sk = e.city_sk AND o.year = e.year AND o.month = e.month
        LEFT JOIN market_months f ON f.country_code = c.country_code AND f.year = e.year AND f.month = e.month
        LEFT JOIN (SELECT country, avg(gdp) AS turning_point FROM annual GROUP BY 1) t ON t.country = c.country_code)"""),
    "policy": ("priorities", """SELECT g.country_code, g.year, CAST(m AS INTEGER) AS month, g.year * 100 + m AS date_sk, a.amount AS eps_index,
        CASE WHEN y0 = y1 THEN v0 ELSE v0 + (v1 - v0) * (g.year - y0) / (y1 - y0) END AS co2_kt, c.amount AS investeu_total_eur
    FROM (SELECT *, last_value(CASE WHEN co2 IS NOT NULL THEN year END IGNORE NULLS) OVER f AS y0, last_value(co2 IGNORE NULLS) OVER f AS v0,
        first_value(CASE WHEN co2 IS NOT NULL THEN year END IGNORE NULLS) OVER b AS y1, first_value(co2 IGNORE NULLS) OVER b AS v1
        FROM (SELECT k.country_code, y.year, p.amount AS co2 FROM (SELECT DISTINCT country AS country_code FROM priorities) k CROSS JOIN (SELECT DISTINCT year FROM priorities) y
            LEFT JOIN priorities p ON p.country = k.country_code AND p.year = y.year AND p.priority = '2-HIGH' AND p.year IN (1995, 1998, 2000))
        WINDOW f AS (PARTITION BY country_code ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY country_code ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) g
    LEFT JOIN priorities a ON a.country = g.country_code AND a.year = g.year AND a.priority = '1-URGENT' AND a.year < 1999
    LEFT JOIN priorities c ON c.country = g.country_code AND c.year = g.year AND c.priority = '5-LOW' AND c.year > 1996 CROSS JOIN range(1, 13) AS r(m)"""),
    "ranked": ("gold", """SELECT *, lag(rank_position) OVER w - rank_position AS rank_change, investment_score - lag(investment_score) OVER w AS score_change, substr(split_part(fin_tickers, ',', 1), 1, 20) AS top_ticker FROM (
        SELECT *, rank() OVER (PARTITION BY year, month ORDER BY investment_score DESC) AS rank_position, rank() OVER (PARTITION BY year, month, country_code ORDER BY investment_score DESC) AS rank_within_country FROM gold)
        WINDOW w AS (PARTITION BY city_sk ORDER BY year, month)"""),
    "parameters": ("panel", """SELECT n_regionkey AS cluster_id, year AS estimation_year, regr_slope(veg, seal) AS beta1, regr_slope(pol, seal) AS beta2, avg(price) AS turning_point, regr_r2(veg, seal) AS r_squared, count(DISTINCT entity) AS n_cities
        FROM panel JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""),
}
#: ``{total(x)}`` and ``{mean(x)}`` stand for exact decimal sums.
CTES = {name: (needs, re.sub(r"\{mean\((\w+)\)\}", r"CAST(sum(CAST(\1 AS DECIMAL(18, 2))) AS DOUBLE) / count(\1)", re.sub(
    r"\{total\((\w+)\)\}", r"CAST(sum(CAST(\1 AS DECIMAL(18, 2))) AS DOUBLE)", sql))) for name, (needs, sql) in _CTES.items()}
