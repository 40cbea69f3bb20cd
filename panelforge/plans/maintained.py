"""A maintained gold table: months are partitions, and a refresh recomputes only the months whose inputs changed.

Stored are the month's own figures (``parts``), and what needs the whole table: bounds of the index, trend per city, turning level per
country, the ranking. A version of every month of every input tells what changed; a month also depends on the same month of earlier
years, so later years of a changed month are recomputed with it. Parts are replaced in place, partition by partition; then the
manifest names the new side tables and versions. A refresh that dies in between is repeated from the old versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import phase_label
from ..operators.aggregates import slope
from ..operators.metrics import green_index, score
from ..sources.writers import write_parquet
from ..streaming import storage
from .facts import ranking

PERIOD = ["year", "month"]
MEASURES = ["ndvi_mean", "no2_mean", "imperviousness_mean"]


def versions(sources: dict[str, DataFrame], base: str) -> DataFrame:
    """(year, month, version) of the months of ``base``: one text for each, made of the number and hashes of its rows in every source."""
    parts = []
    for name, df in sorted(sources.items()):
        h = F.xxhash64(*sorted(df.columns))
        parts.append(df.groupBy(*PERIOD).agg(F.concat_ws(":", F.lit(name), F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).alias("v")).withColumn(
            "base", F.lit(name == base)))
    together = reduce(lambda a, b: a.unionByName(b), parts)
    return together.groupBy(*PERIOD).agg(F.md5(F.array_join(F.array_sort(F.collect_list("v")), ",").cast("binary")).alias("version"), F.max("base").alias("base")).filter("base").drop("base")


def among(periods: list[tuple[int, int]]) -> Column:
    """Whether a row's month is one of ``periods``, as conditions on the partition columns."""
    years = {}
    for y, m in periods:
        years.setdefault(m, []).append(y)
    return reduce(lambda a, b: a | b, [(F.col("month") == m) & F.col("year").isin(ys) for m, ys in sorted(years.items())], F.lit(False))


class MaintainedGold:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def manifest(self) -> dict:
        for name in sorted(storage.names(self.spark, f"{self.path}/manifest"), reverse=True):
            text = storage.read_text(self.spark, f"{self.path}/manifest/{name}")
            if text.endswith("\n"):
                return json.loads(text)
        return {"version": 0, "raw": None, "periods": []}  # nothing is stored yet

    def _side(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest['sides'][name]}")

    def refresh(self, sources: dict[str, DataFrame], build: Callable[[Column], DataFrame], levels: DataFrame, raw: str | None = None,
                base: str = "panel") -> list[tuple[int, int]]:
        """Recompute the months of the source ``base`` whose sources changed; returns them.

        ``build(months)`` gives the parts of the months for which the condition holds; ``levels`` is (country_code, turning_point);
        ``raw`` names the state of the raw files, so that a later call can see without a scan that nothing changed.
        """
        old = self.manifest
        known = {(y, m): v for y, m, v in old["periods"]}
        now = {(r.year, r.month): r.version for r in versions(sources, base).collect()}  # one line for each calendar month
        first: dict[int, int] = {}
        for y, m in now.keys() | known.keys():  # the first year of each changed month of the calendar
            if known.get((y, m)) != now.get((y, m)):
                first[m] = min(y, first.get(m, y))
        rewritten = sorted(p for p in now if p[1] in first and p[0] >= first[p[1]])
        run = uuid.uuid4().hex
        if rewritten:
            write_parquet(build(among(rewritten)).filter(among(rewritten)), f"{self.path}/parts", PERIOD)
        for y, m in known.keys() - now.keys():
            storage.delete(self.spark, f"{self.path}/parts/year={y}/month={m}")
        if not now:
            return []
        parts = self.spark.read.parquet(f"{self.path}/parts")
        bounds = parts.agg(*[f(c).alias(f"{n}_{c}") for c in MEASURES for n, f in (("lo", F.min), ("hi", F.max))]).first().asDict()
        sides = {n: f"{n}-{run}" for n in ("trend", "levels", "ranked")}
        slope(parts.filter("ndvi_mean IS NOT NULL"), ["city_sk"], "year", "ndvi_mean", 2, None, "ndvi_trend_slope").write.parquet(f"{self.path}/{sides['trend']}")
        levels.write.parquet(f"{self.path}/{sides['levels']}")
        scored = self._scored(parts, bounds).select("city_sk", "city_code", "country_code", *PERIOD, "investment_score", "fin_tickers")
        write_parquet(ranking(storage.stored(scored, "scored")), f"{self.path}/{sides['ranked']}", PERIOD)
        new = {"version": old["version"] + 1, "raw": raw, "bounds": bounds, "sides": sides, "periods": [[y, m, v] for (y, m), v in sorted(now.items())]}
        storage.create_text(self.spark, f"{self.path}/manifest/{new['version']:012d}.json", json.dumps(new) + "\n")
        for name in (old.get("sides") or {}).values():
            storage.delete(self.spark, f"{self.path}/{name}")
        return rewritten

    @staticmethod
    def _scored(parts: DataFrame, bounds: dict) -> DataFrame:
        return score(green_index(parts, *MEASURES, bounds=bounds), "green_index", "renewables_pct", "pm25_mean", "ets_price_eur")

    def latest(self) -> tuple[int, int]:
        return max((y, m) for y, m, _ in self.manifest["periods"])

    def gold(self, tolerance: float = 0.01) -> DataFrame:
        """The gold table; a condition on year and month reaches the scan as a partition filter."""
        parts = self.spark.read.parquet(f"{self.path}/parts")
        df = self._scored(parts, self.manifest["bounds"])
        df = df.join(self._side("trend"), "city_sk", "left").join(self._side("levels"), "country_code", "left")
        df = df.withColumn("gap_to_turning", F.col("gdp_monthly") - F.col("turning_point"))
        return df.withColumn("turning_point_phase", phase_label("ndvi_yoy_change", "gap_to_turning", "turning_point", tolerance))

    def ranked(self) -> DataFrame:
        return self._side("ranked")
