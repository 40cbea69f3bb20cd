"""Faults that larger tables showed, each on the smallest input that shows it."""

from pyspark.sql import functions as F

from panelforge.functions import scalars as fn


def test_scores_round_as_the_sql_does(spark):
    """0.68875 * 60 is a little less than 41.325; scaled by 100 it is the half that SQL rounds up."""
    df = spark.createDataFrame([(0.68875,)], "green double").withColumn("x", F.col("green") * 60)
    row = df.select(fn.round_scaled("x", 2).alias("plain"), fn.composite_score(F.col("green"), F.lit(0.0), F.lit(35.0), F.lit(0.0)).alias("score")).first()
    assert (row.plain, row.score) == (41.33, 41.33)


class Held:
    """Two entity-years with the same months, which come in different orders."""

    def __init__(self, spark):
        self.spark = spark

    def holed(self):
        rows = [(e, 1995, m, x, x, x, x) for e, xs in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for m, x in enumerate(xs, 1)]
        return self.spark.createDataFrame(rows, "entity long, year int, month int, veg double, pol double, seal double, price double").coalesce(1)


def test_yearly_means_do_not_depend_on_the_order_of_months(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are different doubles: a year at a cut fell on either side of it."""
    from panelforge.queries.models import labelled

    rows = labelled(Held(spark)).select("veg", "pol", "seal", "price").collect()
    assert len(rows) == 2 and len(set(rows)) == 1


def test_kmeans_takes_the_steps_its_sql_states(spark, folder, monkeypatch):
    """Centres of larger tables still move after forty steps, where the SQL ends."""
    from panelforge.operators.models import clustering
    from panelforge.queries import REGISTRY

    seen, plain = [], clustering.lloyd
    monkeypatch.setattr(clustering, "lloyd", lambda points, runs, rounds: seen.append(rounds) or plain(points, runs, rounds))
    REGISTRY["kmeans_given_start"].run(spark, folder)
    assert seen == [40]


def test_sums_make_no_decimal_of_a_row(spark, folder):
    """The panel and the cube behind every gold and serving query read no decimal from the text of a double."""
    from panelforge.queries.tables import Tables, total

    t = Tables(spark, folder)
    for df in (t.panel(), t.cube(), t.market()):
        assert "as decimal(18,2)" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(0.07,), (0.29,), (-1.15,), (1e7 + 0.01,), (None,)], "x double")
    assert str(rows.select(total("x").alias("s")).first().s) == "9999999.22"


def test_near_copies_by_fingerprint_are_one(spark):
    """Texts of the same repeated line and other ends: their fingerprints are within 4 bits, their sets of shingles are not alike."""
    import pytest

    near_dedup = pytest.importorskip("panelforge.llm.near_dedup")
    line = "one two three four five six seven eight nine "
    texts = [line * 60 + "a b c", line * 60 + "d e f g h i j", "quite other words stand here and nothing of it is in those lines above"]
    bits = [near_dedup.simhash(t.encode()) & (1 << 64) - 1 for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_dedup.keep_one(docs, find=near_dedup.similar).count() == 3
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, find=near_dedup.near_copies).collect()) == [0, 2]


def test_returns_from_a_price_of_zero_are_those_of_the_sql(spark, tmp_path):
    """A month whose first price is zero: its return is infinite, NaN if the last one is zero too; unknown prices do not count."""
    import duckdb
    from oracle import compare
    from panelforge.queries import REGISTRY

    day = {1: {0: 0.0}, 2: {0: 0.0, 27: 0.0}, 3: {27: 0.0}, 4: {9: 0.0}, 5: {0: None, 27: None}}
    rows = [(u * 100 + d, f"2024-01-{d + 1:02d} 0{h}:00:00", u, day[u].get(d, d + 1.0 + u) if h else 7.5)
            for u in day for d in range(28) for h in (range(2) if (u, d) != (5, 0) else (1,))]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    query = REGISTRY["daily_to_monthly_market"]
    ok, message = compare(query, spark, con, str(tmp_path))
    assert ok, message
    got = {r.ticker: r.monthly_return for r in query.run(spark, str(tmp_path)).collect()}
    assert got[1] == float("inf") and got[2] != got[2] and got[3] == -1.0 and got[5] is not None


def _parts_of_passes(monkeypatch):
    """Into how many parts a table lies that passes of a fit read."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: seen.append(self.rdd.getNumPartitions()) or plain(self, *a, **k))
    return seen


def test_kmeans_passes_keep_every_core(spark, monkeypatch):
    """A small table came in one part, so one core did all passes; all runs move as plain Lloyd steps do."""
    import numpy as np
    from panelforge.operators.models import clustering

    seen = _parts_of_passes(monkeypatch)
    x = np.random.default_rng(1).normal(size=(3000, 2)) + np.repeat([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]], 1000, axis=0)
    starts = {2: x[:2], 3: x[[0, 1, 2999]], 5: x[::600]}
    df = spark.createDataFrame(x.tolist(), "a double, b double").coalesce(1)
    points = df.select(F.array("a", "b").alias("x"))
    done = clustering.lloyd(points, starts, 6)
    for run, centres in starts.items():
        for _ in range(6):
            near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            last, centres = centres, np.array([x[near == c].mean(axis=0) for c in range(len(centres))])
        assert np.allclose(done[run]["centres"], centres, atol=1e-9) and done[run]["n"].tolist() == np.bincount(near).tolist()
        assert abs(done[run]["cost"] - ((x - last[near]) ** 2).sum()) < 1e-6
    seen.clear()
    clustering.kmeans_select(df, ["a", "b"], k_max=3, starts=2, rounds=3)
    assert min(seen) >= spark.sparkContext.defaultParallelism


def test_boosting_passes_keep_every_core(spark, monkeypatch):
    import numpy as np
    from panelforge.operators.models import boosting

    tree = boosting.Tree([{0: (0, 1, 1.0)}, {1: (1, 0, 1.0)}], {(1, 0): 5.0, (2, 2): 6.0, (2, 3): 7.0})
    x = np.array([[0, 0], [1, 3], [2, 0], [2, 1]], np.int32)
    assert tree.values(x).tolist() == [5.0, 5.0, 6.0, 7.0] and tree.nodes(x).tolist() == [-1, -1, 2, 3]
    seen = _parts_of_passes(monkeypatch)
    rows = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 > 9).cast("int").alias("y")).coalesce(1)
    model = boosting.boost(rows, ["a"], "y", 2, rounds=6, depth=2, rate=0.5)
    assert len(model.rounds) == 6 and min(seen) >= spark.sparkContext.defaultParallelism


def test_the_fit_hands_over_trend_and_season(spark):
    """Each month summed all knots and waves anew, three times, in lambdas; the values are those of the stored model."""
    import math
    from panelforge.operators.models import forecast

    rows = [(e, 1995 + i // 12, i % 12 + 1, 20 + 0.1 * i * (e + 1) + 3 * math.sin(i * math.pi / 6)) for e in range(3) for i in range(30 + 9 * e)]
    s = forecast.series(spark.createDataFrame(rows, "entity long, year int, month int, v double"), "entity", "year", "month", "v")
    fit = forecast.fit_changepoints(s, "entity", together=2)
    assert "zip_with" not in forecast.components(fit, "entity")._jdf.queryExecution().optimizedPlan().toString().lower()
    p = fit.select("m", F.explode("points").alias("p")).withColumn("t", (F.year("p.ds") * 12 + F.month("p.ds") - 1).cast("double"))
    off = p.select(F.abs(F.col("p.trend") - forecast._trend(F.col("t"))).alias("a"), F.abs(F.col("p.season") - 1 - forecast._waves(F.col("t"))).alias("b"))
    assert off.count() == len(rows) and off.agg(F.max(F.greatest("a", "b"))).first()[0] < 1e-9
