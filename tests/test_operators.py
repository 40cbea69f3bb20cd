"""Edge rows: NULL keys and measures, single rows, gaps, ties, degenerate ranges, short series."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as fn
from panelforge.operators import (
    aggregates, cleaning, crawl, dimensional, geo, imputation, joins, metrics, ordered_sets, ordering, profiling, reshape, windows,
)
from panelforge.operators.models import clustering, forecast, panel, phase


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- scalars -----------------------------------------------------------------

def test_text_scalars(spark):
    df = spark.createDataFrame([("34000 p", "1,234.5", "3,5", "2020T3 (a)", "Ávila_ES")], "a string, b string, c string, d string, e string")
    r = one(df.select(
        fn.to_number("a"), fn.to_amount("b"), fn.decimal_comma("c"), fn.strip_notes("d"), fn.key_token("e"), fn.to_int("d"), fn.leading_number("a")))
    assert tuple(r) == (34000.0, 1234.5, 3.5, "2020T3", "ES", 2020, 34000.0)


def test_unreadable_text_is_null_or_default(spark):
    df = spark.createDataFrame([(":",), (None,), ("",)], "a string")
    assert values(df.select(fn.to_number("a"), fn.to_amount("a"), fn.to_int("a"), fn.decimal_comma("a"))) == [(None, 0.0, None, None)] * 3


def test_parse_list_forms(spark):
    df = spark.createDataFrame([("['A', 'B']",), ("A , B",), ("",), (None,), ("A",), ("[broken",)], "a string")
    assert [r[0] for r in df.select(fn.parse_list("a")).collect()] == [["A", "B"], ["A", "B"], [], [], [], []]


def test_non_finite(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.finite_or_null("x")).collect()] == [None, None, None, 1.5, None]


def test_periods(spark):
    df = spark.createDataFrame([("2020-03",), ("202003",), ("2020-M03",), ("2020",), ("2020-13",)], "p string")
    y, m = fn.parse_period("p")
    assert [tuple(r) for r in df.select(y, m).collect()] == [(2020, 3)] * 3 + [(None, None)] * 2


def test_scores_and_labels(spark):
    df = spark.createDataFrame([(None, None, None, None), (2.0, 500.0, -3.0, 1e9), (0.5, 50.0, 35.0, 0.0)], "g double, r double, a double, c double")
    s = [r[0] for r in df.select(fn.composite_score("g", "r", "a", "c")).collect()]
    assert s[0] == pytest.approx(5.71) and s[1] == 100.0 and s[2] == 40.0
    cuts = spark.createDataFrame([(75.0,), (74.99,), (55.0,), (35.0,), (34.9,)], "s double")
    assert [r[0] for r in cuts.select(fn.recommend("s")).collect()] == ["STRONG_BUY", "BUY", "BUY", "HOLD", "AVOID"]


def test_phase_label_rules(spark):
    df = spark.createDataFrame(
        [(0.1, 10.0, 100.0), (0.1, 20.0, 100.0), (0.001, 20.0, 100.0), (None, None, None), (0.1, -20.0, 100.0)], "s double, g double, t double")
    labels = [r[0] for r in df.select(fn.phase_label("s", "g", "t")).collect()]
    assert labels == ["TURNING", "RECUPERANDO", "DEGRADANDO", "DEGRADANDO", "DEGRADANDO"]


# ---- ordering ------------------------------------------------------------------

def skewed(spark, n=4000, seed=1):
    """One group holds most rows, one value holds a third of them."""
    rng = random.Random(seed)
    rows = [("hot" if i % 5 else "cold", 7.0 if i % 3 == 0 else float(rng.randint(0, 500))) for i in range(n)]
    return rows + [("cold", None), ("single", 1.0)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("cuts", [1, 16, 10**6])
def test_positions_equal_brute_force(spark, descending, cuts):
    rows = skewed(spark)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["_g0"], r["_v"]): (r["_n"], r["_before"]) for r in ordering.value_positions(df, ["g"], "v", descending, cuts).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        vs = [v for k, v in rows if k == g and v is not None]
        for v in set(vs):
            want[(g, v)] = (vs.count(v), sum(w > v if descending else w < v for w in vs))
    assert got == want


@pytest.mark.parametrize("cuts", [1, 10**4])
def test_quantiles_and_rows_numbers_with_cuts(spark, monkeypatch, cuts):
    monkeypatch.setattr(ordering, "CUTS_PER_PARTITION", cuts)
    rows = skewed(spark)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["value"] for r in ordering.quantiles(df, ["v"], [0.25, 0.5, 0.9], ["g"]).collect()}
    for g in ("hot", "cold", "single"):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        for p in (0.25, 0.5, 0.9):
            at = (len(vs) - 1) * p
            lo, hi = math.floor(at), math.ceil(at)
            assert got[(g, p)] == pytest.approx(vs[lo] + (vs[hi] - vs[lo]) * (at - lo))
    numbered = ordering.number_rows(spark.range(500).withColumn("k", F.lit("x")), ["k", "id"], 11)
    assert [tuple(r) for r in numbered.orderBy("id").select("id", "sk").collect()] == [(i, i + 11) for i in range(500)]


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 3.0), ("d", None)], "k string, v double")
    assert values(ordering.rank_in(df, [], "v").select("k", "rank"), "k") == [("a", 1), ("b", 1), ("c", 3), ("d", None)]


# ---- cleaning, reshape -----------------------------------------------------------

def test_dedupe_needs_order_and_is_repeatable(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (2, None)], "k int, v string")
    with pytest.raises(ValueError):
        cleaning.dedupe(df, ["k"])
    assert set(map(tuple, cleaning.dedupe(df, ["k"], ["v"]).collect())) == {(1, "a"), (None, "z"), (2, None)}


def test_std_cols_and_header_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" A b", "a B", "C"])
    assert cleaning.std_cols(df).columns == ["a_b", "a_b__dup1", "c"]
    assert cleaning.pick_column(["Geo", "x"], ["geo"]) == "Geo"
    assert cleaning.pick_column(["Total Amount EUR"], [], ["amount"]) == "Total Amount EUR"


def test_layout_rejects_a_sheet_without_geography(spark):
    with pytest.raises(ValueError):
        reshape.normalise_layout(spark.createDataFrame([(1, 2)], ["a", "b"]))


def test_calendar_is_complete(spark):
    rows = values(reshape.calendar(spark, 1999, 2000).select("date_sk", "is_leap_year"), "date_sk")
    assert len(rows) == 24 and rows[0] == (199901, False) and rows[12] == (200001, True)


# ---- joins -----------------------------------------------------------------------

def test_attach_never_multiplies_rows(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    side = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert values(joins.attach(base, [side], ["k"]), "k") == [(1, "a"), (2, None)]


def test_nearest_equals_brute_force_near_poles_and_date_line(spark):
    rng = random.Random(3)
    pts = [(i, "A", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(300)] + [(300, "A", 10.0, 179.95), (301, "B", 10.0, 0.0), (302, "A", 10.0, 179.95)]
    sts = [(i, "A", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(200)] + [(200, "A", 10.0, -179.95)]

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for radius in (25.0, 900.0):
        got = {r["point"]: (r["site"], round(r["distance_km"], 6)) for r in joins.nearest_within(
            spark.createDataFrame(pts, "point int, c string, lat double, lon double"),
            spark.createDataFrame(sts, "site int, c string, lat double, lon double"), "c", radius).collect()}
        want = {}
        for p in pts:
            near = sorted((km(p, s), s[0]) for s in sts if s[1] == p[1])
            if near and near[0][0] <= radius:
                want[p[0]] = (near[0][1], round(near[0][0], 6))
        assert got == want


def test_valid_at_picks_the_version_of_the_day(spark):
    d = datetime.date
    dim = spark.createDataFrame([(1, "old", d(2000, 1, 1), d(2009, 12, 31)), (1, "new", d(2010, 1, 1), d(9999, 12, 31))], "k int, v string, valid_from date, valid_to date")
    fact = spark.createDataFrame([(1, d(2009, 12, 31)), (1, d(2010, 1, 1)), (1, d(1990, 1, 1)), (2, d(2010, 1, 1))], "k int, day date")
    assert values(joins.join_valid_at(fact, dim, ["k"], "day").select("k", "day", "v"), "k", "day") == [
        (1, d(1990, 1, 1), None), (1, d(2009, 12, 31), "old"), (1, d(2010, 1, 1), "new"), (2, d(2010, 1, 1), None)]


# ---- aggregates -----------------------------------------------------------------

def test_degenerate_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 5.0), ("b", 1, 5.0), ("b", 2, None)], "k string, x int, v double")
    assert {r["z"] for r in aggregates.minmax(df, "v", "z").collect()} == {None}
    assert values(aggregates.slope(df, ["k"], "x", "v", 2, 0.0), "k") == [("a", 0.0), ("b", 0.0)]
    empty = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert values(aggregates.group_sum0(empty, ["k"], "v"), "k") == [("a", None), ("b", 2.0)]
    assert values(aggregates.group_sum0(empty, ["k"], "v", zero_as_null=False), "k") == [("a", 0.0), ("b", 2.0)]
    assert [r["outlier_flag"] for r in aggregates.iqr_flags(df, "v").collect()] == [0, 0, 0, None]


def test_months_with_few_sessions_are_dropped(spark):
    days = [("t", datetime.date(2024, 1, i), float(i), 1.0) for i in range(1, 16)] + [("t", datetime.date(2024, 2, i), 1.0, 1.0) for i in range(1, 15)]
    df = spark.createDataFrame(days, "ticker string, date date, close double, volume double")
    r = one(aggregates.ohlc_monthly(df))
    assert (r["month"], r["sessions"], r["close_price"], r["monthly_return"]) == (1, 15, 8.0, 14.0)


# ---- windows and imputation --------------------------------------------------------

def test_year_on_year_over_a_gap(spark):
    df = spark.createDataFrame([(1, 2000, 1, 1.0), (1, 2002, 1, 4.0), (1, 2003, 1, 5.0)], "e int, y int, m int, v double")
    plain = windows.yoy_diff(df, "e", "y", "m", "v", "d")
    assert values(windows.yoy_diff(plain, "e", "y", "m", "v", "s", strict=True).select("y", "d", "s"), "y") == [(2000, None, None), (2002, 3.0, None), (2003, 1.0, 1.0)]


def test_interpolation_hits_its_knots_and_holds_ends(spark):
    df = spark.createDataFrame([("a", 2000, 10.0), ("a", 2004, 30.0), ("b", 2001, None)], "e string, y int, v double")
    got = values(imputation.interp_grid(df, "e", "y", "v", 1999, 2005).filter("e = 'a'").select("y", "v"), "y")
    assert got == [(1999, 10.0), (2000, 10.0), (2001, 15.0), (2002, 20.0), (2003, 25.0), (2004, 30.0), (2005, 30.0)]
    monthly = values(imputation.interp_monthly(df.filter("e = 'a'"), "e", "y", "v").filter("month IN (1, 7)").select("y", "month", "monthly"), "y", "month")
    assert monthly == [(2000, 1, 10.0), (2000, 7, 20.0), (2004, 1, 30.0), (2004, 7, 30.0)]
    months = spark.createDataFrame([("a", 2000, 10.0), ("a", 2001, None), ("a", 2002, 5.0)], "e string, y int, v double")
    gap = values(imputation.interp_monthly(months, "e", "y", "v").filter("month IN (1, 2)").select("y", "month", "monthly"), "y", "month")
    assert gap == [(2000, 1, 10.0), (2000, 2, None), (2001, 1, None), (2001, 2, None), (2002, 1, 5.0), (2002, 2, 5.0)]


def test_median_fill_of_an_empty_column_is_zero(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, None, 4.0)], "k int, a double, b double")
    assert values(imputation.impute_median(df, ["a", "b"]), "k") == [(1, 0.0, 1.0), (2, 0.0, 2.5), (3, 0.0, 4.0)]


def test_sensor_ratio_falls_back(spark):
    df = spark.createDataFrame([(1, 2012, 1, 2.0, "O"), (1, 2012, 1, 6.0, "N"), (2, 2012, 1, 2.0, "O")], "e int, y int, m int, v double, s string")
    got = imputation.harmonise_sensors(df, "e", "y", "m", "v", "s", "O", "N", [2012])
    assert set(map(tuple, got.filter("m = 5").select("e", "v", "s").collect())) == {(1, 6.0, "O"), (2, 7.0, "O")}


def test_first_non_empty_and_preference(spark):
    a = spark.createDataFrame([("x", 1)], "c string, v int")
    assert values(imputation.first_non_empty([a.filter("v > 1"), a, a.withColumn("v", F.lit(9))])) == [("x", 1)]
    assert imputation.prefer_category(a, "c", ["y", "z"]).count() == 0


# ---- dimensions ---------------------------------------------------------------------

def dims(spark):
    d = datetime.date
    dim = spark.createDataFrame(
        [(1, "same", "A", d(2006, 1, 1), d(9999, 12, 31), True), (2, "moved", "A", d(2006, 1, 1), d(9999, 12, 31), True), (3, "gone", "A", d(2006, 1, 1), d(9999, 12, 31), True),
         (4, "null", None, d(2006, 1, 1), d(9999, 12, 31), True)], "sk long, key string, attr string, valid_from date, valid_to date, is_current boolean")
    snap = spark.createDataFrame([("same", "A"), ("moved", "B"), ("new", "C"), ("null", None)], "key string, attr string")
    return dim, snap


def test_history_has_one_current_version_and_no_overlap(spark):
    dim, snap = dims(spark)
    once = dimensional.scd2_merge(dim, snap, "key", ["attr"], "2024-05-01")
    rows = once.collect()
    once = spark.createDataFrame(rows, once.schema)  # a run starts from the stored table
    assert len(rows) == 6 and len({r["sk"] for r in rows}) == 6
    by_key = {}
    for r in rows:
        by_key.setdefault(r["key"], []).append(r)
    for key, versions in by_key.items():
        assert sum(v["is_current"] for v in versions) == 1
        spans = sorted((v["valid_from"], v["valid_to"]) for v in versions)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert [v["valid_from"] for v in by_key["new"]] == [datetime.date(2006, 1, 1)]
    again = dimensional.scd2_merge(once, snap, "key", ["attr"], "2024-05-01")
    assert set(map(tuple, again.collect())) == set(map(tuple, rows))
    later = dimensional.scd2_merge(once, snap.withColumn("attr", F.lit("Z")), "key", ["attr"], "2024-05-01")
    assert {r["attr"] for r in later.filter("key = 'moved' AND is_current").collect()} == {"Z"} and later.filter("key = 'moved'").count() == 2


def test_upsert_twice_is_once_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "n")], "k int, v string, w string")
    once = dimensional.upsert(target, new, ["k"], ["v"])
    assert values(once, "k") == [(1, "a", "x"), (2, None, "y"), (3, "c", "n")]
    assert values(dimensional.upsert(once, new, ["k"], ["v"]), "k") == values(once, "k")


def test_repeated_new_keys_give_one_row(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (2, "late", 2), (2, "early", 1), (2, "early", 1), (None, "n", 1), (None, "n", 1)], "k int, v string, at int")
    assert values(dimensional.insert_absent(target, new, ["k"], ["at"]).filter("k is not null"), "k") == [(1, "a"), (2, "early")]
    assert dimensional.insert_absent(target, new, ["k"], ["at"]).count() == 3
    assert values(dimensional.upsert(target, new, ["k"], ["v"], ["at"]).filter("k is not null"), "k") == [(1, "x"), (2, "late")]
    assert values(dimensional.insert_absent(target, new.drop("at"), ["k"]).filter("k = 2"), "k") == [(2, "early")]
    fact = spark.createDataFrame([(2, 0), (2, 1), (3, 2)], "k int, n int").withColumn("v", F.lit("old"))
    patched = dimensional.update_from(fact, new.withColumnRenamed("v", "w"), ["k"], {"v": F.col("w")}, ["at"])
    assert values(patched.select("n", "v"), "n") == [(0, "late"), (1, "late"), (2, "old")]


def test_repeated_snapshot_keys_open_one_version(spark):
    dim = spark.createDataFrame([(1, "a", "x", "2010-01-01", "9999-12-31", True)], "sk long, key string, attr string, f string, t string, is_current boolean")
    dim = dim.select("sk", "key", "attr", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"), "is_current")
    snap = spark.createDataFrame([("a", "y", 1), ("a", "z", 2), ("b", "p", 2), ("b", "q", 1)], "key string, attr string, at int")
    got = dimensional.scd2_merge(dim, snap, "key", ["attr"], "2024-05-01", order=["at"])
    assert values(got.filter("is_current").select("key", "attr"), "key") == [("a", "z"), ("b", "p")] and got.count() == 3


def test_household_size_must_be_above_zero(spark):
    df = spark.createDataFrame([("household_size", 0.0), ("household_size", 0.1), ("household_size", None), (None, 0.0), ("population_density", 0.0)], "d string, v double")
    got = cleaning.value_flags(df, "v", "d").select("value_out_of_range").collect()
    assert [r[0] for r in got] == [True, False, False, False, False]


def test_layout_knows_the_published_headers(spark):
    df = spark.createDataFrame([("es", "2020", "1.5")], "COU string, TIME string, Value string")
    assert [tuple(r) for r in reshape.normalise_layout(df).collect()] == [("ES", 2020, 1.5)]


def test_second_sensor_value_is_repeatable(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    second = spark.createDataFrame([(1, 3.0, 2), (1, None, 0), (1, 5.0, 1)], "k int, v double, at int")
    assert imputation.fill_from(df, second, ["k"], "v", F.lit(True)).first()["v"] == 3.0
    assert imputation.fill_from(df, second, ["k"], "v", F.lit(True), ["at"]).first()["v"] == 5.0


# ---- metrics, geo, pages ---------------------------------------------------------------

def test_green_index_null_rules(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (2, 1.0, None, 3.0), (3, None, 2.0, None)], "k int, v double, p double, s double")
    got = values(metrics.green_index(df, "v", "p", "s").select("k", "green_index"), "k")
    assert got == [(1, 0.5), (2, 0.8), (3, None)]


def test_bit_mask(spark):
    df = spark.createDataFrame([(0,), (2,), (8,), (16,), (4,), (1,)], "qa int")
    assert sorted(r[0] for r in geo.qa_mask(df, "qa").collect()) == [0, 1, 4]


def test_page_links_titles_dates_and_bases(spark):
    html = """<div><article><a class='t' href="/op/1_en"><b>Wind</b>  farm</a> signed 3 May 2021</article>
              <li><A HREF='two_en'>Two</A></li><a href="#x">no</a><a href="https://o.org/z_en">Z</a> 1 June 2020</div>"""
    pages = spark.createDataFrame([(1, "http://h.org/a/b?x=1", html), (2, "http://h.org", '<a href="/op/1_en">again</a>'), (3, "http://h.org/", None)], "id int, url string, html string")
    links = crawl.extract_links(pages, "id", "url", "html", "_en$")
    got = values(links.select("id", "href", "title", "date_text"), "id", "position")
    assert got == [(1, "/op/1_en", "Wind farm", "3 May 2021"), (1, "two_en", "Two", None), (1, "https://o.org/z_en", "Z", "1 June 2020"), (2, "/op/1_en", "again", None)]
    urls = sorted(r["link_url"] for r in crawl.absolute_urls(links, "url").collect())
    assert urls == ["http://h.org/a/two_en", "http://h.org/op/1_en", "https://o.org/z_en"]


# ---- profiling and models ---------------------------------------------------------------

def test_moments_are_sample_corrected(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 9.0]
    n, m = len(xs), sum(xs) / 5
    s = math.sqrt(sum((x - m) ** 2 for x in xs) / (n - 1))
    skew = n / ((n - 1) * (n - 2)) * sum(((x - m) / s) ** 3 for x in xs)
    kurt = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sum(((x - m) / s) ** 4 for x in xs) - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    r = one(profiling.moments(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]))
    assert r["skewness"] == pytest.approx(skew) and r["kurtosis"] == pytest.approx(kurt)


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = values(ordered_sets.hash_sample(df, ["id"], 50), "id")
    assert len(a) == 50 and a == values(ordered_sets.hash_sample(df.repartition(7), ["id"], 50), "id")


def test_silhouette_blocks_do_not_change_the_result(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, rng.gauss(i % 3, 0.4), rng.gauss(-(i % 3), 0.4)) for i in range(60)] + [(60, 9, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "e int, c int, x double, y double")
    whole = values(clustering.silhouette(df, "e", ["x", "y"], "c").select("e", F.round("silhouette", 9)), "e")
    cut = values(clustering.silhouette(df, "e", ["x", "y"], "c", block_rows=7).select("e", F.round("silhouette", 9)), "e")
    assert whole == cut and dict(whole)[60] == 0.0


def test_kmeans_picks_the_best_silhouette(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.gauss(10 * (i % 3), 0.1), rng.gauss(0, 0.1)) for i in range(90)], "e int, x double, y double")
    rows, tried, run = clustering.kmeans_select(df, ["x", "y"], 2, 5)
    assert max(tried, key=lambda t: t[1])[0] == run["k"] == 3 and run["settled"] and run["rounds"] < 300
    plain = {k: clustering.silhouette_squared(clustering.kmeans_select(df, ["x", "y"], k, k)[0], ["x", "y"], "cluster_id").agg(F.avg("silhouette")).first()[0] for k in (2, 3)}
    assert plain[3] == pytest.approx(dict(tried)[3]) and plain[2] == pytest.approx(dict(tried)[2])
    assert not clustering.kmeans_select(df, ["x", "y"], 4, 4, rounds=1)[2]["settled"]
    with pytest.raises(ValueError):
        clustering.kmeans_select(df.limit(1), ["x", "y"])
    assert {r["cluster_id"] for r in rows.collect()} == {0, 1, 2}


def test_panel_recovers_a_known_curve_and_flags_small_groups(spark):
    rng = random.Random(4)
    rows = []
    for e in range(20):
        for y in range(2000, 2010):
            if (e + y) % 7:
                x = 8 + 0.1 * e + 0.05 * (y - 2000) * (e % 3 + 1) + rng.random() * 0.3
                rows.append((1, e, y, 3.0 * x - 0.15 * x * x + 0.2 * e - 0.01 * y, x))
    rows += [(2, e, 2000 + e % 3, 1.0 + e, 2.0 + e) for e in range(5)]
    fit, res = panel.panel_fe(spark.createDataFrame(rows, "g int, e int, t int, y double, x double"), "e", "t", "y", "x", "g")
    full = panel.turning_point(panel.panel_fe_se(fit, res, "g", "e"))
    out = {r["g"]: r for r in full.collect()}
    assert out[1]["beta1"] == pytest.approx(3.0, abs=1e-2) and out[1]["beta2"] == pytest.approx(-0.15, abs=1e-3)
    assert out[1]["turning_point_ln"] == pytest.approx(10.0, abs=0.05) and out[1]["shape"] == "INVERTED_U"
    assert out[2]["turning_point"] is None and out[2]["reason"] == "TOO_FEW_OBSERVATIONS" and out[2]["shape"] == "UNCLEAR"


@pytest.mark.parametrize("t, n, want", [(0.0, 5, 1.0), (2.570582, 5, 0.05), (12.7062, 1, 0.05), (-1.0, 1, 0.5), (1.0, 10, 0.3408931), (3.0, 2, 0.0954660),
                                        (1.959964, 10**7, 0.05), (40.0, 30, 0.0)])
def test_student_p_value(spark, t, n, want):
    assert spark.range(1).select(panel.student_p(F.lit(t), F.lit(n)).alias("p")).first()["p"] == pytest.approx(want, abs=1e-6)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 120.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(panel.log_gamma(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(x) for x in xs], abs=1e-10)


def test_two_way_effects_equal_dummies(spark):
    """Against least squares on all dummies: gaps, repeated cells, parts that share no period, an entity of one row."""
    import numpy as np

    r, rows = random.Random(3), []
    for e in range(14):
        for t in (range(e % 5, 9 - e % 3) if e < 10 else range(20, 24)):
            if (e + t) % 6:
                rows.append((1, e, t, r.gauss(0, 1) + e - t, r.gauss(0, 1) * (1 + t)))
    rows += [rows[4], (1, 99, 3, 1.0, 2.0), (2, 1, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, e int, t int, y double, x double")
    one_group = [x for x in rows if x[0] == 1]
    es, ts = (sorted({x[i] for x in one_group}) for i in (1, 2))
    d = np.array([[x[1] == e for e in es] + [x[2] == t for t in ts] for x in one_group], float)
    want = {}
    for i in (3, 4):
        v = np.array([x[i] for x in one_group])
        want[i] = v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    got = sorted((tuple(x) for x in panel.within(df.select("*", F.col("y").alias("y0"), F.col("x").alias("x0")), "g", "e", "t", ["y", "x"]).filter("g = 1").select(
        "e", "t", "y0", "y", "x").collect()))
    plain = sorted((x[1], x[2], x[3], a, b) for x, a, b in zip(one_group, want[3], want[4]))
    assert np.allclose(np.array(got), np.array(plain), atol=1e-9)


def test_boosted_classifier_beats_the_forest_and_stops(spark):
    rng = random.Random(6)
    label = lambda a, b: "TURNING" if abs(a - b) < 0.1 else "RECUPERANDO" if a * b > 0.3 else "DEGRADANDO"
    rows = []
    for i in range(2400):
        a, b = rng.random(), rng.random()
        rows.append((i, 2000 + i % 10, a if i % 50 else None, b, rng.random(), label(a, b) if rng.random() > 0.05 else "TURNING"))
    df = spark.createDataFrame(rows, "e int, y int, a double, b double, noise double, phase string").cache()
    parts = phase.temporal_split(df, "y")
    train, valid = phase.class_weights(parts.filter("is_train"), "phase"), parts.filter("NOT is_train")
    pred, importances = phase.phase_classifier(train, valid, df, ["a", "b", "noise"], "phase", rate=0.3, rounds=40, patience=3)
    forest, _ = phase.forest_classifier(train, df, ["a", "b", "noise"], "phase")
    f1 = lambda p: phase.class_report(p.join(valid.select("e"), "e"), "phase", "predicted_phase").first()["f1_macro"]
    rows = pred.collect()
    assert all(r["prob_degradando"] + r["prob_turning"] + r["prob_recuperando"] == pytest.approx(1.0) for r in rows)
    assert 0 < rows[0]["n_rounds"] < 40
    assert f1(pred) > f1(forest)
    assert min(importances["a"], importances["b"]) > importances["noise"] and sum(importances.values()) == pytest.approx(1.0)


def test_classifier_missing_feature_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2000, 0.5, "TURNING"), (2, 2001, None, None)], "e int, y int, x double, phase string")
    with pytest.raises(ValueError):
        phase.phase_classifier(df, None, df, ["nope"], "phase", weight=None)
    pred, _ = phase.phase_classifier(df.limit(0), None, df, ["x", "nope"], "phase", weight=None, optional=["nope"])
    assert [r["confidence"] for r in pred.collect()] == pytest.approx([1 / 3, 1 / 3]) and pred.first()["n_rounds"] == 0


def test_stored_margins_do_not_change_the_trees(spark, monkeypatch):
    from panelforge.operators.models import boosting

    rng = random.Random(1)
    df = spark.createDataFrame([(float(i % 7), rng.random(), (i * i) % 3) for i in range(400)], "a double, b double, y int")
    fit = lambda: boosting.boost(df, ["a", "b"], "y", 3, rounds=5, depth=2, gain=0.0)
    plain = fit()
    monkeypatch.setattr(boosting, "KEEP", 2)
    cut = fit()
    score = lambda m: [x for r in df.select(m.probabilities(df).alias("p")).collect() for x in r.p]
    assert score(cut) == pytest.approx(score(plain)) and cut.best == plain.best == 5


def test_short_series_are_left_out_and_bounds_bracket(spark):
    rows = [(1, 2000 + i // 12, i % 12 + 1, 10 + 0.1 * i + math.sin(i / 12 * 2 * math.pi)) for i in range(60)] + [(2, 2000, 1, 1.0)]
    s = forecast.series(spark.createDataFrame(rows, "e int, y int, m int, v double"), "e", "y", "m", "v")
    fit = forecast.fit_seasonal(s, "e")
    out = forecast.forecast(fit, "e").collect()
    assert {r["e"] for r in out} == {1} and sorted(r["horizon_years"] for r in out) == [1, 3, 5, 10]
    assert all(r["lower"] < r["forecast"] < r["upper"] for r in out)
    assert one(forecast.turning_year(forecast.future(fit, "e"), "e"))["turning_year"] == 2006
    width = {r["horizon_years"]: r["upper"] - r["lower"] for r in out}
    assert width[1] < width[3] < width[5] < width[10]


def bent_series(spark, noise=0.05):
    """Slope 0.02 a month for five years, then 0.1, with a yearly wave of a fifth; entity 2 never bends, entity 3 has one month."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        wave = 1 + 0.2 * math.sin(2 * math.pi * i / 12)
        rows.append((1, 2000 + i // 12, i % 12 + 1, (10 + 0.02 * i + 0.08 * max(i - 60, 0)) * wave + rng.gauss(0, noise)))
        rows.append((2, 2000 + i // 12, i % 12 + 1, (10 + 0.02 * i) * wave + rng.gauss(0, noise)))
    rows.append((3, 2001, 5, 4.0))
    df = spark.createDataFrame(rows, "e int, y int, m int, v double")
    return forecast.series(df, "e", "y", "m", "v", min_len=1)


def test_changepoints_are_found_and_sparse(spark):
    fit = forecast.fit_changepoints(bent_series(spark), "e")
    model = {r["e"]: r["m"] for r in fit.collect()}
    turn = sum(s * abs(d) for s, d in zip(model[1]["knots"], model[1]["deltas"])) / sum(map(abs, model[1]["deltas"]))
    assert turn == pytest.approx(60 / 119, abs=0.06)
    assert sum(map(abs, model[2]["deltas"])) < 0.2 * sum(map(abs, model[1]["deltas"]))
    largest = max(map(abs, model[1]["deltas"]))
    assert sum(abs(d) > 0.05 * largest for d in model[1]["deltas"]) < 8  # the bend is told by a few of the 25 candidates
    error = forecast.components(fit, "e").groupBy("e").agg(F.avg(F.abs(F.col("y") - F.col("fitted"))).alias("a")).collect()
    assert all(r["a"] < 0.1 for r in error)
    ahead = {(r["e"], r["horizon_years"]): r for r in forecast.forecast(fit, "e", ahead=forecast.changepoint_future).collect()}
    assert ahead[1, 1]["forecast"] == pytest.approx((10 + 0.02 * 131 + 0.08 * 71) * (1 + 0.2 * math.sin(2 * math.pi * 131 / 12)), rel=0.03)
    width = lambda e, h: ahead[e, h]["upper"] - ahead[e, h]["lower"]
    assert width(1, 1) < width(1, 3) < width(1, 5) < width(1, 10) and width(2, 1) < width(2, 10)
    assert width(1, 10) > 2 * width(2, 10)  # a slope that changed more may change more
    assert ahead[3, 1]["forecast"] == pytest.approx(4.0, rel=0.02)


def test_changepoints_do_not_depend_on_who_is_fitted_beside(spark):
    s = bent_series(spark)
    alone, beside = ({(r["e"], r["ds"]): r["fitted"] for r in forecast.components(forecast.fit_changepoints(s, "e", together=n), "e").collect()} for n in (1, 256))
    assert alone.keys() == beside.keys() and all(alone[k] == pytest.approx(beside[k], abs=2e-2) for k in alone)


def test_panel_with_staggered_entry_settles(spark):
    import random

    r, rows = random.Random(6), []
    for e in range(40):
        effect = r.gauss(0, 3)
        for t in range(e, 60 if e % 2 else e + 12):
            x = r.gauss(0, 1) + 0.3 * t + effect
            rows.append((1, e, t, 2.0 * x + 0.5 * x * x + effect + 0.1 * t, x))
    fit, _ = panel.panel_fe(spark.createDataFrame(rows, "g int, e int, t int, y double, x double"), "e", "t", "y", "x", "g")
    got = fit.first()
    assert abs(got["beta1"] - 2.0) < 1e-4 and abs(got["beta2"] - 0.5) < 1e-5


def test_environmental_fact_reports_unknown_cities(spark):
    from pyspark.sql import Observation

    from panelforge.plans.facts import environmental_fact

    base = spark.createDataFrame([("a", 2000, 1, 0.5), ("b", 2000, 1, 0.7), ("zz", 2000, 1, 0.6)], "city_code string, year int, month int, ndvi_mean double")
    cities = spark.createDataFrame([("a", 1), ("b", 2)], "city_code string, city_sk int")
    seen = Observation("unknown")
    plain = environmental_fact(base, cities, store=lambda d: d)
    told = environmental_fact(base, cities, store=lambda d: d, unmatched=seen)
    assert sorted(told.select(*plain.columns).collect()) == sorted(plain.collect())
    assert seen.get == {"n_dropped": 1}


def test_median_composite_and_keyed_median_fill(spark):
    from panelforge.operators import geo

    px = spark.createDataFrame([("z", 1, 1, 1.0), ("z", 1, 1, 2.0), ("z", 1, 2, 5.0), ("z", 1, 2, None), ("z", 1, 3, None)], "zone string, year int, pixel int, v double")
    row = geo.median_composite(px, ["zone"], ["year"], "pixel", "v").first()
    assert (row.zonal_mean, row.n_pixels) == (3.25, 2)
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("a", None, 4.0), ("b", None, None)], "g string, x double, y double")
    got = sorted(map(tuple, imputation.impute_median(df, ["x", "y"], ["g"]).collect()))
    assert got == [("a", 1.0, 4.0), ("a", 2.0, 4.0), ("a", 3.0, 4.0), ("b", 0.0, 0.0)]


# ---- tables in parts ---------------------------------------------------------------------

def test_bucket_table_rewrites_what_changes(spark, tmp_path):
    from panelforge.operators.bucketed import BucketTable, bucket_of
    from panelforge.streaming import storage

    target = spark.createDataFrame([(i, f"v{i}", 0) for i in range(200)] + [(None, "null key", 0)], "k long, v string, n int")
    table = BucketTable.create(target, f"{tmp_path}/t", ["k"], 16)
    first = table.folders()
    assert sorted(map(str, table.read().collect())) == sorted(map(str, target.collect()))
    new = spark.createDataFrame([(3, "new", 1), (500, "added", 1), (7, "v7", 9)], "k long, v string, n int")
    want = {r[0]: r[1] for r in new.select("k", bucket_of(["k"], 16)).collect()}
    changed = table.upsert(new, ["v"])
    assert set(changed) == {want[3], want[500]}  # 7 brings what is there
    after = BucketTable(spark, f"{tmp_path}/t")
    assert after.manifest["version"] == 2 and {b for b, f in after.folders().items() if first.get(b) != f} == set(changed)
    rows = {r.k: (r.v, r.n) for r in after.read().collect()}
    assert len(rows) == 202 and rows[3] == ("new", 0) and rows[500] == ("added", 1) and rows[7] == ("v7", 0)
    assert after.upsert(new, ["v"]) == [] and after.manifest["version"] == 2
    assert after.upsert(new.limit(0), ["v"]) == []
    with pytest.raises(Exception):  # a second run from the first manifest
        table._latest = None
        BucketTable(spark, f"{tmp_path}/t", table.manifest | {"version": 1})._commit({})
    with pytest.raises(Exception):
        BucketTable.create(target, f"{tmp_path}/t", ["k"], 16)
    storage.create_text(spark, f"{tmp_path}/t/manifest/{9:012d}.json", '{"version": 9')  # cut off
    assert BucketTable(spark, f"{tmp_path}/t").manifest["version"] == 2
    assert after.vacuum() >= 0 and after.read().count() == 202
    empty = BucketTable.create(target.limit(0), f"{tmp_path}/e", ["k"], 4)
    assert empty.read().count() == 0 and len(empty.upsert(new, ["v"])) > 0 and empty.read().count() == 3


def test_bucketed_history_numbers_on(spark, tmp_path):
    from panelforge.operators import dimensional
    from panelforge.operators.bucketed import BucketTable

    dim = spark.createDataFrame([(i + 1, f"t{i}", "a") for i in range(30)], "sk long, ticker string, sector string").withColumns({
        "valid_from": F.lit("2010-01-01").cast("date"), "valid_to": F.lit("9999-12-31").cast("date"), "is_current": F.lit(True)})
    snap = spark.createDataFrame([(f"t{i}", "b" if i in (3, 8) else "a") for i in range(32)], "ticker string, sector string")
    table = BucketTable.create(dim, f"{tmp_path}/h", ["ticker"], 8, "sk")
    n = len(table.merge_versions(snap, ["sector"], "2024-05-01"))
    assert 0 < n <= 4
    plain = dimensional.scd2_merge(dim, snap, "ticker", ["sector"], "2024-05-01")
    assert sorted(map(tuple, table.read().select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert table.merge_versions(snap, ["sector"], "2024-05-01") == []
    table.merge_versions(snap.withColumn("sector", F.lit("c")).filter("ticker = 't1'"), ["sector"], "2024-06-01")
    assert table.read().agg(F.max("sk")).first()[0] == 35


def test_serving_reads_one_month_of_the_maintained_table(spark, folder):
    import io
    from contextlib import redirect_stdout

    from panelforge.queries.serving import last_month
    from panelforge.queries.tables import Tables

    table = Tables(spark, folder).maintained()
    for name in ("gold", "ranked"):
        out = io.StringIO()
        with redirect_stdout(out):
            last_month(table, name).explain("formatted")
        filters = [line for line in out.getvalue().splitlines() if line.startswith("PartitionFilters")]
        assert any("year" in f and "month" in f for f in filters), filters
    version = table.manifest["version"]
    assert Tables(spark, folder).maintained().manifest["version"] == version  # no raw file changed: no refresh


def test_refresh_equals_a_fresh_build(spark, folder, tmp_path):
    from panelforge.plans.maintained import MaintainedGold
    from panelforge.queries.tables import Tables

    t = Tables(spark, folder)
    silver = t.silver()
    month = (F.col("year") == 1996) & (F.col("month") == 5)
    gone = (F.col("year") == 1997) & (F.col("month") == 2)
    new = silver | {"panel": silver["panel"].withColumn("veg", F.when(month, F.col("veg") * 3).otherwise(F.col("veg"))).filter(~gone)}
    kept = MaintainedGold(spark, f"{tmp_path}/a")
    kept.refresh(silver, lambda m: t.gold_parts(silver, m), t.levels())
    months = kept.refresh(new, lambda m: t.gold_parts(new, m), t.levels())
    assert months and all(m == 5 and y >= 1996 or m == 2 and y > 1997 for y, m in months)
    fresh = MaintainedGold(spark, f"{tmp_path}/b")
    fresh.refresh(new, lambda m: t.gold_parts(new, m), t.levels())
    for name in ("gold", "ranked"):
        a, b = getattr(kept, name)(), getattr(fresh, name)()
        shown = [F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in sorted(b.dtypes)]
        assert sorted(map(str, a.select(*shown).collect())) == sorted(map(str, b.select(*shown).collect()))


def test_nearest_site_in_a_dense_cell_meets_few(spark):
    from pyspark.sql import Observation

    sites = spark.range(100_000).select(
        F.lit("g").alias("g"), F.col("id").alias("site"), (40 + (F.col("id") % 317) / 317000).alias("lat"), (2 + (F.col("id") % 331) / 331000).alias("lon"))
    sites = sites.unionByName(spark.createDataFrame([("g", -1, 41.0, 3.0), ("g", -2, 10.0, 179.99), ("h", -3, 40.0, 2.0)], "g string, site long, lat double, lon double"))
    points = spark.createDataFrame([(1, "g", 40.0005, 2.0005), (2, "g", 40.3, 2.2), (3, "g", 40.99, 2.99), (4, "g", 10.0, -179.99), (5, "g", -60.0, 0.0), (6, "h", 40.1, 2.0), (7, "x", 40.0, 2.0)],
                                   "point int, g string, lat double, lon double")
    seen = Observation("pairs")
    got = {r["point"]: (r["site"], round(r["distance_km"], 9)) for r in joins.nearest_within(points, sites, "g", 60.0, compared=seen).collect()}
    from panelforge.functions.scalars import haversine_km

    d = haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    near = points.join(sites.select("g", "site", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "g").withColumn("d", d).filter("d <= 60")
    want = {r["point"]: (r["b"]["site"], round(r["b"]["d"], 9)) for r in near.groupBy("point").agg(F.min(F.struct("d", "site")).alias("b")).collect()}
    assert got == want and set(got) == {1, 2, 3, 4, 6}
    assert seen.get["n_pairs"] < 400


@pytest.mark.parametrize("share", [2, 1000])
def test_versions_at_a_date(spark, share):
    import datetime as dt

    day = dt.date
    fact = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}", day(2020, 1 + i % 12, 1 + i % 28)) for i in range(200)] + [(900, None, day(2020, 1, 1)), (901, "hot", None)],
                                 "i int, k string, d date")
    dim = spark.createDataFrame([("hot", "a", day(2019, 1, 1), day(2020, 3, 15)), ("hot", "b", day(2020, 3, 1), day(2020, 8, 31)), ("hot", "c", day(2020, 6, 1), None), ("hot", "z", None, day(2020, 1, 10)),
                                 ("hot", "never", day(2031, 1, 1), None), ("k0", "o", None, None), ("k2", "p", day(2020, 2, 1), day(2020, 2, 1))], "k string, v string, valid_from date, valid_to date")
    got = sorted((r["i"], r["v"] or "") for r in joins.join_valid_at(fact, dim, ["k"], "d", share=share).collect())
    versions = [tuple(r) for r in dim.collect()]
    want = []
    for i, k, d in [tuple(r) for r in fact.collect()]:
        hits = [v for key, v, lo, hi in versions if key == k and d is not None and (lo is None or d >= lo) and (hi is None or d <= hi)]
        want += [(i, v) for v in hits or [""]]
    assert got == sorted(want)
