"""Column -> Column helpers. Everything here stays inside Spark's generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text -----------------------------------------------------------------

def key_token(c, sep: str = "_", pos: int = -1) -> Column:
    """One token of a compound key; the last one by default."""
    return F.try_element_at(F.split(col(c), re.escape(sep)), F.lit(pos))


def to_int(c) -> Column:
    """First run of digits as an integer; NULL where there is none."""
    return F.regexp_extract(col(c).cast("string"), r"(\d+)", 1).try_cast("int")


def to_number(c) -> Column:
    """Number out of a flagged statistical value such as ``34000 p`` or ``:``."""
    return F.regexp_replace(col(c).cast("string"), r"[^0-9.\-]", "").try_cast("double")


def leading_number(c) -> Column:
    """Number in the first blank-separated token."""
    return F.split(F.trim(col(c).cast("string")), r"\s+").getItem(0).try_cast("double")


def to_amount(c, default: float = 0.0) -> Column:
    """Amount with thousands separators; unreadable becomes ``default``."""
    plain = F.regexp_replace(F.trim(col(c).cast("string")), ",", "").try_cast("double")
    return F.coalesce(plain, F.lit(float(default)))


def decimal_comma(c) -> Column:
    return F.regexp_replace(col(c).cast("string"), ",", ".").try_cast("double")


def strip_notes(c) -> Column:
    """Drop parenthesised remarks from a label."""
    return F.trim(F.regexp_replace(col(c), r"\(.*?\)", ""))


def norm_code(c) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def parse_list(c) -> Column:
    """``['A', 'B']`` or ``A, B`` to an array; empty or unreadable gives an empty array."""
    text = F.trim(col(c).cast("string"))
    empty = F.array().cast("array<string>")
    literal = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return (
        F.when(text.isNull() | (text == ""), empty)
        .when(text.startswith("["), F.coalesce(literal, empty))
        .when(text.contains(","), F.split(text, r"\s*,\s*"))
        .otherwise(empty)
    )


def first_token(c, max_len: int = 20) -> Column:
    """First element of a comma list, shortened."""
    return F.substring(F.trim(F.split(col(c), ",").getItem(0)), 1, max_len)


# ---- numbers --------------------------------------------------------------

def finite_or_null(c) -> Column:
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def safe_ratio(num, den, default: float = 0.0) -> Column:
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(float(default)))


def float_ratio(num, den) -> Column:
    """The quotient as floating point numbers have it: by zero it is infinite, or NaN for 0 / 0."""
    x, y = col(num), col(den)
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y != 0, F.try_divide(x, y)).when(y == 0, by_zero)


def guarded_log(c) -> Column:
    return F.when(col(c) > 0, F.log(col(c)))


def guarded_log1p(c) -> Column:
    return F.when(col(c) > 0, F.log1p(col(c)))


def convert(c, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Unit conversion; Kelvin to Celsius is ``convert(c, 1, -273.15)``."""
    return col(c) * F.lit(float(scale)) + F.lit(float(offset))


def default(c, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to a range; NULL stays NULL."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi))))


def stable_round(c, digits: int) -> Column:
    """Rounding of an aggregate that does not depend on the order in which Spark summed it."""
    return F.round(F.round(col(c), digits + 6), digits)


def round_scaled(c, digits: int) -> Column:
    """Rounding of the double that the scaling gives, as SQL databases round doubles: 0.68875 * 60 counts as 41.325, though it is a little less."""
    scale = F.lit(10.0 ** digits)
    return F.round(col(c) * scale) / scale


def exact_mean(c) -> Column:
    """Mean of an aggregate, from a sum of decimals: it does not depend on the order of summation, so a value on a threshold stays on its side."""
    return F.sum(col(c).cast("decimal(38,20)")).cast("double") / F.count(col(c))


def annualise(c, periods: int = 12) -> Column:
    return col(c) * F.sqrt(F.lit(float(periods)))


def norm_diff(a, b, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Normalised difference of two scaled bands, NULL where their sum is zero."""
    x, y = convert(a, scale, offset), convert(b, scale, offset)
    return F.when((x + y) != 0, (x - y) / (x + y))


# ---- periods --------------------------------------------------------------

def date_key(year, month) -> Column:
    return (col(year) * 100 + col(month)).cast("int")


def parse_period(c) -> tuple[Column, Column]:
    """``2020-03``, ``202003`` and ``2020-M03`` to year and month."""
    shape = r"^\s*(\d{4})-?M?(\d{2})\s*$"
    month = F.regexp_extract(col(c), shape, 2).try_cast("int")
    year = F.regexp_extract(col(c), shape, 1).try_cast("int")
    ok = month.between(1, 12)
    return F.when(ok, year), F.when(ok, month)


def parse_quarter(c) -> tuple[Column, Column, Column]:
    """``2020T3`` to year, quarter and a sortable index."""
    label = norm_code(c)
    year = F.regexp_extract(label, r"(\d{4})", 1).try_cast("int")
    quarter = F.regexp_extract(label, r"T(\d)", 1).try_cast("int")
    return year, quarter, year * 10 + quarter


def resolve_year(url, date, lo: int = 2021, hi: int = 2030, default_year: int = 2024) -> Column:
    """Year named in a URL, else the year a date text starts with, else a default."""
    named = F.filter(
        F.transform(F.regexp_extract_all(col(url), F.lit(r"(20\d{2})"), F.lit(1)), lambda y: y.cast("int")),
        lambda y: y.between(lo, hi),
    )
    from_url = F.get(named, F.lit(0))
    from_date = F.regexp_extract(F.trim(col(date).cast("string")), r"^(20\d{2})", 1).try_cast("int")
    return F.coalesce(from_url, from_date, F.lit(default_year))


def parse_any_date(c, formats: list[str]) -> Column:
    """Date in the first layout of ``formats`` that reads it."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)).cast("date") for f in formats])


# ---- places ---------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def mercator_bbox(lat, lon, radius_km: float) -> dict[str, Column]:
    """Square around a point in Web-Mercator metres, whole metres toward zero."""
    x = F.radians(col(lon)) * MERCATOR_M
    y = F.log(F.tan((col(lat) + 90) * F.lit(3.141592653589793 / 360.0))) * MERCATOR_M
    r = F.lit(float(radius_km) * 1000)
    inside = F.abs(col(lat)) <= 85.051129
    return {
        name: F.when(inside, edge).cast("long")
        for name, edge in {"xmin": x - r, "ymin": y - r, "xmax": x + r, "ymax": y + r}.items()
    }


# ---- rules ----------------------------------------------------------------

def ladder(pairs, otherwise) -> Column:
    """First label whose condition holds."""
    chain = reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), pairs[1:], F.when(pairs[0][0], F.lit(pairs[0][1])))
    return chain.otherwise(F.lit(otherwise) if otherwise is not None else None)


def recommend(score, cuts=fv.SCORE_CUTS, floor=fv.SCORE_FLOOR) -> Column:
    return ladder([(col(score) >= at, label) for at, label in cuts], floor)


def bin_slope(c, threshold: float = 0.005) -> Column:
    """Three phases by slope; the upper edge of a bin belongs to it."""
    s = col(c)
    return F.when(s.isNull(), None).otherwise(
        ladder([(s <= -threshold, fv.DEGRADING), (s <= threshold, fv.TURNING)], fv.RECOVERING)
    )


def phase_label(slope, gap, turning_point, tol: float = 0.15, min_slope: float = 0.003) -> Column:
    """Turning when close to the turning point, recovering past it with a rising slope."""
    near = (col(turning_point) > 0) & (F.abs(col(gap)) <= col(turning_point) * tol)
    rising = (F.coalesce(col(slope), F.lit(0.0)) > min_slope) & (col(gap) > 0)
    return ladder([(near, fv.TURNING), (rising, fv.RECOVERING)], fv.DEGRADING)


def phase_score(green, confidence, phase) -> Column:
    reward = ladder([(col(phase) == p, v) for p, v in fv.PHASE_REWARD.items()], 0.0)
    return stable_round(F.coalesce(col(green), F.lit(0.0)) * 50 + F.coalesce(col(confidence), F.lit(0.5)) * 30 + reward, 2)


def composite_score(green, renewables, air, carbon) -> Column:
    """0-100 score of vegetation, renewables, air quality and carbon price."""
    w = fv.SCORE_WEIGHTS
    dirty = F.greatest(F.coalesce(col(air), F.lit(fv.AIR_DEFAULT)), F.lit(0.0))
    price = F.greatest(F.coalesce(col(carbon), F.lit(0.0)), F.lit(0.0))
    total = (
        F.coalesce(col(green), F.lit(0.0)) * w["green"]
        + F.coalesce(col(renewables), F.lit(0.0)) / 100.0 * w["renewables"]
        + clip(w["air"] - dirty / fv.AIR_WORST * w["air"], 0, w["air"])
        + clip(price / fv.CARBON_FULL * w["carbon"], 0, w["carbon"])
    )
    return round_scaled(clip(total, 0, 100), 2)


def valid_from(c, year, start: int) -> Column:
    """Value only from the year its market exists."""
    return F.when(col(year) >= start, col(c))


def missing_reason(c, year, start: int = fv.CARBON_MARKET_START) -> Column:
    return F.when(col(c).isNull(), F.when(col(year) < start, F.lit("NO_MARKET")).otherwise(F.lit("MISSING")))


def pick_sensor(year, breaks: list[tuple[int, str]], last: str) -> Column:
    """Sensor in charge of a year: the first whose end year lies after it."""
    return ladder([(col(year) < end, name) for end, name in breaks], last)
