"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Each document gets counts, and from them a vector of transformed statistics. For every (language, source) the minimum
covariance determinant is sought by concentration steps: distances to the current centre, the ``support`` nearest
rows, their mean and covariance, and so on while the determinant falls. A step is one aggregation: rows are summed per
(group, distance bin), so a group of any size costs the same few hundred rows after the map side; a group's nearest rows are
rounded up to whole bins. The start is the coordinate-wise median with quartile spreads. Every row takes part in every
step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..streaming.storage import stored
from .batches import small_batches

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SKIP = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"
#: Smallest standard deviation of each statistic that counts as spread, in transformed units.
FLOORS = {"length": 0.5, "word_size": 0.05, "symbols": 0.35, "dup_lines": 0.5, "repeats": 0.12}
#: Rows of one group are dealt over so many join keys.
SALTS = 64
#: Distance bins per unit of ln(1 + squared distance), and their number.
FINE, BINS = 64, 1024


def count_text(raw: bytes | None) -> dict[str, int]:
    """The counts of one text. Words are runs without ASCII white space, characters are code points; null is empty."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        first: dict[tuple, int] = {}
        marks = bytearray(n)
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            j = first.setdefault(window, i)
            if j != i:
                marks[i:i + 3] = marks[j:j + 3] = b"\1\1\1"
        repeated = marks.count(1)
    return {
        "n_words": n, "word_chars": len(raw.translate(None, _SKIP)), "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated,
    }


def text_counts(text: Column) -> Column:
    """Struct of the five counts of a text column."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    arrow = pa.struct([(c, pa.int64()) for c in COUNTS])

    @F.arrow_udf(kind)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([count_text(x) for x in batch.to_pylist()], arrow)

    return counted(text.cast("binary"))


def base_failed(c: Column) -> Column:
    """Too few words, or too many of them in repeated three-word windows."""
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def statistics(c: Column) -> dict[str, Column]:
    """The transformed statistics of a row of counts, each on a grid of 1/256; null without words."""
    n, chars = (F.nullif(c[k], F.lit(0)).cast("double") for k in ("n_words", "word_chars"))
    raw = {
        "length": F.log(n), "word_size": F.log(chars / n), "symbols": F.log1p(100 * c["n_symbols"] / chars),
        "dup_lines": F.log1p(c["n_dup_lines"]), "repeats": F.sqrt(c["n_repeat_words"] / n),
    }
    return {k: F.round(v * 256) / 256 for k, v in raw.items()}


def chi_square_cdf(x: float, p: int) -> float:
    a, x = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, p) < q else (low, mid)
    return high


def _fit(names: list[str], scale: float):
    """Group moments (count, sums, sums of products) to centre, inverse scatter and log determinant."""
    import numpy as np

    p = len(names)
    floor = np.diag([FLOORS[k] ** 2 for k in names])

    def fit(frames):
        for f in frames:
            n = f["n"].to_numpy(float)
            s = f[[f"s{i}" for i in range(p)]].to_numpy(float)
            centre = s / n[:, None]
            cov = np.zeros((len(f), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = f[f"s{i}_{j}"].to_numpy(float) / n - centre[:, i] * centre[:, j]
            cov = scale * cov + floor
            inverse = np.linalg.inv(cov)
            out = f[["_g"]].copy()
            for i in range(p):
                out[f"c{i}"] = centre[:, i]
                for j in range(i, p):
                    out[f"p{i}_{j}"] = inverse[:, i, j]
            out["log_det"] = np.linalg.slogdet(cov)[1]
            yield out

    return fit


def _start(names: list[str]):
    """Medians, and quartile spreads as independent scales."""
    import numpy as np

    def fit(frames):
        for f in frames:
            out = f[["_g"]].copy()
            det = 0.0
            for i, k in enumerate(names):
                q = np.array(f[f"q{i}"].tolist(), float).reshape(-1, 3)
                var = ((q[:, 2] - q[:, 0]) / 1.349) ** 2 + FLOORS[k] ** 2
                out[f"c{i}"] = q[:, 1]
                for j in range(i, len(names)):
                    out[f"p{i}_{j}"] = 1 / var if i == j else 0.0
                det = det + np.log(var)
            out["log_det"] = np.inf
            yield out

    return fit


def _distance(names: list[str]) -> Column:
    p = len(names)
    d = [F.col(k) - F.col(f"c{i}") for i, k in enumerate(names)]
    parts = [(1 if i == j else 2) * F.col(f"p{i}_{j}") * d[i] * d[j] for i in range(p) for j in range(i, p)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return F.greatest(total, F.lit(0.0))


def _beside(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with their group's estimate: an equi-join on (group, salt), so that a large group is many keys."""
    dealt = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(dealt, ["_g", "_salt"], "left")


def robust_estimates(rows: DataFrame, names: list[str], support: float = 0.75, tolerance: float = 1e-3) -> DataFrame:
    """Centre and inverse scatter of each group ``_g`` of ``rows`` (columns ``_g``, ``_salt`` and the statistics).

    The determinant of a group falls with every step that is taken, and a group whose determinant falls by less than
    ``tolerance`` (log units) keeps its last estimate; the loop ends when no group moves. The scatter has ``FLOORS`` added, so
    constant statistics are allowed.
    """
    p = len(names)
    q = chi_square_quantile(support, p)
    scale = support / chi_square_cdf(q, p + 2)
    shape = "_g string, " + ", ".join(
        [f"c{i} double" for i in range(p)] + [f"p{i}_{j} double" for i in range(p) for j in range(i, p)]) + ", log_det double"
    quartiles = rows.groupBy("_g").agg(*[F.percentile(k, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, k in enumerate(names)])
    now = stored(quartiles.mapInPandas(_start(names), shape), "mcd")
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(k).alias(f"s{i}") for i, k in enumerate(names)] + [
        F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    moving = True
    while moving:
        at = F.least(F.floor(F.log1p(_distance(names)) * FINE), F.lit(BINS - 1))
        binned = _beside(rows, now.drop("log_det")).groupBy("_g", at.alias("_bin")).agg(*sums)
        whole, before = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy("_bin")
        near = binned.withColumns({"_all": F.sum("n").over(whole), "_upto": F.sum("n").over(before)}).filter(
            F.col("_upto") - F.col("n") < support * F.col("_all"))
        new = near.groupBy("_g").agg(*[F.sum(c).alias(c) for c in binned.columns if c not in ("_g", "_bin")]).mapInPandas(
            _fit(names, scale), shape)
        old = now.select("_g", *[F.col(c).alias(f"_{c}") for c in now.columns if c != "_g"])
        better = F.col("log_det") < F.col("_log_det") - tolerance
        now = stored(new.join(old, "_g").select(
            "_g", *[F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in now.columns if c != "_g"],
            better.alias("moved")), "mcd")
        moving = now.agg(F.max("moved")).first()[0] or False
        now = now.drop("moved")
    return now


def _drawn(names: list[str], weight: float):
    """Rows with a group's, its language's and the whole table's estimate (prefixes o, l, a) and row counts to the group's own, drawn towards them."""
    import numpy as np

    p = len(names)

    def part(f, prefix):
        centre = f[[f"{prefix}c{i}" for i in range(p)]].to_numpy(float)
        inverse = np.zeros((len(f), p, p))
        for i in range(p):
            for j in range(i, p):
                inverse[:, i, j] = inverse[:, j, i] = f[f"{prefix}p{i}_{j}"].to_numpy(float)
        return centre, np.linalg.inv(inverse)

    def mixed(near, far, n):
        w = n / (n + weight)
        return w[:, None] * near[0] + (1 - w)[:, None] * far[0], w[:, None, None] * near[1] + (1 - w)[:, None, None] * far[1]

    def run(frames):
        for f in frames:
            language = mixed(part(f, "l"), part(f, "a"), f["n_language"].to_numpy(float))
            centre, scatter = mixed(part(f, "o"), language, f["n_own"].to_numpy(float))
            inverse = np.linalg.inv(scatter) if len(f) else scatter
            out = f[["_own"]].copy()
            for i in range(p):
                out[f"c{i}"] = centre[:, i]
                for j in range(i, p):
                    out[f"p{i}_{j}"] = inverse[:, i, j]
            yield out

    return run


def group_estimates(good: DataFrame, names: list[str], support: float, weight: float) -> DataFrame:
    """(_own, centre, inverse scatter) of each group of ``good`` (columns ``_own``, ``_pool``, ``_salt`` and the statistics)."""
    sizes = good.groupBy("_own", "_pool").agg(F.count(F.lit(1)).alias("n_own"))
    named = stored(sizes.join(sizes.groupBy("_pool").agg(F.sum("n_own").alias("n_language")), "_pool"), "groups")
    rows = good.withColumn("_g", F.explode(F.array("_own", "_pool", F.lit("all")))).select("_g", "_salt", *names)
    found = stored(robust_estimates(stored(rows, "statistics"), names, support).drop("log_det"), "estimates")
    figures = [c for c in found.columns if c != "_g"]
    side = lambda prefix, on: found.select(F.col("_g").alias(on), *[F.col(c).alias(f"{prefix}{c}") for c in figures])
    wide = named.withColumn("_all", F.lit("all")).join(side("o", "_own"), "_own").join(side("l", "_pool"), "_pool").join(side("a", "_all"), "_all")
    return wide.mapInPandas(_drawn(names, weight), "_own string, " + ", ".join(f"{c} double" for c in figures))


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", support: float = 0.75,
           quantile: float = 0.9999999, weight: float = 50.0) -> DataFrame:
    """``docs`` with one struct column ``quality``: the five counts, ``base_failed``, ``distance`` and ``kept``.

    A row is kept if it passes the base rules and its squared robust distance is at most the chi-square ``quantile``. The
    estimate of a (language, source) of n passing rows counts n to ``weight`` against that of its language, which counts
    likewise against that of all rows; each passing row has a distance. Null texts are empty and fail; texts may be of any length; null
    languages and sources are groups of their own; repeated rows count each time; an empty table gives an empty table. All
    columns stay; only the name ``quality`` is replaced.
    """
    c = F.col("_row.counts")
    wide = docs.select(F.struct(*[docs[k] for k in docs.columns]).alias("_doc"), F.struct(
        text_counts(docs[text]).alias("counts"), F.concat(F.lit("source "), F.to_json(F.struct(docs[lang].alias("l"), docs[source].alias("s")))).alias("own"),
        F.concat(F.lit("language "), F.to_json(F.struct(docs[lang].alias("l")))).alias("pool")).alias("_row"))
    with small_batches(docs.sparkSession):
        wide = stored(wide.withColumn("_failed", base_failed(c)).withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int")), "quality")
    names = list(FLOORS)
    x = statistics(c)
    good = wide.filter(~F.col("_failed")).select(F.col("_row.own").alias("_own"), F.col("_row.pool").alias("_pool"), "_salt", *[
        v.alias(k) for k, v in x.items()])
    estimates = stored(group_estimates(good, names, support, weight), "estimates")
    limit = chi_square_quantile(quantile, len(names))
    judged = wide.withColumns(x | {"_own": F.col("_row.own")}).join(
        estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_own", "_salt"], "left")
    far = F.when(~F.col("_failed"), _distance(names))
    kept = ~F.col("_failed") & F.coalesce(far <= limit, F.lit(True))
    return judged.select(
        *[F.col("_doc")[k].alias(k) for k in docs.columns if k != "quality"],
        F.struct(*[c[k].alias(k) for k in COUNTS], F.col("_failed").alias("base_failed"), far.alias("distance"), kept.alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    judged = assess(docs.withColumnRenamed("quality", "_quality"), **options)
    return judged.filter("quality.kept").drop("quality").withColumnRenamed("_quality", "quality").select(*docs.columns)
