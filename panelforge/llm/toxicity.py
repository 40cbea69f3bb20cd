"""Toxicity: gradient-boosted trees over dense features, calibrated by an isotonic curve.

A text becomes a few numbers: how dense it is in words of a fixed list and of lists learned from the labelled rows, how many of them stand
near a second person, shares of capitals and punctuation, words written around filters. Learned lists hold words and beginnings
of words that stand in far more toxic rows than clean ones. One pass computes the features of every text; boosted trees and the
isotonic curve are fitted on rows with labels, apart from each other, and score every row inside the JVM.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..streaming.storage import stored

#: Common insults of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns worthless pathetic disgusting ugly "
    "imbecile fool jerk bastard bitch asshole dumbass filth vermin retard freak "
    "idioten dumm dummkopf blöd blödmann trottel depp arschloch abschaum schwachkopf widerlich erbärmlich wertlos versager mistkerl "
    "idiote imbécile crétin connard salaud débile abruti minable dégoûtant pourriture ordure raté "
    "idiota estúpido estúpida imbécil tonto tonta inútil basura escoria payaso asqueroso patético maldito cabrón gilipollas".split())
#: Words that address the reader.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinem deinen euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
STEMS = (3, 4, 5, 6)
FEATURES = ("insults", "strong", "weak", "n_strong", "near_you", "you", "capital_words", "capitals", "exclaims", "asks", "marks", "obfuscated", "hidden", "length")
_HIT, _YOU = 8, 9  # columns of a token's row
_REACH = 5


def terms(text: str | None) -> set[str]:
    """Words of a text as ``=word`` and the beginnings of them as ``^beginning``."""
    words = {w for w in map(_bare, (text or "").split()) if w}
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in STEMS if len(w) >= n}


def _bare(token: str) -> str:
    """Lower case, without what is no letter at either end."""
    w = token.lower()
    if w.isalpha():
        return w
    i, j = 0, len(w)
    while i < j and not w[i].isalpha():
        i += 1
    while j > i and not w[j - 1].isalpha():
        j -= 1
    return w[i:j]


class Tokens(dict):
    """What is known of each token: its row in ``table``. Forgets all when it holds too much."""

    def __init__(self, strong: frozenset, weak: frozenset):
        super().__init__()
        self.strong, self.weak = strong, weak
        self.table, self.size = np.zeros((1 << 12, 14), np.float64), 0

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.describe(token)
        self[token] = n
        self.size += len(token)
        return n

    def among(self, word: str, known: frozenset) -> bool:
        return f"={word}" in known or any(f"^{word[:n]}" in known for n in STEMS if len(word) >= n)

    def describe(self, token: str) -> list[float]:
        word = _bare(token)
        inner = any(not c.isalpha() and c not in "'’-" for c in word)
        letters = sum(c.isalpha() for c in token)
        upper = sum(c.isupper() for c in token)
        insult, strong = word in INSULTS, self.among(word, self.strong)
        hidden = False
        if not (insult or strong):
            meant = "".join(c for c in token.lower().translate(LEET) if c.isalpha())
            hidden = meant != word and (meant in INSULTS or f"={meant}" in self.strong)
        return [insult, strong, self.among(word, self.weak), upper > 1 and upper == letters, letters, upper, token.count("!"), token.count("?"),
                insult or strong or hidden, word in YOU, len(token) - letters, inner, hidden, len(token)]

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        if len(self) > 1 << 18 or self.size > 1 << 24:
            self.clear()
            self.size = 0
        if words:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            hits = np.flatnonzero(self.table[at, _HIT])
            total = np.zeros(14)
            for i in range(0, len(at), 1 << 14):
                total += self.table[at[i:i + (1 << 14)]].sum(axis=0)
            near = 0
            if len(hits) and total[_YOU]:
                you = np.flatnonzero(self.table[at, _YOU])
                left = np.searchsorted(you, hits - _REACH)
                near = int((np.searchsorted(you, hits + _REACH, "right") > left).sum())
        else:
            total, near = np.zeros(14), 0
        n, letters, chars = max(1, len(words)), max(1.0, total[4]), max(1.0, total[13])
        return [total[0] / n, total[1] / n, total[2] / n, np.log1p(total[1]), near / n, total[_YOU] / n, total[3] / n, total[5] / letters,
                total[6] / chars, total[7] / chars, total[10] / chars, total[11] / n, total[12] / n, np.log1p(len(words))]


def features_of(text: Column, strong: list[str], weak: list[str]) -> Column:
    """Array of ``FEATURES``; null is empty text."""
    strong_set, weak_set = frozenset(strong), frozenset(weak)

    @F.arrow_udf("array<double>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Tokens(strong_set, weak_set)
        for batch in batches:
            yield pa.array([known.features(x.as_py()) for x in batch], pa.list_(pa.float64()))

    return made(text)


def bucket(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; a null key is empty text. 1 is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def _contrast(most: int):
    """(text, y) rows to (term, toxic, clean): rows of each class that hold a term, summed within a task."""

    def flush(held):
        names = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([held[y][t] for t in names], pa.int64()) for y in (1, 0)]],
                                          ["term", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                held[y].update(terms(text.as_py()))
                if len(held[0]) + len(held[1]) > most:
                    yield flush(held)
                    held = (Counter(), Counter())
        yield flush(held)

    return run


def lexicon(rows: DataFrame, size: int = 256, most: int = 300_000) -> tuple[list[str], list[str]]:
    """Strong and weak terms of labelled ``rows`` (text, y): the ``size`` terms whose share of toxic rows stands out most.

    A term counts if its shares differ by four standard errors; it is strong from odds of 30 to 1 on, weak from 5 to 1.
    """
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return [], []
    a, b = F.col("toxic"), F.col("clean")
    share = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n1 + 1 / n0))
    odds = ((a + 0.5) / (n1 - a + 0.5)) / ((b + 0.5) / (n0 - b + 0.5))
    counted = rows.select("text", "y").mapInArrow(_contrast(most), "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counted.select("term", z.alias("z"), odds.alias("odds")).filter("z >= 4 and odds >= 5").orderBy(F.desc("z"), "term").limit(size).collect()
    return [r.term for r in found if r.odds >= 30], [r.term for r in found if r.odds < 30]


def _labelled(labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """(_key, y) of at most ``sample`` rows to learn from, the ones of least hash; contradictory, null and held-out ones are left out."""
    known = labels.select(labels[key].alias("_key"), labels[label].cast("int").alias("y")).filter("_key is not null and y in (0, 1)")
    known = known.filter(bucket(F.col("_key")) != 1).groupBy("_key").agg(F.min("y").alias("y"), F.max("y").alias("_most")).filter("y = _most").drop("_most")
    return stored(known.orderBy(F.xxhash64("_key"), "_key").limit(sample), "labelled")


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = 20_000,
          threshold: float = 0.7, rounds: int = 30, depth: int = 3, seed: int = 11) -> DataFrame:
    """``docs`` with one struct column ``toxicity``: ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learned from at most ``sample`` labelled rows whose key's crc32 modulo 3 is not 1; a quarter of them is kept for the isotonic curve.
    Without both classes among the rows to learn from every score is their share of toxic rows (0 without rows); a curve
    needs both classes too, else the trees' probability stands. Null texts are empty; a null key has no label and is not held out; repeated
    rows score alike, and each counts in learning; texts may be of any length; an empty table gives an empty table. All columns of
    ``docs`` stay; only the name ``toxicity`` is replaced.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    kept = [c for c in docs.columns if c != "toxicity"]
    doc = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")

    def out(df, s):
        of = F.col("_doc")
        return df.select(*[of[c].alias(c) for c in kept], F.struct(
            (bucket(of[key]) == 1).alias("held_out"), s.alias("score"), (s >= threshold).cast("int").alias("predicted")).alias("toxicity"))

    known = _labelled(labels, key, label, sample)
    # At most ``sample`` (key, label) rows are broadcast, so no text is shuffled.
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("text")).join(F.broadcast(known), "_key")
    rows = stored(rows.select("text", "y", (F.pmod(F.xxhash64("_key"), F.lit(4)) == 0).alias("last")), "examples")
    fit = rows.filter(~F.col("last"))
    n1, n0 = fit.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return out(docs.select(doc), F.lit(n1 / (n1 + n0) if n1 + n0 else 0.0))
    strong, weak = lexicon(fit)
    learned = stored(rows.select(features_of(F.col("text"), strong, weak).alias("f"), "y", "last"), "features")
    learned = learned.select(array_to_vector("f").alias("x"), F.col("y").cast("double").alias("y"), "last")
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3,
                          seed=seed).fit(learned.filter(~F.col("last")).select("x", "y"))
    toxic = vector_to_array("probability")[1]
    curve = None
    points = stored(trees.transform(learned.filter("last")).select(toxic.alias("p"), "y"), "calibration")
    if points.agg(F.countDistinct("y")).first()[0] == 2:
        curve = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="_s").fit(points)
    marked = docs.select(doc, array_to_vector(features_of(docs[text], strong, weak)).alias("x"))
    marked = trees.transform(marked).withColumn("p", toxic)
    marked = curve.transform(marked) if curve else marked.withColumn("_s", F.col("p"))
    return out(marked, F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0)))


def held_out(key: object) -> bool:
    """The rule of ``bucket`` for one key."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 3 == 1
