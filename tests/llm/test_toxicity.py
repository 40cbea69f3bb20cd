"""Toxicity: features by hand, learned words, held-out accuracy, whole tables in odd shapes."""

import random
import zlib

import pytest

pytest.importorskip("panelforge.llm")
from pyspark.sql import functions as F  # noqa: E402

from panelforge.llm import queries, toxicity  # noqa: E402

SHAPE = "doc_id long, text string, lang string, toxicity string, label int, y int"
PLAIN = [f"{a}{b}" for a in ("mo", "ta", "ri", "len", "so", "pu") for b in ("ka", "der", "lin", "sto", "ve", "gan", "ri")]
BAD = ["zorfa", "zorfen", "zorfik"]


def corpus(n=600, seed=5):
    """A third is labelled toxic: it holds made-up words that share a beginning."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randint(5, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), "en", "x", 1, 2))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, SHAPE).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_features_by_hand():
    known = toxicity.Tokens(frozenset({"=foo", "^abc"}), frozenset({"^wea"}))
    f = dict(zip(toxicity.FEATURES, known.features("You are an IDIOT!! and abcdef, 1d10t  st*pid weary you?")))
    assert f["insults"] == f["strong"] == f["weak"] == pytest.approx(0.1)
    assert f["hidden"] == pytest.approx(0.1) and f["obfuscated"] == pytest.approx(0.2)
    assert f["near_you"] == pytest.approx(0.3) and f["you"] == pytest.approx(0.2)
    assert f["capital_words"] == pytest.approx(0.1) and f["asks"] > 0 and f["exclaims"] == 2 * f["asks"]
    assert known.features(None) == known.features("") == known.features(" \n") == [0.0] * len(toxicity.FEATURES)


def test_tokens_forget_without_a_change(monkeypatch):
    known, texts = toxicity.Tokens(frozenset(), frozenset()), [f"w{i} you idiot w{i}!" for i in range(9000)]
    first = [known.features(t) for t in texts[:50]]
    for t in texts:
        known.features(t)
    known.size = 1 << 25  # forgets before the next text
    assert [known.features(t) for t in texts[:50]] == first and len(known) < 300


def test_learned_terms(spark):
    rows, labels = corpus()
    y = {i: t for i, _, t in labels}
    strong, weak = toxicity.lexicon(spark.createDataFrame([(r[1], y[r[0]]) for r in rows], "text string, y int"), most=50)
    assert {"=zorfa", "^zorf", "^zor"} <= set(strong) and not set(weak) & {f"={w}" for w in PLAIN}


def test_held_out_rows_of_made_up_words(spark):
    rows, labels = corpus()
    docs, given = frames(spark, rows, labels)
    out = toxicity.score(docs, given)
    assert out.columns == ["doc_id", "text", "lang", "label", "y", "toxicity"]
    got = {r.doc_id: r.toxicity for r in out.collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(0 <= s.score <= 1 and s.predicted == (s.score >= 0.7) for s in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs, given = frames(spark, rows, labels)
    turned = frames(spark, rows, [(i, q, 1 - t if toxicity.held_out(i) else t) for i, q, t in labels])[1]
    a, b = ({r.doc_id: r.toxicity.score for r in toxicity.score(docs, x).collect()} for x in (given, turned))
    assert a == b


def test_odd_rows(spark):
    rows, labels = corpus(240)
    odd = [(1000, None, None, None, None, None), (1001, "", "", "", 1, 1), (1002, "zorfa " * 60_000, "en", "x", 1, 1), (None, "zorfa zorfen zorfa", "en", "x", 1, 1)]
    docs, given = frames(spark, rows + odd + rows[:5], labels + labels[:5] + [(1000, 1, None), (None, 1, 1), (2, 0, 1), (5000, 0, 1), (3, 0, 7)])
    got = toxicity.score(docs, given).select("doc_id", "toxicity.*").collect()
    assert len(got) == len(rows) + len(odd) + 5
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[1002].predicted == by[None].predicted == 1
    assert by[1000].score == by[1001].score
    assert len({(r.doc_id, r.score) for r in got if r.doc_id in range(5)}) == 5


def test_empty_tables_and_one_class(spark):
    rows, labels = corpus(60)
    docs, given = frames(spark, rows, labels)
    assert toxicity.score(docs.limit(0), given).count() == 0
    assert {r.s for r in toxicity.score(docs, given.limit(0)).select(F.col("toxicity.score").alias("s")).collect()} == {0.0}
    only = given.filter("toxic = 1")
    assert {r.s for r in toxicity.score(docs, only).select(F.col("toxicity.score").alias("s")).collect()} == {1.0}


def test_query_on_the_given_table(spark, folder):
    got = queries.QUERIES["op11_toxicity"](spark, folder.replace("sf0.001", "sf0.01"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/labels.parquet")
    right = got.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.93
