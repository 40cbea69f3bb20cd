"""The pipeline against its stages in plain Python: whole rows of a fixture with nulls, empty and long texts, ties and repeats."""

import os
import random
import sys

import pytest

pytest.importorskip("panelforge.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from panelforge.llm import decontaminate, quality  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, quality int, hits string"


def corpus():
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", " \n", "short", "a b c " * 60]
    texts += [prose(r.randint(55, 260)) for _ in range(110)]
    texts += ["\n".join(prose(9) for _ in range(r.randint(7, 20))) for _ in range(15)]
    base = prose(200).split()
    texts += [" ".join("changed" if i % k == 7 else w for i, w in enumerate(base)) for k in (60, 45, 30)] + [" ".join(base)] * 2
    passage = prose(30)
    texts += [f"{prose(40)} {passage} {prose(20)}", f"{prose(40)} {passage.upper()}, {prose(30)}", f"{prose(60)} {' '.join(passage.split()[:9])} {prose(10)}"]
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts += [f'{prose(60)} a.b@host.org, 10.1.2.3 or +1 (499) 555-6503 {prose(9)}', f'{prose(60)} card 4111 1111 1111 1111; token = "{secret}" {prose(5)}', f"é {prose(70)} ñandú 300.1.1.1"]
    texts += [" ".join(w + "###" for w in prose(120).split()), prose(30_000)]
    rows = [(i, t, ["en", "en", "de", None][i % 4], ["s1", "s1", "s1", "s2", None][i % 5], None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    rows += [rows[9], (None, prose(90), "en", "s1", 5, 1, "x"), (None, prose(95), "en", "s1", 6, 1, "x"), (3000, texts[20], "en", "s1", 7, 1, "x"), (40, prose(80), "en", "s1", 8, 1, "x")]
    items = [(-7, passage), (5, "no such words anywhere in it"), (None, "also nowhere"), (6, ""), (8, None)]
    return rows, items


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rows, items = corpus()
    place = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, items


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_quality_verdicts_and_distances(spark, fixture):
    place, rows, _ = fixture
    kept, far = plain.kept_by_quality([(t, lang, source) for _, t, lang, source, *_ in rows])
    want = {(k, t): (a, d) for (k, t, *_), a, d in zip(rows, kept, far)}
    for x in quality.assess(spark.read.parquet(f"{place}/documents.parquet")).collect():
        a, d = want[x.doc_id, x.text]
        assert x.quality.kept == a and (d is None) == (x.quality.distance is None)
        assert d is None or x.quality.distance == pytest.approx(d, rel=1e-3)
    assert 0.85 < sum(kept) / len(kept) < 1


def test_items_with_any_id_are_named(spark, fixture):
    place, rows, items = fixture
    docs = spark.read.parquet(f"{place}/documents.parquet").withColumnRenamed("hits", "other")
    bench = spark.read.parquet(f"{place}/benchmark.parquet")
    plainly, joined = ({(x.doc_id, x.text): x.hits for x in decontaminate.contamination(docs, bench, most_bytes=m).collect()} for m in (1 << 20, 1))
    assert plainly == joined
    hit = [h for h in plainly.values() if h["n_hit"]]
    assert len(hit) == 2 and all(h["items"] == [-7] for h in hit)


def test_whole_pipeline(spark, fixture):
    import sentencepiece
    import public_tokenizers

    import corpus_pipeline

    place, rows, items = fixture
    got = corpus_pipeline.run(spark, place).collect()
    kept, _ = plain.kept_by_quality([(t, lang, source) for _, t, lang, source, *_ in rows])
    good = ordered({(k, t, lang, source) for (k, t, lang, source, *_), yes in zip(rows, kept) if yes})
    root = plain.components([t for _, t, _, _ in good])
    single = [x for i, x in enumerate(good) if root[i] == i]
    clean = [x for x in single if not plain.holds_window(x[1], [t for _, t in items])]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for k, t, lang, source in clean:
        ids = pieces.encode(plain.redacted(t))
        want.append((k, pieces.decode(ids), lang, source, ids, len(ids)))
    assert ordered((x.doc_id, x.decoded, x.lang, x.source, x.ids, x.n_tokens) for x in got) == ordered(want)
    assert 0 < len(want) < len(single) < len(good) < len(rows)


def test_stages_keep_columns_and_take_empty_tables(spark, fixture):
    import corpus_pipeline

    place, _, _ = fixture
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), place)
        assert out.count() == 0
        assert i == 4 or out.columns == docs.columns
