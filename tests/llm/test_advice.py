"""Cases that a cut in a text operator would get wrong."""

import random

import pytest

pytest.importorskip("panelforge.llm")
from panelforge.streaming.storage import fresh_path  # noqa: E402
from panelforge.llm import near_dedup, quality, token_records  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


def linked(texts, size=5, least=0.8):
    """Root of each text by brute force over all pairs; the first of its component."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    root = list(range(len(texts)))
    near = [(a, b) for a in root for b in range(a) if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return root


def similar_texts():
    r = random.Random(12)
    prose = lambda n: [r.choice(WORDS) for _ in range(n)]
    texts = [None, "", "one two", "ONE  two", "one three"]
    for n in (60, 200, 700):
        for _ in range(4):
            base = prose(n)
            texts.append(" ".join(base))
            for share in (60, 45, 30):  # every so many words one is another: similarity about 0.85, 0.8 and 0.7
                texts.append(" ".join("changed" if i % share == 7 else w for i, w in enumerate(base)))
    chain = prose(120)  # each like the next one, the ends unlike
    for i in range(40):
        chain = [*chain]
        chain[r.randrange(120)] = "z"
        texts.append(" ".join(chain))
    passage = prose(60)
    return texts + [" ".join(passage + prose(15 + i % 8)) for i in range(60)]


def test_similar_texts_are_one_component(spark):
    texts = similar_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = linked(texts)
    assert {x.key: x.component for x in near_dedup.similar(frame).collect()} == dict(enumerate(want))
    import corpus_pipeline

    kept = corpus_pipeline.simhash_near_dedup(spark, frame, "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want))
    assert near_dedup.similar(frame.limit(0)).count() == 0


@pytest.mark.parametrize("held", [400])
def test_buckets_searched_in_blocks_give_the_same_components(spark, held):
    texts = similar_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # One band of one MinHash: large buckets of unlike texts, most of them open after the first comparison.
    marks = {x.key: x.component for x in near_dedup.similar(frame, bands=12, rows=1, held=held).collect()}
    assert marks == dict(enumerate(linked(texts)))


def test_set_forest_links_through_others():
    import numpy as np

    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in (0, 4, 8, 100, 102, 12)] + [np.zeros(0, np.uint64)]
    names = [bytes([i]) for i in range(7)]

    def components(links, roots):
        own = list(roots)
        for a, b in links:
            own = [own[a] if x == own[b] else x for x in own]
        return {frozenset(i for i in range(7) if own[i] == x) for x in own}

    want = {frozenset(x) for x in ((0, 1, 2, 5), (3, 4), (6,))}
    assert components(near_dedup.set_forest(sets, names, 0.8), names) == want
    known = [names[i] for i in (0, 0, 2, 3, 3, 2, 6)]  # linked before: only the missing link is told
    links = near_dedup.set_forest(sets, known, 0.8)
    assert len(links) == 1 and components(links, known) == want


@pytest.mark.parametrize("find", [near_dedup.classes, near_dedup.similar])
def test_one_row_of_each_group_stays(spark, find):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice(WORDS) for _ in range(50))
    a, b, c, d, e, f = (prose() for _ in range(6))
    rows = [(5, a, 1), (3, a, 2), (None, a, 3), (None, b, 4), (None, c, 5), (None, c, 5), (7, d, 6), (7, d, 7), (9, e, 8), (9, f, 9)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, name int").repartition(3), find=find).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == sorted([(3, a), (0, b), (0, c), (7, d), (9, e), (9, f)])


def test_secrets_are_accepted_and_rejected_by_the_classifier(spark):
    from panelforge.llm import pii

    r = random.Random(5)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    secret = [hexed(40) for _ in range(30)]
    rows = [(i, f'some prose w{i} token = "{s}" and more') for i, s in enumerate(secret)]
    rows += [(100 + i, f"note: wonderful things, ratio = completely w{i}: unremarkable-words follow") for i in range(30)]
    rows += [(200, f"API_KEY={hexed(32)}\npassword: 'Zx9-{hexed(20)}'"), (201, None), (202, ""), (203, "x" * 50_000 + f' token = "{hexed(40)}"'),
             (204, 'mail = "someone@host.example.com"')]
    got = {x.doc_id: x.pii for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in enumerate(secret):
        assert [rows[i][1][x.start:x.end] for x in got[i].spans if x.kind == "secret"] == [s]
    assert not any(x.kind == "secret" for i in range(100, 130) for x in got[i].spans)
    assert len([x for x in got[200].spans if x.kind == "secret"]) == 2
    assert [(x.kind, x.start) for x in got[203].spans] == [("secret", 50_010)]
    assert [x.kind for x in got[204].spans] == ["email"] and got[201].spans == got[202].spans == []
    assert all(x in got[k].spans for k in got for x in got[k].base)
    masked = {x.doc_id: x.text for x in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[0] == 'some prose w0 token = "<SECRET>" and more'


def test_small_groups_are_judged(spark):
    r = random.Random(4)
    prose = lambda end="": " ".join(r.choice(WORDS) + end for _ in range(r.randint(60, 300)))
    data = [(i, prose(), "en", "large") for i in range(300)]
    small = [("en", f"s{i % 3}") for i in range(30)] + [("en", None)] * 5 + [("fr", "s")] * 8 + [(None, "s")] * 3
    data += [(1000 + i, prose(), *g) for i, g in enumerate(small)]
    data += [(2000 + i, prose("###"), *g) for i, g in enumerate([("en", "s0"), ("en", None), ("fr", "s"), (None, "s"), ("de", "t")])]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    judged = {x.doc_id: x.quality for x in quality.assess(frame).collect()}
    assert len(judged) == len(data) and all(q.distance is not None for q in judged.values())
    assert {k for k, q in judged.items() if not q.kept} == {2000, 2001, 2002, 2003, 2004}
    few = quality.assess(frame.filter("lang = 'fr'")).collect()
    assert len(few) == 9 and all(x.quality.distance is not None for x in few)


def test_added_tokens_in_texts_are_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    library, r = Tokenizer.from_str(spec), random.Random(6)
    pick = ["<|endoftext|>", "<|endof", "text|>", " ", "\n", "  ", "the", " a", "é", "!", "\t", "<|", "|>"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "plain text"] + ["".join(r.choice(pick) for _ in range(r.randint(1, 12))) for _ in range(500)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [31373, 220, 50256, 995]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place = fresh_path(spark, "records")
    back = {x.key: (x.start, x.ids) for x in token_records.read(token_records.write(frame, place, spec), place).collect()}
    at = 0
    for i, ids in enumerate(want):
        assert back[i] == (at, ids + [0])
        at += len(ids) + 1
